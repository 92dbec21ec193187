"""Rows in an order that no single task holds: what stands before a row, running sums, places.

Rows are dealt by ranges of the order, sorted and held once; each range is worked on by itself, and what a range
needs from those before it comes from one row a range. A key with very many rows is spread over ranges like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.checkpoints import written


def dealt(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``_part`` (the range) and ``_id``, both rising in ``order``."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return written(placed).withColumn("_part", F.shiftright("_id", 33))


def filled(rows: DataFrame, key: str, value: Column, name: str, backwards: bool = False, own: bool = True) -> DataFrame:
    """``name``: the last ``value`` that is not null up to each row of :func:`dealt` (the next from it on if ``backwards``) within
    its ``key``, the row's own included if ``own``."""
    mark = F.when(value.isNotNull(), F.struct(F.col(key).alias("k"), value.alias("v")))
    rows = rows.withColumn("_seq_mark", mark)
    end = 0 if own else -1
    order = F.col("_id").desc() if backwards else F.col("_id")
    inner = F.last("_seq_mark", ignorenulls=True).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, end))
    best = (F.min_by if backwards else F.max_by)(F.col("_seq_mark"), F.when(F.col("_seq_mark").isNotNull(), F.col("_id")))
    parts = rows.groupBy("_part").agg(best.alias("_end"))  # a row a range
    turn = F.col("_part").desc() if backwards else F.col("_part")
    carried = F.last("_end", ignorenulls=True).over(Window.orderBy(turn).rowsBetween(Window.unboundedPreceding, -1))
    carry = parts.select(F.col("_part").alias("_seq_p"), carried.alias("_seq_carry"))
    both = rows.withColumn("_seq_inner", inner).join(F.broadcast(carry), F.col("_part") == F.col("_seq_p"), "left")
    found = F.coalesce("_seq_inner", "_seq_carry")
    return both.withColumn(name, F.when(found["k"].eqNullSafe(F.col(key)), found["v"])).drop("_seq_mark", "_seq_inner", "_seq_p", "_seq_carry")


def running(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` up to and with each row of :func:`dealt` within its ``key``; nulls count nothing."""
    rows = rows.withColumn("_seq_add", F.coalesce(value, F.lit(0).cast("double")))
    inner = F.sum("_seq_add").over(Window.partitionBy("_part", key).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.groupBy("_part", F.col(key).alias("_seq_key")).agg(F.sum("_seq_add").alias("_sum"))
    ends = parts.groupBy("_part").agg(F.min("_seq_key").alias("_low"), F.max("_seq_key").alias("_high"))
    # only a key at an end of a range goes on in another one: two rows a range
    lows, highs = (ends.select("_part", F.col(c).alias("_seq_key")) for c in ("_low", "_high"))
    shared = parts.join(lows.union(highs).distinct(), ["_part", "_seq_key"], "left_semi")
    before = F.sum("_sum").over(Window.partitionBy("_seq_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carry = shared.select(F.col("_part").alias("_seq_p"), F.col("_seq_key").alias("_seq_k"), before.alias("_seq_before")).where("_seq_before is not null")
    both = rows.withColumn("_seq_inner", inner).join(carry, (F.col("_part") == F.col("_seq_p")) & (F.col(key) == F.col("_seq_k")), "left")
    return both.withColumn(name, F.col("_seq_inner") + F.coalesce("_seq_before", F.lit(0.0))).drop("_seq_add", "_seq_inner", "_seq_p", "_seq_k", "_seq_before")


def places(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``name``: the place of each row of :func:`dealt` within its ``key``, from 1."""
    return running(rows, key, F.lit(1.0), "_seq_place").withColumn(name, F.col("_seq_place").cast("long")).drop("_seq_place")
