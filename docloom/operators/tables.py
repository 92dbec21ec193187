"""Typed data tables: option labels and the grid, kanban, chart and calendar views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.checkpoints import held


def option_label(value: Column, options: dict[str, str]) -> Column:
    """Label of an option; an id without one stays as it is."""
    labels = F.create_map(*[F.lit(x) for kv in options.items() for x in kv])
    return F.coalesce(labels[value], value)


def option_labels(values: Column, options: dict[str, str]) -> Column:
    """Labels of a list of options, joined by a comma."""
    return F.array_join(F.transform(values, lambda v: option_label(v, options)), ", ")


def ordinals(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers from 1 in a global order: rows are range-partitioned, sorted and held once with their
    partition and place, then numbered after the sizes of the partitions before. No task holds all rows."""
    placed = held(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    within = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_k", F.col("_id") - F.shiftleft(F.col("_part"), 33) + 1)
    sizes = within.groupBy("_part").agg(F.max("_k").alias("_n"))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_ahead")  # a row a partition
    return within.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_k") + F.col("_ahead")).drop("_part", "_k", "_ahead", "_id")


def view_order(records: DataFrame, view: DataFrame, key: str) -> DataFrame:
    """``pos`` of each record: those of the view in its order ``ord``, then the others by key."""
    joined = records.join(view, key, "left")
    return ordinals(joined, [F.coalesce(F.col("ord"), F.lit(2**63 - 1)), F.col(key)], "pos")


def kanban(rows: DataFrame, group: Column, item: str, order: str) -> DataFrame:
    """Items of each group in order, one a line, and their number."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(item).alias("_item")))), lambda r: r["_item"])
    return rows.groupBy(group.alias("grp")).agg(F.count("*").alias("n"), F.array_join(items, "\n").alias("items"))


def with_empty_groups(groups: DataFrame, board: DataFrame) -> DataFrame:
    return groups.join(board, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("items", F.lit("")).alias("items"))


def chart_counts(rows: DataFrame, label: Column, order: str) -> DataFrame:
    """Rows of each label, in the order in which labels first occur."""
    counts = rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return ordinals(counts, [F.col("first")], "pos").select("label", "n", F.col("pos").cast("long").alias("pos"))
