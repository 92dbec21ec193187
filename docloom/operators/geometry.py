"""Plane geometry over tables of points, boxes and polylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import plane


def bbox(rows: DataFrame, keys: list[str], x: Column, y: Column, width: Column | None = None, height: Column | None = None) -> DataFrame:
    right, bottom = x + (width if width is not None else 0), y + (height if height is not None else 0)
    return rows.groupBy(*keys).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(right).alias("max_x"), F.max(bottom).alias("max_y"))


def nearest(points: DataFrame, nodes: DataFrame, pid: str, nid: str, limit: float, k: int = 1) -> DataFrame:
    """The ``k`` nodes (x, y) nearest to each point within ``limit``, of equally near ones those of the least ``nid``; cells are
    as small as nodes are dense (:func:`docloom.operators.plane.nearest_within`)."""
    near = plane.nearest_within(points, nodes, [], pid, nid, (limit, limit), lambda dx, dy: dx**2 + dy**2, nid, k=k)
    near = near.where(F.col("distance") < limit * limit).withColumnRenamed("distance", "d2")
    if k == 1:
        return near.groupBy(pid).agg(F.min(F.struct("d2", nid)).alias("m")).select(pid, F.col(f"m.{nid}").alias(nid), F.col("m.d2").alias("d2"))
    rank = F.row_number().over(Window.partitionBy(pid).orderBy("d2", nid))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(pid, nid, "d2", "rank")


def lanes(rows: DataFrame, ratio: Column, widths: list[float]) -> DataFrame:
    """Lane of each ratio among cumulative widths, the first that holds it; null outside."""
    edges = [0.0]
    for w in widths:
        edges.append(edges[-1] + w)
    lane = F.lit(None).cast("int")
    for i in range(len(widths) - 1, -1, -1):
        lane = F.when((ratio >= edges[i]) & (ratio <= edges[i + 1]), F.lit(i)).otherwise(lane)
    return rows.withColumn("lane", lane)


def arc_lengths(points: DataFrame, key: str, x: Column, y: Column, order: list[str]) -> DataFrame:
    """Length of each polyline's segment that ends in a point, and the path's length so far."""
    w = Window.partitionBy(key).orderBy(*order)
    step = F.coalesce(F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w)), F.lit(0.0))
    return points.withColumn("step", step).withColumn("so_far", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gap_clusters(rows: DataFrame, key: str, value: Column, order: list[str], tolerance: float) -> DataFrame:
    """Number of the cluster of each row: a new one starts after a gap above ``tolerance``."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(value - F.lag(value).over(w) > tolerance, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def nearest_labels(points: DataFrame, labels: DataFrame, key: str, pid: str) -> DataFrame:
    """``label`` nearest to each point of its key along x, of equally near ones that of the least ``ord``; empty
    where the key has none. Points and labels are sorted together and each point looks to the last label on
    either side, so that no pairs are formed. points: key, pid, x; labels: key, x, text, ord."""
    marks = labels.groupBy(key, "x").agg(F.min(F.struct("ord", "text")).alias("_l"))
    marks = marks.select(key, F.lit(None).cast(points.schema[pid].dataType).alias(pid), "x", F.struct("x", "_l.ord", "_l.text").alias("_mark"))
    both = points.select(key, pid, "x", F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark")).unionAll(marks)
    side = lambda x: F.last("_mark", ignorenulls=True).over(Window.partitionBy(key).orderBy(x, F.col("_mark").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("_left", side(F.col("x"))).withColumn("_right", side(F.col("x").desc())).where("_mark is null")
    far = lambda side: F.when(side.isNotNull(), F.struct(F.abs(side["x"] - F.col("x")).alias("d"), side["ord"].alias("ord"), side["text"].alias("text")))
    return seen.select(pid, F.coalesce(F.least(far(F.col("_left")), far(F.col("_right")))["text"], F.lit("")).alias("label"))


def split_labels(rows: DataFrame, key: str, least_gap: float = 120) -> DataFrame:
    """``grp`` 0 or 1 of each label (key, text, x, ord). A key of at least ten labels, three texts of which
    repeat, is split: an even number into halves by x, an odd one at its widest gap (the first of them) if
    that is ``least_gap`` or more; groups of under three labels go. Other keys are one group."""
    w = Window.partitionBy(key).orderBy("x", "ord")
    ranked = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_gap", F.col("x") - F.lag("x").over(w))
    per_key = ranked.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.struct("_gap", -F.col("_rn"))).alias("_widest"))
    texts = rows.groupBy(key, "text").agg(F.count("*").alias("_c")).groupBy(key).agg(F.count_if(F.col("_c") > 1).alias("_again"))
    wide = F.coalesce(F.col("_widest._gap") >= least_gap, F.lit(False))
    first = F.when((F.col("_n") >= 10) & (F.col("_again") >= 3), F.when(F.col("_n") % 2 == 0, F.col("_n") / 2 + 1).when(wide, -F.col("_widest.col2")))
    split = ranked.join(per_key, key).join(texts, key).withColumn("_first", first.cast("long"))
    grp = F.when(F.coalesce(F.col("_rn") >= F.col("_first"), F.lit(False)), 1).otherwise(0)
    size = F.when(grp == 1, F.col("_n") - F.col("_first") + 1).otherwise(F.col("_first") - 1)
    return split.where(F.col("_first").isNull() | (size >= 3)).select(*rows.columns, grp.alias("grp"))
