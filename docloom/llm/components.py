"""Connected components of an edge table, by alternating large and small stars.

Edges stay in Spark throughout: each round groups by node with a partial minimum and joins that
minimum back, so a node with very many neighbours is summed before the shuffle and its join can be
split. Each round is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of an edge.

    Nodes without a link to another node have no row; edges with a null end or equal ends are
    ignored, repeated ones count once.
    """
    now = stored(_down(edges.select(F.col(a).alias("v"), F.col(b).alias("u"))), "edges")
    mark = _mark(now)
    while True:
        now = stored(_small(_large(now)), "edges")
        was, mark = mark, _mark(now)
        if mark == was:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            )


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node v to the smaller u."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = edges.select("v", "u").unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    return both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.unionAll(least.select("v", F.col("m").alias("u"))).distinct()
