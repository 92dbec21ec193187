"""Hierarchies given by parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.checkpoints import held
from docloom.functions import text as tx


def toc_paths(toc: DataFrame) -> DataFrame:
    """``uuid`` and ``path``: the titles of a row's ancestors of type TITLE or DOC as path segments, joined by ``/``.

    Each round doubles the distance of a row's pointer, so a depth of d takes log2(d) joins; two rounds
    are planned at once and held, until no pointer is left. Empty titles add nothing, blank ones an underscore, and the climb goes
    on; a missing parent ends it. A pointer that is left once its distance exceeds the number of rows
    goes round a cycle: rows on or below one have an empty path. Of rows with equal ``uuid`` the last by
    ``ord`` counts.
    """
    none = F.array().cast("array<string>")
    latest = toc.groupBy("uuid").agg(F.max_by(F.struct("parent_uuid", "type", "title"), "ord").alias("r")).select("uuid", "r.*")
    nodes = latest.withColumn("title", tx.sanitize_segment(F.coalesce("title", F.lit(""))))
    counts = nodes["type"].isin("TITLE", "DOC") & (F.col("title") != "")
    at = held(nodes.select("uuid", F.col("parent_uuid").alias("up"), none.alias("above"), F.when(counts, F.array("title")).otherwise(none).alias("own")))
    rows, distance = at.count(), 1
    while distance <= 2 * rows and at.where("up is not null").limit(1).count():
        for _ in range(2):
            far = at.select(F.col("uuid").alias("_u"), F.col("up").alias("_up"), F.concat("above", "own").alias("_names"))
            # a pointer spans the rows up to and without the one it names, whose own title its names start with
            at = at.join(far, F.col("up") == F.col("_u"), "left").select("uuid", F.col("_up").alias("up"), F.concat(F.coalesce("_names", none), "above").alias("above"), "own")
        at, distance = held(at), 4 * distance
    return at.select("uuid", F.when(F.col("up").isNull(), F.concat_ws("/", "above")).otherwise(F.lit("")).alias("path"))


def doc_paths(toc: DataFrame, paths: DataFrame) -> DataFrame:
    """``doc_id`` and ``path`` of the rows of type DOC; of rows with equal ``doc_id`` the last by ``ord`` counts."""
    docs = toc.where("type = 'DOC' and doc_id is not null").join(paths, "uuid")
    return docs.groupBy("doc_id").agg(F.max_by("path", "ord").alias("path"))


def with_paths(docs: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """Docs with their folder path, empty where there is none."""
    return docs.join(paths, key, "left").withColumn("path", F.coalesce("path", F.lit("")))


def path_tree(rows: DataFrame, path: str) -> DataFrame:
    """Rows below each path prefix, and its depth."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix"), k.alias("depth")))
    return rows.where(F.col(path) != "").select(F.explode(prefixes).alias("p")).groupBy("p.prefix", "p.depth").agg(F.count("*").alias("n"))
