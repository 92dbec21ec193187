"""Orders of titles as readers expect them: by a language's collation, by the numbers in them, folders before files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import sequences, trees

#: The collation of titles. Fixed value.
COLLATION = "zh"


def in_language(text: Column, collation: str = COLLATION) -> Column:
    """A sort key for a text; a null counts as the empty text."""
    return F.collate(F.coalesce(text.cast("string"), F.lit("")), collation)


def natural(text: Column) -> list[Column]:
    """Sort keys of a text: all of its numbers in turn, a missing one as 0, then the collation; a number beyond a double's range counts as the largest."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit("([0-9]+)")), lambda n: n.cast("double"))
    # zeros at the end say the same as numbers that are missing
    last = F.array_max(F.transform(numbers, lambda n, k: F.when(n != 0, k + 1)))
    return [F.slice(numbers, F.lit(1), F.coalesce(last, F.lit(0))), in_language(text)]


def ranked(rows: DataFrame, key: str, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, within ``key`` in an ``order``; a key with very many rows is spread over ranges."""
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    placed = sequences.dealt(rows.select("*", *keys), [key, *[f"_o{i}" for i in range(len(order))]])
    return sequences.places(placed, key, name).select(*rows.columns, name)


def file_tree(files: DataFrame, fid: str, path: str, title: str) -> DataFrame:
    """The lines of a tree of files: ``number`` (from 0), ``depth``, ``name``, ``fid`` (null for a folder) and ``n_files`` below it or 1.

    A file's ``path`` names its folders. In a folder the folders come first, then the files, each by the collation of their names, files of
    one title by ``fid``. Empty segments are none; a null path is the top. Folder lines come from distinct paths, numbers from a walk round the tree."""
    parts = F.filter(F.split(F.coalesce(F.col(path), F.lit("")), "/"), lambda s: s != "")
    prefix = lambda k: F.concat_ws("/", F.slice(F.col("_parts"), F.lit(1), k))
    rows = files.select(F.col(fid), F.coalesce(F.col(title), F.lit("")).alias("name"), parts.alias("_parts"))
    folders = rows.select("_parts").distinct().where(F.size("_parts") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda k: F.struct(prefix(k).alias("node"), prefix(k - 1).alias("up"), F.element_at("_parts", k).alias("name")))).alias("f"))
    up = F.when(F.col("f.up") != "", F.concat(F.lit("d/"), F.col("f.up")))
    folders = folders.select(F.concat(F.lit("d/"), F.col("f.node")).alias("node"), up.alias("parent"), F.col("f.name").alias("name"), F.lit(None).cast(files.schema[fid].dataType).alias(fid)).distinct()
    own = F.when(F.size("_parts") > 0, F.concat(F.lit("d/"), prefix(F.size("_parts"))))
    leaves = rows.select(F.concat(F.lit("f/"), F.col(fid).cast("string")).alias("node"), own.alias("parent"), "name", fid)
    nodes = folders.unionAll(leaves).withColumn("tree", F.lit(0))
    is_file = F.col("node").startswith("f/")
    tour = trees.toured(nodes, "tree", "node", "parent", [is_file, in_language(F.col("name")), F.col(fid)], {"n_files": is_file.cast("int")})
    return tour.select("number", "depth", "name", fid, F.col("n_files").cast("long").alias("n_files"))
