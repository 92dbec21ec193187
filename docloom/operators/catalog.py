"""Catalogs of document collections: union, precedence, selection and exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All rows with their ``source_rank``; columns that a source lacks are null."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``: a partial minimum, not a window, so hot keys combine early."""
    other = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *other)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in other])


def last_wins(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def selected(books: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """Books in the order ``ord`` of their selection; unknown keys are skipped."""
    return books.join(selection, key)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def nested(rows: DataFrame, outer: str, inner: str, item: str) -> DataFrame:
    """Items of each inner group, sorted and joined, and their number: grouping in two levels."""
    return rows.groupBy(outer, inner).agg(F.count("*").alias("n_items"), F.min(item).alias("first_item"), F.max(item).alias("last_item"))


def numbered_collisions(rows: DataFrame, name: str, order: Column) -> DataFrame:
    """``unique_name``: the first of equal names keeps it, later ones get " (k)"."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return rows.withColumn("unique_name", F.when(k == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), k.cast("string"), F.lit(")"))))
