"""Corpus pipeline: quality classifier, language ID, near-duplicates by shingles, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. Null and empty texts: the first stage scores them like any
other text, the second rejects texts without letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import langid, quality, queries, similar
from docloom.llm.common import bucket_of, stored, table


def wrapped(docs: DataFrame) -> DataFrame:
    """Id, text and the whole row as ``doc``: no name that a stage adds can clash with the row's own."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold stay; learns from labels outside the held-out quarter."""
    net = quality.train(docs, table(spark, sf_dir, "labels"), usable=bucket_of("doc_id", 4) != 2)
    if net is None:
        return docs
    return quality.score(wrapped(docs), net, keep=["doc"]).where(F.col("score") >= quality.THRESHOLD).select("doc.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that makes up at least half of them stay."""
    model = langid.train(docs.where(bucket_of("doc_id", 4) != 2))
    found = langid.identify(wrapped(docs), model, keep=["doc"])
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= 0.5)).select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; repeated rows of an id are one document.
    Groups are chains of pairs of a Jaccard similarity of 0.8 or more on shingles of five words: those within 4 bits of
    operator 9's fingerprints are found by its balls and confirmed, the others by an exact join."""
    found = similar.groups(docs, least=0.8, width=5, radius=4)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").limit(1).count()
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionAll(kept.where("doc_id is null")) if repeated else kept


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of what is left."""
    return queries.packed(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: The classifier, the language model and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
