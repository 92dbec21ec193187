"""Rows that later steps must read as they were computed once, and the shared folder that keeps them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _prepare(spark: SparkSession) -> str:
    """The checkpoint folder: what ``spark.checkpoint.dir`` names; only on one machine, where that is
    unset, a temporary one."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def held(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the checkpoint folder."""
    _prepare(df.sparkSession)
    return df.checkpoint()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder."""
    return f"{_prepare(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept as a table in the checkpoint folder. Unlike :func:`held` nothing of its plan goes
    with it: what rounds of joins infer about columns would grow with every round."""
    path = fresh_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
