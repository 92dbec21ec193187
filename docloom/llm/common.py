"""Helpers shared by the training-data operators: shared folders, splits and small column idioms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset and the master is local
    (tests on one machine) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            base = kept.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="docloom-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts the lineage so that
    later jobs survive lost executors without repeating the work."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_hashed(df: DataFrame, id_col: str, n: int, rows: int, salt: int = 0) -> DataFrame:
    """``n`` of about ``rows`` rows, those of least hash: a bounded sample that does not depend on how
    rows are dealt. Tasks drop what lies far above the wanted share before they sort."""
    h = F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(1 << 40))
    share = min(1.0, (1.3 * n + 200) / max(rows, 1))
    return df.where(h < int(share * (1 << 40))).orderBy(h, id_col).limit(n)
