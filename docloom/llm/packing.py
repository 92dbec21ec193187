"""Conflict-constrained best-fit packing (operator 7).

Documents become sequences of at most ``capacity`` tokens; a longer one fills bins of its own and
its rest is packed like the others. Rows are dealt by hash, repeated rows each by its own, to shards
of about ``shard_rows`` rows, so the bins are the tightest of their shard and not of the table. Each is
packed in decreasing length: open bins are kept by residual, each with a bitmap of the sources
and one of the duplicate clusters it holds, and a successor search over the residuals goes on until
the tightest bin without a conflict is found. No two pieces of one source, and none of one cluster
of duplicates, share a bin.

Defined results: a document of no words is one token (its end); null sources and null clusters
conflict with nothing; ties go to the bin opened first; every document is placed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


class Bins:
    """Open bins by residual. ``full[s, r]`` counts the bins of residual r that hold source s."""

    def __init__(self, capacity: int, sources: int):
        self.residual: list[int] = []
        self.source_bits: list[int] = []
        self.cluster_bits: list[int] = []
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.open = np.zeros(capacity + 1, np.int64)
        self.full = np.zeros((sources + 1, capacity + 1), np.int64)  # the last row: no source
        self.capacity = capacity

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin that takes the piece. source, cluster: numbers within the shard, -1 for none."""
        own, copy = (1 << source) if source >= 0 else 0, (1 << cluster) if cluster >= 0 else 0
        r = size - 1
        while True:
            # next residual with a bin that lacks the source
            later = np.flatnonzero(self.open[r + 1 :] > self.full[source, r + 1 :]) if r < self.capacity else ()
            for r in (later + (r + 1)).tolist() if len(later) else ():
                for b in self.at[r]:
                    if not self.source_bits[b] & own and not self.cluster_bits[b] & copy:
                        self._move(b, r, r - size, source)
                        self.source_bits[b] |= own
                        self.cluster_bits[b] |= copy
                        return b
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.source_bits.append(own)
            self.cluster_bits.append(copy)
            self._move(b, None, self.capacity - size, source)
            return b

    def _move(self, b: int, before: int | None, after: int, source: int) -> None:
        if before is not None:
            del self.at[before][b]
            self.open[before] -= 1
            bits = self.source_bits[b]
            while bits:
                s = bits & -bits
                self.full[s.bit_length() - 1, before] -= 1
                self.full[s.bit_length() - 1, after] += 1
                bits ^= s
        if source >= 0:
            self.full[source, after] += 1
        self.at[after][b] = None
        self.open[after] += 1
        self.residual[b] = after


def pack_shard(rows: pa.Table, capacity: int, id_col: str) -> pa.Table:
    """Places the pieces of one shard, longest first."""
    rows = rows.sort_by([("size", "descending"), ("_order", "ascending"), ("piece", "ascending")])
    sizes = rows.column("size").to_pylist()
    numbers = []
    for name in ("source", "cluster"):
        seen: dict = {None: -1}
        numbers.append([seen.setdefault(v, len(seen) - 1) for v in rows.column(name).to_pylist()])
    n_sources = max(numbers[0], default=-1) + 1
    bins = Bins(capacity, n_sources)
    # bitmaps of clusters need a bit only where a cluster occurs twice
    often = np.bincount(np.array(numbers[1], int) + 1, minlength=1)
    short: dict[int, int] = {}
    clusters = [short.setdefault(c, len(short)) if c >= 0 and often[c + 1] > 1 else -1 for c in numbers[1]]
    placed = [bins.place(s, source, cluster) for s, source, cluster in zip(sizes, numbers[0], clusters)]
    used = np.zeros(len(bins.residual), np.int64)
    offsets = []
    for b, s in zip(placed, sizes):
        offsets.append(int(used[b]))
        used[b] += s
    shard = rows.column("shard")
    return pa.table({
        id_col: rows.column(id_col), "piece": rows.column("piece"), "start": rows.column("start"), "n_tokens": rows.column("size"),
        "shard": shard, "bin": pa.array(placed, pa.int64()), "bin_offset": pa.array(offsets, pa.int64()), "bin_used": pa.array(used[placed], pa.int64()),
    })


def pack(docs: DataFrame, length: Column, source: Column, cluster: Column, capacity: int = 2048, shard_rows: int = 8192, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: the document's id, ``piece`` (from 0), ``start`` and ``n_tokens`` within the
    document, and its ``shard``, ``bin`` (within the shard), ``bin_offset`` and ``bin_used``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.greatest(length, F.lit(1)).cast("long").alias("length"), source.cast("string").alias("source"), cluster.alias("cluster"))
    # stored with a number for each row: a repeated task must deal repeated rows as before
    order = F.xxhash64(F.col(id_col), F.col("length"), F.col("cluster"))
    rows = stored(rows.withColumn("_order", order).withColumn("_row", F.monotonically_increasing_id()), "sequences")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    repeated = stored(rows.groupBy("_order").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_order").alias("_again")), "repeated")
    rows = rows.join(repeated, F.col("_order") == F.col("_again"), "left")
    rows = rows.withColumn("shard", F.pmod(F.when(F.col("_again").isNull(), F.col("_order")).otherwise(F.xxhash64("_order", "_row")), F.lit(shards)))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / capacity))).alias("piece"))
    pieces = pieces.select(id_col, "_order", "shard", "source", "cluster", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("length") - F.col("piece") * capacity, F.lit(capacity)).alias("size"))
    schema = f"{id_col} {kind}, piece long, start long, n_tokens long, shard long, bin long, bin_offset long, bin_used long"
    return pieces.groupBy("shard").applyInArrow(lambda t: pack_shard(t, capacity, id_col), schema)
