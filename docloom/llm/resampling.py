"""Target-distribution importance resampling by an external sort-count (operator 11).

Features of a document are its runs of one to ``orders`` consecutive words, hashed to ``buckets``
buckets. Blocks of documents are written once as packed uint16 streams of bucket numbers with the
documents' offsets. Counting reads the streams back: each block is sorted and run-length encoded, and
Spark adds the runs of all blocks up by bucket. Scoring reads them a second time: gains are gathered
by bucket number and added between the offsets with ``np.add.reduceat``. A block is closed at
``block`` features or 512 documents, so that a task holds one block and one document's text at a time.

The draw is the Gumbel top-k: ``weight`` plus noise from the document's id. Documents are dealt by ranges of (score, id),
sorted within them and numbered by the ranges' counts, so that no task sees all of them.

Defined results: null and empty texts and texts without words have no features, weight 0, and can't
be drawn; a null id takes the noise of the empty text and sorts last among equal scores; repeated rows are documents of
their own; texts of any length are read whole; empty tables of documents give no rows, an empty target counts nothing
in every bucket; other columns of the tables, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_parts, stored

#: Bytes of words: digits, lower-case letters and all of non-ASCII characters; A-Z become a-z, the rest a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def bucket_stream(text: str | None, orders: int, buckets: int) -> tuple[np.ndarray, int]:
    """The uint16 bucket of every feature of a text, and its number of words. A run's crc32 goes on from that of the run without its last word."""
    words = (text or "").encode().translate(WORD_BYTES).split()
    crcs = found = list(map(zlib.crc32, words))
    spaced = [b" " + w for w in words[1:]] if orders > 1 else []
    for n in range(1, min(orders, len(words))):
        crcs = list(map(zlib.crc32, spaced[n - 1 :], crcs))
        found = found + crcs
    return (np.array(found, np.uint32) % np.uint32(buckets)).astype(np.uint16), len(words)


def streams(docs: DataFrame, orders: int, buckets: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: ``ids``, ``words`` and ``ends`` (where each one's features end) and the packed ``stream``."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket number must fit into 16 bits")
    kind = docs.schema[id_col].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, ends, parts, total, id_type = [], [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([ids], pa.list_(id_type)), pa.array([words], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([np.concatenate(parts).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["ids", "words", "ends", "stream"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0), batch.column(1)):
                stream, n = bucket_stream(text.as_py(), orders, buckets)
                if ids and total + len(stream) > block or len(ids) >= 512:
                    yield flush()
                    ids, words, ends, parts, total = [], [], [], [], 0
                total += len(stream)
                ids.append(doc.as_py())
                words.append(n)
                ends.append(total)
                parts.append(stream)
        if ids:
            yield flush()

    texts = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return texts.mapInArrow(packed, f"ids array<{kind}>, words array<long>, ends array<long>, stream binary")


def bucket_counts(blocks: DataFrame) -> DataFrame:
    """``bucket`` and ``n``: sorted runs of each block, added up over all blocks."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_py(), np.uint16), kind="stable")
                if len(ordered):
                    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                    lengths = np.diff(starts, append=len(ordered))
                    yield pa.RecordBatch.from_arrays([pa.array(ordered[starts].astype(np.int32)), pa.array(lengths)], ["bucket", "n"])

    return blocks.select("stream").mapInArrow(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """A bucket's gain in thousandths: the log ratio of its smoothed shares of the target and of the source."""
    all_s, all_t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = ((target.get(b, 0) + 1.0) * all_s / ((source.get(b, 0) + 1.0) * all_t) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray, id_col: str, kind: str) -> DataFrame:
    """Per document: its id, ``n_words``, ``n_features`` and ``weight`` (the sum of its features' gains)."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ids, words, ends = (one.column(c).flatten() for c in range(3))
                ends = ends.to_numpy()
                starts = np.concatenate(([0], ends[:-1]))
                some = starts < ends  # reduceat would give the next one's first gain for a document without features
                total = np.zeros(len(ends), np.int64)
                if some.any():
                    total[some] = np.add.reduceat(gain[np.frombuffer(one.column(3)[0].as_py(), np.uint16)], starts[some])
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(ends - starts), pa.array(total)], [id_col, "n_words", "n_features", "weight"])

    return blocks.select("ids", "words", "ends", "stream").mapInArrow(gathered, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, n: int) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3...) in an ``order`` of columns, null from ``n`` + 1 on: dealt by ranges, numbered by their counts."""
    dealt = rows.repartitionByRange(n_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    # the number holds a range in its upper bits and the place in the range in the lower 33
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    sizes = dealt.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # a row for each range
    before, firsts = 0, []
    for part, size in sorted(map(tuple, sizes)):
        firsts.append((part, before))
        before += size
    first = F.broadcast(rows.sparkSession.createDataFrame(firsts, "_part long, _first long"))
    rank = F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return dealt.join(first, F.shiftright("_at", 33) == F.col("_part")).select(*rows.columns, F.when(rank <= n, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int, least_words: int = 20, orders: int = 3, buckets: int = 10_000, seed: int = 42, block: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, ``n_features``, ``weight``, ``score`` and ``rank`` (null if it isn't drawn). Of the documents
    of ``least_words`` words or more, ``percent`` of a hundred are drawn towards the texts of ``target``."""
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = stored(streams(docs, orders, buckets, block, id_col, text_col), "streams", compression="zstd")
    aims = streams(target.select(F.lit(0).alias(id_col), text_col), orders, buckets, block, id_col, text_col)
    source, aim = ({r.bucket: r.n for r in bucket_counts(b).collect()} for b in (blocks, aims))  # a row for each bucket
    number = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), number).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weights(blocks, gains(source, aim, buckets), id_col, kind).withColumn("score", F.col("weight") + noise)
    scored = stored(scored, "scores")
    able = F.col("n_words") >= least_words
    n = percent * scored.where(able).count() // 100
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("weight"), F.asc("n_features")]
    drawn = ranked(scored.where(able).drop("n_words"), order, n)
    return drawn.unionByName(scored.where(~able).drop("n_words").withColumn("rank", F.lit(None).cast("long")))
