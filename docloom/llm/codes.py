"""Vector code compression: product codes found by partial-distance search (operator 12).

Vectors become integers, are cut into ``parts`` equal parts and each part position has a codebook of
``entries`` entries, refined in ``rounds`` rounds. A round is one pass over the stored integers: each
task assigns its parts and hands out one sum and count for each entry, so only sums of the size of the
codebooks travel and come to the driver, however many vectors there are.

The search goes through the dimensions of a part in descending variance of the codebook, a block of
vectors at once: the nearest entry by the first dimension is completed and gives each vector its best
complete distance; masks drop every entry whose integer distance so far strictly exceeds it, so that
ties survive and the lowest index of the least distance wins.

Defined results: vectors that are null, empty or hold a null or non-finite component are dropped, as
are those of another number of components than most have (ties: the larger) and those with a component whose integer needs over 62
bits; integers of over 27 bits are exact too, by a slower path. Rows without an id are
coded, their ids come last in the order of the smallest; rows of one id go by their components. Fewer vectors than entries: as many entries
as vectors. Repeated rows are vectors of their own. An empty table gives no rows. An error beyond a
64-bit integer is null. Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Vectors that are coded at once.
BLOCK = 4096


def as_integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """``id``, ``label`` and the integer components ``v`` of usable vectors."""
    scaled = F.transform(vector_col, lambda x: x.cast("double") * F.lit(float(scale)))
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float(1 << 62)))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), vector_col).withColumn("v", scaled).where(usable)
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x).cast("long")).alias("v"))


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``v`` the lowest index of its nearest entry of ``book`` and the squared distance, by partial distances."""
    if max(np.abs(v).max(initial=0), np.abs(book).max(initial=0)) >= 1 << 27:
        v, book = v.astype(object), book.astype(object)
    order = np.argsort(-book.astype(float).var(0), kind="stable")
    first = (v[:, order[0], None] - book[None, :, order[0]]) ** 2
    best = ((v - book[first.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(first <= best[:, None])
    so_far = first[row, entry]
    for d in order[1:]:
        so_far = so_far + (v[row, d] - book[entry, d]) ** 2
        alive = so_far <= best[row]
        row, entry, so_far = row[alive], entry[alive], so_far[alive]
    # what is left comes by row, then entry: stable sorting by distance puts the lowest index first
    ranked = np.argsort(so_far, kind="stable")
    ranked = ranked[np.argsort(row[ranked], kind="stable")]
    starts = np.searchsorted(row[ranked], np.arange(len(v)))
    return entry[ranked[starts]], so_far[ranked[starts]]


def _blocks(batches: Iterator[pa.RecordBatch], column: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors as (rows, parts, components of a part)."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(k, BLOCK)
            yield piece, piece.column(column).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, parts, -1)


def _sums(rows: DataFrame, books: list[np.ndarray], parts: int) -> list:
    """Sums and counts of the parts assigned to each entry, for every component: (part, entry, place, total, n)."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for _, v in _blocks(batches, 0, parts):
            for p, book in enumerate(books):
                code, _ = nearest(v[:, p], book)
                one_hot = code[:, None] == np.arange(len(book))
                counts[p] += one_hot.sum(0)
                small = np.abs(v[:, p]).max(initial=0) < 1 << 49  # such sums of a block are exact in 64 bits
                totals[p] += (one_hot.T.astype(np.int64) @ v[:, p]).astype(object) if small else one_hot.T.astype(object) @ v[:, p].astype(object)
        out = [(p, e, j, str(t), int(counts[p][e])) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist() for j, t in enumerate(totals[p][e])]
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3]), pa.array(columns[4], pa.int64())], ["part", "entry", "place", "total", "n"])

    found = rows.select("v").mapInArrow(assigned, "part int, entry int, place int, total string, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()


def codebooks(rows: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebook of each part position, from the parts of the smallest ids on."""
    start = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    books = list(np.array([r.v for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for part, entry, place, total, n in _sums(rows, books, parts):
            books[part][entry, place] = int(total) // n
    return books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """Per vector: its id, ``code`` (two hex digits a part), ``error``, ``label_error`` (the errors of its label
    together) and ``codebooks_sha256``."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold up to 256 entries")
    rows = stored(as_integers(vectors, scale, id_col, vector_col, label_col), "integers")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    width = sizes.d if sizes else parts
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == width)
    books = codebooks(rows, parts, entries, rounds) if sizes else []
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, v in _blocks(batches, 2, parts):
            found = [nearest(v[:, p], book) for p, book in enumerate(books)]
            codes = np.stack([code for code, _ in found], 1).astype(np.uint8)
            errors = [e if e < 1 << 63 else None for e in sum(e.astype(object) for _, e in found).tolist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    out = stored(rows.mapInArrow(coded, f"id {kinds[0]}, label {kinds[1]}, code string, error long"), "codes")
    labels = out.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    out = out.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
