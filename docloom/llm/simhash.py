"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 9).

Fingerprints of at most ``radius`` differing bits meet in a variant that lies within half the
radius of both. Emitting the whole ball of a 64-bit fingerprint (2,081 variants at radius 4) is
thirty times more rows than the shuffle needs: by the pigeonhole principle two such fingerprints
differ in at most ``radius // blocks`` bits on one of ``blocks`` equal parts, so each part emits the
ball of half *that* radius (33 variants of each 32-bit half at radius 4). Fingerprints that collide
on a variant are verified on all 64 bits. ``blocks=1`` is the plain form.

Equal fingerprints are one node, so copies never meet each other. Within a variant's bucket the
search keeps only a spanning forest of the verified links.

Defined results: null and blank texts have fingerprint zero and are linked like any other; texts
of fewer words than a shingle are hashed as one shingle; a null id has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_parts, stored
from .components import components


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> list[int]:
    """Hashes of the shingles of ``width`` words, A-Z lower-cased, split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -width].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, width, seed)
    if not hashes:
        return 0
    h = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):  # bounded memory for very long texts
        part = h[k : k + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """The id and ``fp`` (signed long) of every document."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(text.as_py(), width) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(hashed, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` set bits among ``bits``."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def variants(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``key`` (part and variant), ``fp``, ``node``: the ball of half the part's radius around each part."""
    bits = 64 // blocks
    masks = ball(bits, (radius // blocks + 1) // 2)
    part = (1 << bits) - 1
    rows = fps.select("fp", "node", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
    key = F.expr(f"shiftrightunsigned(fp, part * {bits})")
    if blocks > 1:
        key = key.bitwiseAND(F.lit(part))
    rows = rows.select("fp", "node", "part", key.alias("own"))
    signed = [m - (m >> 63 << 64) for m in masks]
    rows = rows.select("fp", "node", "part", "own", F.explode(F.lit(signed)).alias("mask"))
    tag = F.col("part").cast("long") * F.lit(1 << bits) if blocks > 1 else F.lit(0).cast("long")
    return rows.select((F.col("own").bitwiseXOR(F.col("mask")) + tag).alias("key"), "fp", "node")


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the verified links of each run of equal keys; rows come sorted by key."""

    def found(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        size = np.diff(np.r_[at, len(key)])
        a, b = [], []
        two = at[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        a.append(node[near])
        b.append(node[near + 1])
        for start, n in zip(at[size > 2].tolist(), size[size > 2].tolist()):
            f, ids = fp[start : start + n], node[start : start + n]
            left = np.ones(n, bool)
            for root in range(n):
                if not left[root]:
                    continue
                left[root] = False
                todo = [root]
                while todo and left.any():
                    x = todo.pop()
                    rest = np.flatnonzero(left)
                    new = rest[np.bitwise_count(f[rest] ^ f[x]) <= radius]
                    if len(new):
                        left[new] = False
                        todo.extend(new.tolist())
                        a.append(np.full(len(new), ids[x]))
                        b.append(ids[new])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    for batch in batches:
        key, fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        held = [np.concatenate(x) for x in zip(held, (key, fp.view(np.uint64), node))]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last run may go on
        if cut:
            yield found(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    yield found(*held)


def links(fps: DataFrame, radius: int = 4, blocks: int = 2) -> DataFrame:
    """``a``, ``b``: links that join every two of the distinct fingerprints (``fp``, ``node``) that a
    chain of steps of at most ``radius`` bits joins."""
    dealt = variants(fps, radius, blocks).repartition(n_parts(fps.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _links(batches, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, blocks: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Per document: its id, ``fp`` and ``component_id``, the smallest id reachable over links."""
    fps = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = stored(fps.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).cast("long").alias("node")), "nodes")
    found = components(links(nodes, radius, blocks))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = fps.join(named, "fp", "left")
    return out.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
