"""Approximate nearest neighbours by stable projections and a kd-tree (operator 8).

Largest inner product becomes least distance by one added component, sqrt(M^2 - |x|^2) with M the
largest norm (0 for queries). Gaussian projections to ``dims`` dimensions are indexed by a kd-tree:
its upper levels, split at medians of a bounded sample, deal rows to boxes; each box has its own
tree of small leaves. A query searches its home box first. Leaves then come in the order of their
projected distance and are verified by exact inner products, until the chi-square test holds: were
a nearer vector still unseen, its projection would lie this far off with a probability below
1 - ``confidence``. Boxes for which it already holds are not visited. Every row is indexed.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and
rows with a null id, take no part as query or candidate; candidates have the query's length; ties
go to the smaller id; with fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, stored
from .covertree import usable

LEAF = 64
BOX_ROWS = 4096
MAX_BOXES = 1 << 14
QUERY_BLOCK = 512


def chi_square_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """For an even number of dimensions."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for j in range(1, dims // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


def stop_at(dims: int, confidence: float) -> float:
    """Squared projected distance, in squared distances of the k-th neighbour, at which the test holds."""
    grid = np.linspace(0, 20 * dims, 200_001)
    return float(grid[np.searchsorted(chi_square_cdf(grid, dims), confidence)])


def kd_split(p: np.ndarray, ids: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: at each node the widest dimension is split at its median."""
    todo, leaves = [np.arange(len(p))], []
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            leaves.append(at)
            continue
        wide = int(np.argmax(np.ptp(p[at], 0)))
        by = at[np.lexsort((ids[at], p[at, wide]))]
        todo += [by[: len(by) // 2], by[len(by) // 2 :]]
    return leaves


def upper_tree(sample: np.ndarray, boxes: int) -> list[tuple[int, float]]:
    """Dimension and threshold of each inner node, in heap order, of a kd-tree with ``boxes`` (a power of 2) leaves."""
    nodes: list[tuple[int, float]] = []
    level = [sample]
    while len(level) < boxes:
        below = []
        for s in level:
            dim = int(np.argmax(np.ptp(s, 0))) if len(s) else 0
            cut = float(np.median(s[:, dim])) if len(s) else 0.0
            nodes.append((dim, cut))
            below += [s[s[:, dim] <= cut], s[s[:, dim] > cut]]
        level = below
    return nodes


def box_of(p: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(p), np.int64)
    if nodes:
        dims, cuts = np.array([d for d, _ in nodes]), np.array([c for _, c in nodes])
        for _ in range((len(nodes) + 1).bit_length() - 1):
            at = 2 * at + 1 + (p[np.arange(len(p)), dims[at]] > cuts[at])
    return at - len(nodes)


def box_gap(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    d = np.maximum(0, np.maximum(low[None] - q[:, None], q[:, None] - high[None]))
    return (d * d).sum(2)


def search(qids: np.ndarray, q: np.ndarray, pq: np.ndarray, kth: np.ndarray, ids: np.ndarray, x: np.ndarray, p: np.ndarray, far: float, norm2: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) rows of the best ``k`` of one box for each query. kth: score known to be
    reached by k vectors; far: ``stop_at``; norm2: M squared."""
    leaves = kd_split(p, ids, LEAF)
    low, high = np.array([p[s].min(0) for s in leaves]), np.array([p[s].max(0) for s in leaves])
    gaps = box_gap(pq, low, high)
    q2 = (q * q).sum(1)
    best = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    limit = kth.copy()
    # leaves are visited by rank of nearness, each query testing with what it has found by then
    for s in np.argsort(np.minimum.reduce(gaps, 0), kind="stable").tolist():
        d2 = np.maximum(norm2 + q2 - 2 * limit, 0)  # squared distance of the k-th neighbour
        at = np.flatnonzero(~(gaps[:, s] > far * d2 * (1 + 1e-12)))
        if not len(at):
            continue
        scores = q[at] @ x[leaves[s]].T
        scores[qids[at][:, None] == ids[leaves[s]][None]] = -np.inf
        hit = (scores >= limit[at][:, None]).any(1)
        at, scores = at[hit], scores[hit]
        if not len(at):
            continue
        both = np.hstack([best[at], scores])
        names = np.hstack([who[at], np.broadcast_to(ids[leaves[s]], scores.shape)])
        order = np.lexsort((names, -both), axis=1)[:, :k]
        best[at], who[at] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        limit[at] = np.maximum(limit[at], best[at, -1])
    i, j = np.nonzero((best > -np.inf) & (best >= kth[:, None]))
    return i, who[i, j], best[i, j]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 8, confidence: float = 0.95, sample: int = 16_384, seed: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the id and ``score`` (inner product) of each query's ``k`` found."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = stored(rows.where(usable(F.col("v")) & F.col("id").isNotNull()), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.max(norm).alias("m"), F.count("*").alias("n")).collect()
    parts = [_nearest(rows.where(F.size("v") == r["d"]), r["d"], r["m"], r["n"], k, dims, confidence, sample, seed) for r in sizes]
    none = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    out = none
    for part in parts:  # one for each length of vector
        out = out.unionAll(part)
    return out.withColumnRenamed("id", id_col)


def _nearest(rows: DataFrame, d: int, norm2: float, n: int, k: int, dims: int, confidence: float, sample: int, seed: int) -> DataFrame:
    spark = rows.sparkSession
    w = np.random.default_rng(seed).normal(size=(d + 1, dims))
    far = stop_at(dims, confidence)

    def project(x: np.ndarray, query: bool) -> np.ndarray:
        added = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, norm2 - (x * x).sum(1)))
        return x @ w[:d] + added[:, None] * w[d]

    drawn = least_hashed(rows, "id", sample, n).select("v").collect()  # bounded: the splits of the upper levels
    boxes = 1 << max(0, min(MAX_BOXES, max(1, n // BOX_ROWS)).bit_length() - 1)
    nodes = spark.sparkContext.broadcast(upper_tree(project(np.array([r["v"] for r in drawn]), False), boxes))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def boxed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(box_of(project(matrix(batch.column(1)), query), nodes.value))], ["id", "v", "box"])

        return run

    data = stored(rows.select("id", "v").mapInArrow(boxed(False), "id long, v array<double>, box long"), "boxed")
    # boxes that many equal vectors overfill are split by hash, so that a task holds 2 x BOX_ROWS rows or so
    salts = F.broadcast(data.groupBy("box").agg(F.ceil(F.count("*") / (2 * BOX_ROWS)).alias("salts")))  # MAX_BOXES rows at most
    data = data.join(salts, "box").withColumn("chunk", F.col("box") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), F.col("salts")))

    def sealed(chunk: pa.Table) -> pa.Table:
        x = matrix(chunk.column("v").combine_chunks())
        ids = chunk.column("id").to_numpy()
        p = project(x, False)
        cells = {"low": p.min(0), "high": p.max(0)}
        return pa.table({
            "chunk": chunk.column("chunk")[:1], "box": chunk.column("box")[:1],
            **{c: pa.array([v.tolist()], pa.list_(pa.float64())) for c, v in cells.items()},
            "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()),
        })

    chunks = stored(data.select("chunk", "box", "id", "v").groupBy("chunk").applyInArrow(sealed, "chunk long, box long, low array<double>, high array<double>, ids binary, x binary"), "chunks")
    queries = stored(rows.where("is_query").select("id", "v").mapInArrow(boxed(True), "id long, v array<double>, box long"), "queries")
    found = "query_id long, id long, score double"
    n_query_blocks = max(1, math.ceil(n / 20 / QUERY_BLOCK))

    def visit(pairs: DataFrame) -> DataFrame:
        """pairs: chunk, query (id, v, kth). A task has one chunk and a bounded block of its queries."""
        pairs = pairs.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(n_query_blocks)))
        needed = pairs.select(F.col("chunk").alias("c"), F.col("deal").alias("e")).distinct().join(chunks.select(F.col("chunk").alias("c"), "ids", "x"), "c")

        def searched(qs: pa.Table, cs: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if qs.num_rows:
                qids, q, kth = qs.column("id").to_numpy(), matrix(qs.column("v").combine_chunks()), qs.column("kth").to_numpy()
                for ids, x in zip(cs.column("ids").to_pylist(), cs.column("x").to_pylist()):
                    ids, x = np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, d)
                    i, who, score = search(qids, q, project(q, True), kth, ids, x, project(x, False), far, norm2, k)
                    out.append((qids[i], who, score))
            a, b, c = (np.concatenate(z) for z in zip(*out))
            return pa.table({"query_id": a, "id": b, "score": c})

        return pairs.groupBy("chunk", "deal").cogroup(needed.groupBy("c", "e")).applyInArrow(searched, found)

    ends = chunks.select("chunk", "box", "low", "high")
    home = queries.join(ends.select("chunk", "box"), "box").select("chunk", "id", "v", F.lit(float("-inf")).alias("kth"))
    first = stored(visit(home), "found")
    kth = first.groupBy("query_id").agg(F.max_by("score", "score").alias("_"), F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1)[0].alias("kth")).drop("_")
    asked = queries.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", "box", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    summary = spark.sparkContext.broadcast([(r["chunk"], r["box"], r["low"], r["high"]) for r in ends.collect()])  # a few numbers a chunk

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, box = np.array([s[0] for s in summary.value]), np.array([s[1] for s in summary.value])
        low, high = np.array([s[2] for s in summary.value]), np.array([s[3] for s in summary.value])
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                q, kth_ = matrix(part.column(1)), part.column(3).to_numpy()
                d2 = np.maximum(norm2 + (q * q).sum(1) - 2 * kth_, 0)
                go = ~(box_gap(project(q, True), low, high) > far * d2[:, None] * (1 + 1e-12))
                go &= part.column(2).to_numpy()[:, None] != box[None]  # the home box has been searched
                i, c = np.nonzero(go)
                took = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(names[c]), took.column(0), took.column(1), took.column(3)], ["chunk", "id", "v", "kth"])

    rest = visit(stored(asked.mapInArrow(planned, "chunk long, id long, v array<double>, kth double"), "visits"))
    order = F.array_sort(F.transform(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id"))), lambda r: r))
    top = first.unionAll(rest).groupBy("query_id").agg(F.slice(order, 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("pos", "r")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("r.id").alias("id"), (-F.col("r.s")).alias("score"))
