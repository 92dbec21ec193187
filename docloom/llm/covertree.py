"""Embedding near-duplicates by dual traversal of cover trees (operator 2).

Equal vectors are one weighted point. Points are dealt to blocks of bounded size, by nearest pivot
of a bounded sample and by hash within a pivot's cell; each block becomes a cover tree whose nested
levels halve their radius. Block pairs, and within them node pairs, are pruned where the distance
of their centres exceeds both covering radii and the threshold; where it stays below the threshold
by both radii, all their pairs are links without being listed. What is left is verified on the
vectors in double precision. A block pair returns counts and a spanning forest of its links, so a
group of thousands of near copies costs rows in proportion to its size.

Blocks lie in packs of some megabytes, written once. Packs meet as a product of the stored files, each
task reading those of two parts, so that no vector is copied for the blocks that it meets: a vector is
shuffled once and written once, whatever the number of blocks. Ids find their point by two 64-bit hashes
of the vector, which alone travel for that.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link
with nothing (0 links, their own component); vectors link only with others of their length; a null
id has a null component and no links.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import least_hashed, stored
from .components import components

SLACK = 1e-6  # rounding of distances is far below it; what lies within is verified
LEAF = 32


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null, NaN or infinite component, and not all zero."""
    good = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of single-precision unit vectors whose product may be ``least`` or more, and the product
    raised by what rounding may take from it; rows of ``a`` in turns, so that products stay in the cache."""
    rounding = (a.shape[1] + 4) * 2.0**-24
    step = max(1, (1 << 19) // max(1, len(b)))
    for at in range(0, len(a), step):
        dots = (a[at : at + step] @ b.T).ravel()
        k = np.flatnonzero(dots >= np.float32(least - 2 * rounding))
        if len(k):
            yield k // len(b) + at, k % len(b), dots[k] + rounding


def build(x: np.ndarray, f: np.ndarray, top: float = 2.0) -> dict[str, np.ndarray]:
    """Cover tree over unit vectors (``f``: in single precision): ``order`` of points, and per node its points
    lo..hi in that order, its centre (a point; also the centre of its first child), covering radius and children.

    The levels below the root start at the largest radius 2**-k of at most ``top``: wider nodes of
    vectors in many dimensions reach all others, so that splitting them one by one prunes nothing."""
    n = len(x)
    order = np.arange(n)
    lo, hi, centre, radius, child, children = [0], [n], [0], [0.0], [0], [0]
    todo = deque([0])
    while todo:
        k = todo.popleft()
        points = order[lo[k] : hi[k]]
        d = np.sqrt(np.maximum(0, 2 - 2 * (x[points] @ x[centre[k]])))
        radius[k] = float(d.max())
        if len(points) <= LEAF and radius[k] < 1 or radius[k] <= SLACK or len(points) == 1:
            continue
        r = 2.0
        while r >= radius[k] or r > top:
            r /= 2
        child[k], at = len(lo), lo[k]
        c = int(np.flatnonzero(points == centre[k])[0])
        crowded = np.zeros(len(points), bool)  # points with others in their reach; the rest are nodes of their own
        for i, j, _ in near(f[points], f[points], 1 - (r + SLACK) ** 2 / 2):
            crowded[i[i != j]] = True
        crowded[c] = True
        left, own, groups = np.flatnonzero(crowded), d[crowded], []
        while len(left):
            close = own <= r
            close |= left == c
            groups.append((points[c], points[left[close]]))
            left = left[~close]
            if len(left):
                c = int(left[0])
                own = np.sqrt(np.maximum(0, 2 - 2 * (x[points[left]] @ x[points[c]])))
        groups += [(q, [q]) for q in points[~crowded].tolist()]
        children[k] = len(groups)
        for c, members in groups:
            order[at : at + len(members)] = members
            lo.append(at)
            at += len(members)
            hi.append(at)
            centre.append(int(c))
            radius.append(0.0)
            child.append(0)
            children.append(0)
            if len(members) > 1:
                todo.append(len(lo) - 1)
    return {"order": order, "lo": np.array(lo), "hi": np.array(hi), "centre": np.array(centre), "radius": np.array(radius), "child": np.array(child), "children": np.array(children)}


def dual(xa: np.ndarray, fa: np.ndarray, ta: dict, xb: np.ndarray, fb: np.ndarray, tb: dict, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between two blocks (each pair once; within one block if ``same``): weighted link counts
    of the points of either, and links (i, j) that connect what is linked."""
    eps = float(np.sqrt(2 - 2 * cosine))
    na, nb = np.zeros(len(xa)), np.zeros(len(xb))
    links_i, links_j = [], []
    todo = [(0, 0)]

    def parts(t: dict, k: int) -> np.ndarray:
        return np.arange(t["child"][k], t["child"][k] + t["children"][k]) if t["children"][k] else np.array([k])

    def alone(t: dict, nodes: np.ndarray) -> list[tuple[np.ndarray, bool]]:
        one = t["hi"][nodes] - t["lo"][nodes] == 1
        return [(part, single) for part, single in ((nodes[one], True), (nodes[~one], False)) if len(part)]

    def linked(i: np.ndarray, j: np.ndarray) -> None:
        links_i.append(i)
        links_j.append(j)

    while todo:
        a, b = todo.pop()
        pa_, pb = ta["order"][ta["lo"][a] : ta["hi"][a]], tb["order"][tb["lo"][b] : tb["hi"][b]]
        own = same and a == b
        gap = float(np.sqrt(max(0.0, 2 - 2 * float(xa[ta["centre"][a]] @ xb[tb["centre"][b]])))) if not own else 0.0
        reach = ta["radius"][a] + tb["radius"][b]
        if gap > reach + eps + SLACK:
            continue
        if gap + reach <= eps - SLACK:
            if own:
                na[pa_] += wa[pa_].sum() - wa[pa_]
                linked(pa_[1:], np.full(len(pa_) - 1, pa_[0]))
            else:
                na[pa_] += wb[pb].sum()
                nb[pb] += wa[pa_].sum()
                linked(pa_, np.full(len(pa_), pb[0]))
                linked(np.full(len(pb) - 1, pa_[0]), pb[1:])
            continue
        if not ta["children"][a] and not tb["children"][b]:
            close = xa[pa_] @ xb[pb].T >= cosine
            if own:
                close = np.triu(close, 1)
            i, j = np.nonzero(close)
            if len(i):
                i, j = pa_[i], pb[j]
                np.add.at(na, i, wb[j])
                np.add.at(nb, j, wa[i])
                linked(i, j)
            continue
        for ca, one_a in alone(ta, parts(ta, a)):
            for cb, one_b in alone(tb, parts(tb, b)):
                if own and one_b and not one_a:
                    continue  # met the other way round
                ra, rb = ta["radius"][ca], tb["radius"][cb]
                widest = ra.max() + rb.max() + eps + SLACK
                for i, j, dots in near(fa[ta["centre"][ca]], fb[tb["centre"][cb]], 1 - min(widest, 2.0) ** 2 / 2 - SLACK):
                    if own and one_a == one_b:
                        keep = i < j if one_a else i <= j
                        i, j, dots = i[keep], j[keep], dots[keep]
                    if one_a and one_b:
                        for at in range(0, len(i), 1 << 15):
                            one, two = ta["centre"][ca[i[at : at + (1 << 15)]]], tb["centre"][cb[j[at : at + (1 << 15)]]]
                            sure = (xa[one] * xb[two]).sum(1) >= cosine
                            one, two = one[sure], two[sure]
                            np.add.at(na, one, wb[two])
                            np.add.at(nb, two, wa[one])
                            linked(one, two)
                    else:
                        keep = np.sqrt(np.maximum(0, 2 - 2 * dots)) <= ra[i] + rb[j] + eps + SLACK
                        todo.extend(zip(ca[i[keep]].tolist(), cb[j[keep]].tolist()))
    none = [np.zeros(0, int)]
    return na, nb, np.concatenate(links_i or none), np.concatenate(links_j or none)


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the links."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_TREE = {"order": np.int32, "lo": np.int32, "hi": np.int32, "centre": np.int32, "radius": np.float64, "child": np.int32, "children": np.int32}
_CELLS = ("dims", "sizes", "nodes", "ids", "w", "v", *_TREE)
_PACK = "pack long, " + ", ".join(f"{k} binary" for k in _CELLS)


def _pack(rows: pa.Table, kind: type, top: float) -> pa.Table:
    """One row for a pack: the distinct points of its blocks and their trees, one after the other. Rows of equal vectors
    are one point of the least id."""
    found: dict[str, list] = {k: [] for k in _CELLS}
    blocks, copies, ids = (rows.column(c).to_numpy() for c in ("block", "copies", "node"))
    for block in np.unique(blocks):
        at = np.flatnonzero(blocks == block)
        v, first, which = np.unique(np.array(rows.column("v").take(pa.array(at)).to_pylist(), object), return_index=True, return_inverse=True)
        least = np.full(len(v), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[at])
        by_id = np.argsort(least, kind="stable")
        x = np.frombuffer(b"".join(v[by_id]), kind).reshape(len(v), -1)
        u = unit(x.astype(float))
        tree = build(u, u.astype(np.float32), top)
        cells = {"dims": np.array([x.shape[1]]), "sizes": np.array([len(x)]), "nodes": np.array([len(tree["lo"])]), "ids": least[by_id], "w": np.bincount(which, copies[at]).astype(np.int64)[by_id], "v": x, **tree}
        for k, part in cells.items():
            found[k].append(np.ascontiguousarray(part, _TREE.get(k)).tobytes())
    return pa.table({"pack": rows.column("pack")[:1], **{k: pa.array([b"".join(parts)], pa.binary()) for k, parts in found.items()}})


def _blocks(row: dict, kind: type) -> list[tuple]:
    """Per block of a pack: its ids, weights, unit vectors in double and single precision and its tree."""
    kinds = {"v": kind, **_TREE}
    d = {k: np.frombuffer(row[k], kinds.get(k, np.int64)) for k in _CELLS}
    out, point, node, value = [], 0, 0, 0
    for dim, size, nodes in zip(d["dims"].tolist(), d["sizes"].tolist(), d["nodes"].tolist()):
        x = unit(d["v"][value : value + size * dim].reshape(size, dim).astype(float))
        tree = {k: d[k][point : point + size] if k == "order" else d[k][node : node + nodes] for k in _TREE}
        out.append((d["ids"][point : point + size], d["w"][point : point + size].astype(float), x, x.astype(np.float32), tree))
        point, node, value = point + size, node + nodes, value + size * dim
    return out


def _pairs(batches: Iterator[pa.RecordBatch], cosine: float, kind: type) -> Iterator[pa.RecordBatch]:
    """For each pair of packs: the points with links between them, their weighted number and a point they are connected to."""
    last: dict[str, tuple[int, list]] = {}  # a product keeps one side for several rows

    def read(batch: pa.RecordBatch, k: int, side: str) -> list:
        pack = batch.column(f"{side}_pack")[k].as_py()
        if side not in last or last[side][0] != pack:
            last.pop(side, None)
            last[side] = pack, _blocks({c: batch.column(f"{side}_{c}")[k].as_py() for c in _CELLS}, kind)
        return last[side][1]

    for batch in batches:
        for k in range(batch.num_rows):
            same = batch.column("a_pack")[k].as_py() == batch.column("b_pack")[k].as_py()
            one = read(batch, k, "a")
            two = one if same else read(batch, k, "b")
            ids = np.concatenate([block[0] for block in (one if same else [*one, *two])])
            from_a = np.cumsum([0, *(len(block[0]) for block in one)])
            from_b = from_a if same else from_a[-1] + np.cumsum([0, *(len(block[0]) for block in two)])
            n, ends_i, ends_j = np.zeros(len(ids)), [np.zeros(0, int)], [np.zeros(0, int)]
            for p, (_, wa, xa, fa, ta) in enumerate(one):
                for q, (_, wb, xb, fb, tb) in enumerate(two):
                    if xa.shape[1] != xb.shape[1] or same and q < p:
                        continue
                    itself = same and p == q
                    na, nb, i, j = dual(xa, fa, ta, xb, fb, tb, wa, wb, cosine, itself)
                    if len(i):
                        n[from_a[p] : from_a[p + 1]] += na
                        n[from_b[q] : from_b[q + 1]] += nb
                        at = np.arange(len(xa)) + from_a[p] if itself else np.r_[np.arange(len(xa)) + from_a[p], np.arange(len(xb)) + from_b[q]]
                        label = least_labels(len(at), i, j if itself else j + len(xa))
                        moved = np.flatnonzero(label != np.arange(len(at)))
                        ends_i.append(at[moved])
                        ends_j.append(at[label[moved]])
            touched = np.flatnonzero(n > 0)
            if len(touched):
                label = least_labels(len(ids), np.concatenate(ends_i), np.concatenate(ends_j))
                yield pa.RecordBatch.from_arrays([pa.array(ids[touched]), pa.array(n[touched].astype(np.int64)), pa.array(ids[label[touched]])], ["node", "n", "root"])


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 2048, sample: int = 4096, pack_mb: float = 12) -> DataFrame:
    """Per vector: its id, ``n_links`` (other vectors at ``cosine`` or more) and ``component_id``
    (smallest id reachable). ``sample``: vectors among which the pivots are chosen; ``pack_mb``: vectors
    that are read as one row, by their size."""
    spark, eps = vectors.sparkSession, float(np.sqrt(2 - 2 * cosine))
    single = vectors.schema[vector_col].dataType == ArrayType(FloatType())
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    good = usable(F.col("v")) & F.col("_id").isNotNull()
    keys = stored(rows.select("_id", F.when(good, F.xxhash64("v")).alias("h"), F.when(good, F.xxhash64(F.lit(1), "v")).alias("g")), "keys")
    n = keys.where("h is not null").count()
    pivots: dict[int, dict] = {}
    for r in least_hashed(rows.where(good), "_id", sample, n).collect():
        pivots.setdefault(len(r["v"]), {})[tuple(r["v"])] = None
    wanted = max(1, min(256, n // (2 * block_rows)))
    chosen = {d: unit(np.array(list(v)))[: max(1, wanted * len(v) // max(1, sum(map(len, pivots.values()))))] for d, v in pivots.items()}
    shared = spark.sparkContext.broadcast(chosen)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct vectors of a batch as bytes, their number, least id and cell."""
        for batch in batches:
            lists, ids = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            sizes = np.array(lists.value_lengths())
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), int(d)) + kind(0)
                _, first, which = np.unique(x.view(f"V{x.itemsize * int(d)}").ravel(), return_index=True, return_inverse=True)
                least = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(least, which, ids[at])
                x = x[first]
                cell = np.argmax(unit(x.astype(float)) @ shared.value[d].T, 1) if d in shared.value else np.zeros(len(x), int)
                cells = [pa.array([v.tobytes() for v in x], pa.binary()), pa.array(least), pa.array(np.bincount(which)), pa.array(cell + int(d) * 1024)]
                yield pa.RecordBatch.from_arrays(cells, ["v", "node", "copies", "cell"])

    points = rows.where(good).select("v", F.col("_id").cast("long").alias("node")).mapInArrow(celled, "v binary, node long, copies long, cell long")
    blocks, salts, dims = 0, [], [1]
    for cell, count in sorted(map(tuple, points.groupBy("cell").count().collect())):  # 256 cells a length at most
        salts.append((cell, blocks, -(-count // block_rows)))
        blocks += salts[-1][2]
        dims.append(cell // 1024)
    together = max(1, min(int(pack_mb * 1e6) // (block_rows * max(dims) * np.dtype(kind).itemsize), -(-blocks // 12)))
    salted = points.join(F.broadcast(spark.createDataFrame(salts, "cell long, first long, salts long")), "cell")
    salted = salted.withColumn("block", F.col("first") + F.pmod(F.xxhash64("v"), F.col("salts")))
    packed = salted.select(F.floor(F.col("block") / together).alias("pack"), "block", "node", "copies", "v").repartition(max(1, -(-blocks // together)), "pack")
    packs = stored(packed.groupBy("pack").applyInArrow(lambda rows: _pack(rows, kind, eps / 2), _PACK), "packs", "zstd")
    a, b = (packs.select(*(F.col(c).alias(f"{side}_{c}") for c in packs.columns)) for side in "ab")
    once = (F.col("a_pack") < F.col("b_pack")) == ((F.col("a_pack") + F.col("b_pack")) % 2 == 0)  # either (a, b) or (b, a): the parts of a product share the work
    met = a.hint("shuffle_replicate_nl").join(b, (F.col("a_pack") == F.col("b_pack")) | once)
    found = stored(met.mapInArrow(lambda batches: _pairs(batches, cosine, kind), "node long, n long, root long"), "links")
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    same = keys.where("h is not null").groupBy("h", "g").agg(F.min("_id").cast("long").alias("node"), F.count("*").alias("copies"))
    named = same.join(counts, "node", "left").join(linked, "node", "left")
    named = named.select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = keys.where("h is not null").join(named, ["h", "g"]).select("_id", "n_links", "component_id")
    rest = keys.where("h is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").cast("long").alias("component_id"))
    return out.unionAll(rest).withColumnRenamed("_id", id_col)
