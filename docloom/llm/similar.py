"""Groups of similar documents: word shingles with an exact Jaccard similarity (pipeline stage).

An exact similarity join by prefixes. Shingles have one order for all documents: rare ones first, those that are
frequent in a bounded sample last (the sample only orders, it never decides). Two sets of a similarity of ``least`` or
more share a shingle among the first ``size - ceil(least * size) + 1`` of each, and where the first such shingle stands
bounds how many they can share. So documents meet by equal shingles of their prefixes, and what passes the bounds
of size and place is decided by the exact similarity of the two whole sets: no pair at the bound or above is lost,
none below it is linked. Before texts are shipped, their parities are compared: each shingle flips one of 512 bits (of a large
set up to 16,384), so two sets differ in at least as many shingles as their parities differ in bits.

Documents of equal shingle sets are one node, so copies never meet each other. Where up to four nodes share a shingle
all pairs are tried. Where more do, the node that meets most others over all its shingles is held against the rest; nodes
that are in one component by then need no further comparison. Of a shingle whose nodes are in several, all pairs across are tried
up to 32 nodes; a larger one goes on with leaders, four times as many a round: only a leader, held against all others of the
shingle, leaves it, until one component or no node is left. Shingles travel as 32 bits; that two share them only adds a comparison.
Rows of prefixes travel as blobs, dealt by ranges of shingles, and are sorted there; most shingles are met once and end there. Where
many nodes meet, 512 bits of their parities stand beside them, so that a pair these rule out is never made.

With ``radius`` SimHash fingerprints of at most that many differing bits (operator 9) are decided first, by the same
exact similarity; the join then finds what lies further apart.

Defined results: texts without words are one group; texts of fewer words than a shingle are one
shingle; a null id has a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import stored
from .components import components

#: Texts that the order of shingles is taken from, how often one occurs there to come late, and how many may.
SAMPLE, OFTEN, KNOWN = 24576, 3, 250_000
#: Parts that the shingles of the sample are counted in, a power of 2.
SPLIT = 256
#: Powers of 2: the least and the most bits of a set's parity.
BITS = (9, 14)
#: Numbers of 64 bits in the shortest parity.
LEAST_PARITY = 1 << BITS[0] - 6
#: Pairs of one node that are decided in one group.
TOGETHER = 64
#: Up to so many nodes of a shingle are compared where they are sorted.
FEW = 4
#: Nodes for each range of shingles that prefixes are dealt by.
RANGE = 1024
#: Texts are looked up by so many buckets of their hash before they are shuffled.
BUCKETS = 1 << 20


@cache
def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    flip, times = (r.integers(0, 1 << 32, (count, 1), np.uint32) for _ in range(2))
    return flip, times | np.uint32(1)


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of ``count`` permutations of 32-bit numbers over ``hashes`` folded to them: a sketch to estimate
    similarities by. The search for groups is exact and does not use it."""
    flip, times = permutations(count)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(count, (1 << 32) - 1, np.uint32)
    for k in range(0, len(folded), 512):  # bounded memory for very long texts
        mixed = folded[k : k + 512] ^ flip
        np.multiply(mixed, times, out=mixed)
        least = np.minimum(least, mixed.min(1))
    return least


#: Bytes that are hashed at once; longer words are hashed one by one.
PIECE, LONG_WORD = 1 << 18, 64
_MULTIPLIER = 0x9E3779B97F4A7C15 & ~7 | 5
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


@cache
def _letters() -> np.ndarray:
    """A random number for each byte, that of a-z also for A-Z."""
    of = np.random.default_rng(13).integers(0, 1 << 64, 256, np.uint64)
    of[65:91] = of[97:123]
    return of


@cache
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(found: np.ndarray) -> np.ndarray:
    found = (found ^ (found >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(29))


def _word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``raw`` begins and its 64-bit hash, A-Z lower-cased; ``starts``: places at which a text begins.

    A word is a polynomial of its bytes: sums of bytes times powers are taken once for all words and divided by the power at which the word begins."""
    inverse, n = pow(_MULTIPLIER, -1, 1 << 64), len(raw)
    begin = ~_BLANK[raw]
    end = begin.copy()
    cut = starts[(starts > 0) & (starts < n)]
    left, right = begin[cut], begin[cut - 1]
    begin[1:] &= ~end[:-1]
    end[:-1] &= _BLANK[raw[1:]]
    begin[cut], end[cut - 1] = left, right
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    count = 1 << max(n - 1, 1).bit_length()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_letters()[raw] * _powers(_MULTIPLIER, count)[:n], out=sums[1:])
    found = (sums[last] - sums[first]) * _powers(inverse, count)[first]
    for k in np.flatnonzero(last - first > LONG_WORD).tolist():
        found[k] = xxhash.xxh64_intdigest(raw[first[k] : last[k]].tobytes().lower())
    return first, _mixed(found)


def _words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_word_hashes` by pieces that end at a blank or where a text begins."""
    firsts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        stop = min(at + PIECE, len(raw))
        while stop < len(raw):
            blanks = np.flatnonzero(_BLANK[raw[at:stop]])
            if len(blanks):
                stop = at + int(blanks[-1]) + 1
                break
            stop = min(stop + PIECE, len(raw))
        inside = starts[np.searchsorted(starts, at) : np.searchsorted(starts, stop)]
        if stop - at <= 2 * PIECE:
            first, found = _word_hashes(raw[at:stop], inside - at)
            firsts.append(first + at)
            hashes.append(found)
        else:  # few words and a very long one
            for low, high in zip([at, *inside.tolist()], [*inside.tolist(), stop]):
                for word in raw[low:high].tobytes().lower().split():
                    long = len(word) > LONG_WORD
                    hashes.append(_mixed(np.array([xxhash.xxh64_intdigest(word)], np.uint64)) if long else _word_hashes(np.frombuffer(word, np.uint8), inside[:0])[1])
                    firsts.append(np.array([low]))
        at = stop
    return np.concatenate(firsts), np.concatenate(hashes)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the shingles of each text, sorted, one text after the other, and where each begins (and the last ends).
    A-Z are lower-cased, texts split at ASCII white space; a null text has no words."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    first, hashes = _words(raw, np.unique(bounds))
    ends = np.searchsorted(first, bounds)
    words = np.diff(ends)
    after = np.repeat(ends[1:], words) - np.arange(len(hashes))  # words from each on to the end of its text
    padded = np.r_[hashes, np.zeros(width, np.uint64)]
    mixed = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        mixed = np.where(after > k, (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(hashes)], mixed)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    whole = after >= width
    whole[ends[:-1][words > 0]] = True
    mixed = mixed[whole]
    at = np.r_[0, np.cumsum(np.minimum(words, np.maximum(1, words - width + 1)))]
    for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
        mixed[low:high].sort()
    new = np.ones(len(mixed), bool)
    new[1:] = mixed[1:] != mixed[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    return mixed[new], np.r_[0, np.cumsum(new)][at]


def frequent(docs: DataFrame, width: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (32 bits) that occur often in a sample of the texts, sorted, and how often."""
    rows = docs.count()
    text = F.col(text_col).cast("string")
    share = int(min(1.0, SAMPLE / max(rows, 1)) * (1 << 40))
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 40)) < share).select(text.alias("text")).distinct()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):
            token = np.sort(shingle_sets(batch.column(0), width)[0].astype(np.uint32))
            parts = np.split(token, np.searchsorted(token, np.arange(1, SPLIT, dtype=np.uint32) << np.uint32(32 - SPLIT.bit_length() + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(range(SPLIT), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "tokens"])

    def counted(rows: pa.Table) -> pa.Table:
        token, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("tokens").to_pylist()]), return_counts=True)
        often = n >= OFTEN
        return pa.table({"token": pa.array(token[often].astype(np.int64)), "n": pa.array(n[often], pa.int64())})

    often = sample.mapInArrow(listed, "part int, tokens binary").groupBy("part").applyInArrow(counted, "token long, n long")
    found = often.orderBy(F.desc("n"), "token").limit(KNOWN).toArrow()
    token, n = found.column("token").to_numpy().astype(np.uint32), found.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefixes(found: np.ndarray, at: np.ndarray, least: float, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles (32 bits) of each set in the order of all, and where each set's begin: one of these is shared with any set of a
    similarity of ``least`` or more."""
    n, token = np.diff(at), found.astype(np.uint32)
    wanted = np.minimum(n, n - np.ceil(least * n - 1e-6).astype(np.int64) + 1)
    if len(known[0]):
        some = np.zeros(1 << 22, bool)
        some[known[0] >> np.uint32(10)] = True
        maybe = np.flatnonzero(some[token >> np.uint32(10)])
        place = np.minimum(np.searchsorted(known[0], token[maybe]), len(known[0]) - 1)
        often = np.zeros(len(token), np.int64)
        often[maybe] = np.where(known[0][place] == token[maybe], known[1][place], 0)
        for k in np.unique(np.searchsorted(at, np.flatnonzero(often), "right") - 1).tolist():
            one = slice(at[k], at[k + 1])
            token[one] = token[one][np.argsort(often[one], kind="stable")]
    first = np.arange(len(token)) - np.repeat(at[:-1], n) < np.repeat(wanted, n)
    return token[first], np.r_[0, np.cumsum(wanted)]


def parity(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of the shingles falls on each bit, 64 bits a number: as many bits as shingles, rounded up to a power of 2, ``BITS`` at least and at most."""
    bits = 1 << min(max((len(found) - 1).bit_length(), BITS[0]), BITS[1])
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def sketches(docs: DataFrame, width: int, least: float, id_col: str, text_col: str, radius: int | None) -> DataFrame:
    """``id``, ``set`` (hash of the shingle set), ``size`` of the set, its ``prefix`` (numbers of 32 bits) and ``parity``, ``text_key`` and, with a radius, the fingerprint ``fp``."""
    known = frequent(docs, width, text_col)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):
            texts = [None if radius is None else t.as_py() for t in batch.column(2)]
            found, at = shingle_sets(batch.column(2), width)
            sets = [found[low:high] for low, high in zip(at[:-1].tolist(), at[1:].tolist())]
            odd = [parity(s) for s in sets]
            first, begins = prefixes(found, at, least, known)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer((begins * 4).astype(np.int32)), pa.py_buffer(first)]),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, odd)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *odd]))),
                    batch.column(1),
                    pa.array([None if radius is None else simhash.fingerprint(t) for t in texts], pa.int64()),
                ],
                ["id", "set", "size", "prefix", "parity", "text_key", "fp"],
            )

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, set long, size int, prefix binary, parity array<long>, text_key long, fp long"
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), text_key(text), text).mapInArrow(sketched, schema)


def folded(x: Column, n: Column) -> Column:
    """The parity over ``n`` numbers of one over n, 2 n, 4 n and so on."""
    parts = F.transform(F.sequence(F.lit(0), (F.size(x) / n).cast("int") - 1), lambda k: F.slice(x, k * n + 1, n))
    return F.when(F.size(x) == n, x).otherwise(F.aggregate(F.slice(parts, 2, F.size(parts)), parts[0], lambda s, p: F.zip_with(s, p, lambda a, b: a.bitwiseXOR(b))))


def most_apart(both: Column, least: float) -> Column:
    """In how many shingles two sets of a similarity of ``least`` or more can differ at most; ``both``: their sizes added."""
    return both - 2 * least / (1 + least) * both + 1e-6


def may_be_similar(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """``pairs`` without those whose sizes or parities rule the similarity out."""
    for c in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("parity").alias(f"{c}_parity")), c)
    n = F.least(F.size("a_parity"), F.size("b_parity"))
    differ = F.aggregate(F.zip_with(folded(F.col("a_parity"), n), folded(F.col("b_parity"), n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
    close = F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size") - 1e-9
    return pairs.where(close).where(differ <= most_apart(F.col("a_size") + F.col("b_size"), least)).select("a", "b")


def similar_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose shingle sets have a Jaccard similarity of ``least`` or more.

    Texts travel, not sets, which are larger: that of ``b`` to its pair, that of ``a`` once for about ``TOGETHER`` pairs."""
    same = Window.partitionBy("a")
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.count("*").over(same) / TOGETHER)).alias("part"))
    ends = dealt.select("a", "part", F.col("b").alias("node")).unionAll(dealt.select("a", "part", F.col("a").alias("node")).distinct())
    wanted = stored(nodes.select("node", "text_key").join(ends, "node"), "wanted")

    def decided(rows: pa.Table) -> pa.Table:
        found, at = shingle_sets(rows.column("text").combine_chunks(), width)
        sets = {node: found[at[k] : at[k + 1]] for k, node in enumerate(rows.column("node").to_pylist())}
        a = rows.column("a")[0].as_py()
        x, good = sets.pop(a), []
        for b, y in sets.items():
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int(np.count_nonzero(y[at] == x))
            if both >= least * (len(x) + len(y) - both) - 1e-9:
                good.append(b)
        return pa.table({"a": pa.array([a] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    bucket = lambda key: F.pmod(F.col(key), F.lit(BUCKETS))
    # at most BUCKETS numbers: they keep most other texts out of the shuffle, the join by the whole key follows
    some = wanted.select(bucket("text_key").alias("bucket")).distinct()
    once = texts.withColumn("bucket", bucket("text_key")).join(F.broadcast(some), "bucket", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    return once.join(wanted, "text_key").select("a", "part", "node", "text").groupBy("a", "part").applyInArrow(decided, "a long, b long")


def by_fingerprint(nodes: DataFrame, radius: int) -> DataFrame:
    """``a``, ``b``: pairs that join all nodes whose fingerprints a chain of steps of at most ``radius`` bits joins."""
    fps = stored(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    equal = nodes.join(fps.select("fp", F.col("node").alias("a")), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    return equal.unionAll(simhash.links(fps, radius).select(F.least("a", "b"), F.greatest("a", "b")))


_ROW = np.dtype([("token", "u4"), ("pos", "i4"), ("size", "i4"), ("node", "i8")])


def shared(nodes: DataFrame, least: float) -> DataFrame:
    """Rows of the prefixes whose shingle more than ``FEW`` nodes have (``token``, ``node``, ``size``, ``pos`` and ``n``, the number of these);
    of the other shingles the pairs ``node``, ``other`` that can be similar, with a null token. Shingles that one node has give nothing."""
    bits = max(SPLIT.bit_length() - 1, (nodes.count() // RANGE).bit_length())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(2)
            at = np.frombuffer(prefix.buffers()[1], np.int32, len(prefix) + 1, 4 * prefix.offset) // 4
            token = np.frombuffer(prefix.buffers()[2] or b"", np.uint32)[at[0] : at[-1]]
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            order = np.argsort(token)
            rows = np.empty(len(token), _ROW)
            rows["token"], rows["pos"] = token[order], (np.arange(len(token)) - (at[:-1] - at[0])[row])[order]
            rows["size"], rows["node"] = batch.column(1).to_numpy()[row[order]], batch.column(0).to_numpy()[row[order]]
            part, begin = np.unique(rows["token"] >> np.uint32(32 - bits), return_index=True)
            bounds = (np.r_[begin, len(rows)] * _ROW.itemsize).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(bounds), pa.py_buffer(rows.tobytes())])], ["part", "rows"])

    def met(blobs: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, _ROW) for x in blobs.column("rows").to_pylist()])
        token = np.sort(rows["token"])
        again = np.unique(token[1:][token[1:] == token[:-1]])
        if len(again):
            place = np.minimum(np.searchsorted(again, rows["token"]), len(again) - 1)
            rows = rows[again[place] == rows["token"]]
        else:
            rows = rows[:0]
        token, node, size, pos = (np.ascontiguousarray(rows[c]) for c in ("token", "node", "size", "pos"))
        order = np.lexsort((node, token))
        token, node, size, pos = token[order], node[order], size[order].astype(np.int64), pos[order].astype(np.int64)
        begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        n = np.repeat(np.diff(np.r_[begin, len(token)]), np.diff(np.r_[begin, len(token)]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(1, FEW):
            x = np.flatnonzero((token[k:] == token[:-k]) & (n[k:] <= FEW))
            y = x + k
            most, both = np.minimum(size[x] - pos[x], size[y] - pos[y]), size[x] + size[y]
            fit = (np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y]) - 1e-9) & (most >= least / (1 + least) * both - 1e-6)
            a.append(node[x[fit]])
            b.append(node[y[fit]])
        a, b = np.concatenate(a), np.concatenate(b)
        many = n > FEW
        none = lambda kind: pa.nulls(len(a), kind)
        kinds = {"token": (token.view(np.int32), pa.int32()), "size": (size, pa.int32()), "pos": (pos, pa.int32()), "n": (n, pa.int64())}
        out = {c: pa.chunked_array([pa.array(x[many]).cast(kind), none(kind)]) for c, (x, kind) in kinds.items()}
        return pa.table(out | {"node": pa.array(np.r_[node[many], a]), "other": pa.chunked_array([pa.nulls(int(many.sum()), pa.int64()), pa.array(b, pa.int64())])})

    return nodes.select("node", "size", "prefix").mapInArrow(dealt, "part int, rows binary").groupBy("part").applyInArrow(met, "token int, size int, pos int, n long, node long, other long")


def links(nodes: DataFrame, texts: DataFrame, least: float, width: int, radius: int | None = None) -> DataFrame | None:
    """``node`` and ``component`` of all ``nodes`` (``node``, ``size``, ``prefix``, ``parity`` and ``text_key``, a row each) that are similar to another."""

    def fits(x: Column, y: Column) -> Column:
        """Whether two rows of a shingle can be similar, by their sizes, by what stands behind the shingle in each and by parts of their parities."""
        most, both = F.least(x["size"] - x["pos"], y["size"] - y["pos"]), x["size"] + y["size"]
        differ = reduce(lambda s, d: s + d, [F.bit_count(x["part"][k].bitwiseXOR(y["part"][k])) for k in range(LEAST_PARITY)])
        return (F.least(x["size"], y["size"]) >= least * F.greatest(x["size"], y["size"]) - 1e-9) & (most >= least / (1 + least) * both - 1e-6) & (differ <= most_apart(both, least))

    tried, found, named, merged = [], [], None, 0

    def decide(pairs: DataFrame) -> None:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried:
            pairs = pairs.join(reduce(DataFrame.unionAll, tried), ["a", "b"], "left_anti")
        new = stored(may_be_similar(stored(pairs, "pairs"), nodes, least), "tried")
        if not new.isEmpty():
            tried.append(new)
            found.append(stored(similar_pairs(new, nodes, texts, least, width), "links"))

    def together(rows: DataFrame) -> DataFrame:
        nonlocal named, merged
        if len(found) > merged:
            named, merged = components(reduce(DataFrame.unionAll, found)), len(found)
        return rows.withColumn("component", F.col("node")) if named is None else rows.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))

    if radius is not None:
        decide(by_fingerprint(nodes, radius))
    rows = stored(shared(nodes, least), "shared")
    rest = rows.where("token is not null").select("token", "node", "size", "pos", "n")
    with_parity = rest.groupBy("node").agg(F.sum("n").alias("met")).join(nodes.select("node", folded(F.col("parity"), F.lit(LEAST_PARITY)).alias("part")), "node")
    rest = stored(rest.drop("n").join(with_parity, "node"), "large")
    # in large ones the node that meets most others comes first
    centre = rest.groupBy("token").agg(F.max(F.struct("met", "node", "size", "pos", "part")).alias("lead"))
    star = rest.join(centre, "token").where(F.col("node") != F.col("lead.node")).where(fits(F.struct("size", "pos", "part"), F.col("lead")))
    decide(rows.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).unionAll(star.select(F.col("lead.node"), F.col("node"))))
    leaders, same = 1, Window.partitionBy("token")
    while True:
        here = together(rest).select("token", F.struct("node", "size", "pos", "part", "component", "met").alias("row"), F.count("*").over(same).alias("n"), F.min("component").over(same).alias("low"), F.max("component").over(same).alias("high"))
        here = here.where("low <> high").select("token", "row", (F.col("n") <= 32 * leaders).alias("small"), F.pmod(F.xxhash64("row.node", "token"), "n").alias("draw"))
        here = stored(here.select("token", "row", (F.col("small") | (F.col("draw") < leaders)).alias("leads")), "buckets")
        if here.isEmpty():
            return named
        lead = here.where("leads").select("token", F.col("row").alias("lead"))
        other = (F.col("lead.node") < F.col("row.node")) | ~F.col("leads")
        pairs = lead.join(here, "token").where(other & (F.col("row.component") != F.col("lead.component")) & fits(F.col("row"), F.col("lead")))
        decide(pairs.select(F.col("lead.node").alias("a"), F.col("row.node").alias("b")))
        rest = here.where("not leads").select("token", "row.node", "row.size", "row.pos", "row.part", "row.met")
        if rest.isEmpty():
            together(rest)
            return named
        leaders *= 4


def groups(docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """Per document: its id and ``component_id``, the smallest id reachable over pairs of a Jaccard
    similarity of ``least`` (above 0) or more on shingles of ``width`` words."""
    sketched = stored(sketches(docs, width, least, id_col, text_col, radius), "sketches")
    nodes = sketched.where("id is not null").groupBy("set").agg(F.min("id").alias("id"), F.first(F.struct("size", "prefix", "parity", "text_key", "fp")).alias("one"))
    # numbered before they are stored: small numbers make small shuffles
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "set", "id", "one.*"), "nodes")
    text = F.col(text_col).cast("string")
    named = links(nodes, docs.select(text_key(text).alias("text_key"), text.alias("text")), least, width, radius)
    own = nodes.select("node", "set", "id")
    if named is None:
        named = own.select("set", F.col("id").alias("component_id"))
    else:
        own = stored(own.join(named, "node", "left").select("set", "id", F.coalesce("component", "node").alias("component")), "named")
        smallest = own.groupBy("component").agg(F.min("id").alias("component_id"))
        named = stored(own.join(smallest, "component").select("set", "component_id"), "named")
    out = sketched.select("id", "set").join(named, "set", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
