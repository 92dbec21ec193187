"""Sets of shingles of many texts at once against plain sets; parities that stay useful for large sets."""

import random

import numpy as np
import pyarrow as pa
from docloom.llm import similar


def plain(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def test_sets_equal_plain_ones():
    r = random.Random(1)
    texts = ["".join(r.choice("aAbB \n\té 中\xa0\x0b") for _ in range(r.randrange(60))) for _ in range(2000)]
    texts += [None, "", " ", "x" * 70 + " Y", "X" * 70 + " y", "é" * 100, "a b c d e f " * 60_000]
    texts += ["q " * 10 + "z" * 900_000 + " b c", "Q " * 10 + "Z" * 900_000 + "\tB c"]
    for values in (pa.array(texts), pa.array(["zz", *texts, "u"]).slice(1, len(texts))):
        found, at = similar.shingle_sets(values, 5)
        names, sets = {}, {}
        for k, text in enumerate(texts):
            want, got = plain(text, 5), found[at[k] : at[k + 1]]
            assert len(want) == len(got) and (got[1:] > got[:-1]).all()
            assert names.setdefault(want, got.tobytes()) == got.tobytes() and sets.setdefault(got.tobytes(), want) == want


def test_large_sets_of_little_in_common_are_told_apart(spark):
    """With 512 bits, sets of 2,500 shingles could never be ruled out and both texts travelled."""
    r = np.random.default_rng(3)
    x, y = r.integers(0, 1 << 63, (2, 2500)).astype(np.uint64)
    near, far = np.r_[x[:2400], y[:100]], np.r_[x[:1250], y[:1250]]
    small = near[:2040]  # a parity of half as many bits
    rows = [(k, len(s), similar.parity(s).tolist()) for k, s in enumerate((x, near, far, y, small))]
    nodes = spark.createDataFrame(rows, "node long, size int, parity array<long>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 3), (1, 4)], "a long, b long")
    assert {tuple(p) for p in similar.may_be_similar(pairs, nodes, 0.8).collect()} == {(0, 1), (1, 4)}
