"""Near-duplicates of the pipeline against exact Jaccard similarities of 5-word shingles."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from docloom.llm import covertree, similar, simhash


def shingles(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def edited(words: list[str], edits: int, r: random.Random) -> list[str]:
    out = list(words)
    for at in r.sample(range(len(out)), edits):
        out[at] = f"new{r.randrange(10**6)}"
    return out


def corpus() -> list[tuple]:
    r = random.Random(5)
    texts: list[str] = []
    for k in range(60):  # edits of one text, about the bound of 0.8 and on both sides of it
        base = [f"w{r.randrange(5000)}" for _ in range(220)]
        texts += [" ".join(base), *(" ".join(edited(base, n, r)) for n in (1, 3, 6, 12))]
    hot = [f"h{k}" for k in range(300)]
    texts += [" ".join(edited(hot, 2, r)) for _ in range(90)]  # one large group of near copies
    mixed = [f"m{k}" for k in range(150)]
    texts += [" ".join([*mixed, *(f"x{r.randrange(10**6)}" for _ in range(60))]) for _ in range(60)]  # one passage, no pair at 0.8
    texts += ["a b c", "A  b c", "a b d", "", " ", texts[0]]
    return [(100 + k, t) for k, t in enumerate(texts)]


def components_of(rows: list[tuple]) -> dict:
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    a, b = np.array(pairs).T
    label = covertree.least_labels(len(rows), np.r_[a, b], np.r_[b, a])
    return {rows[k][0]: rows[c][0] for k, c in enumerate(label.tolist())}


def test_near_duplicate_stage_is_exact(spark):
    rows = corpus()
    want = components_of(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == set(want.values())
    assert {r["doc_id"]: r["component_id"] for r in similar.groups(docs).collect()} == want


def test_ids(spark):
    t = "one two three four five six seven"
    docs = spark.createDataFrame([(None, t), (9, t), (9, t), (9, "eight nine ten"), (4, t.upper()), (12, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in similar.groups(docs).collect()), key=repr)
    assert got == sorted([(None, None), (9, 4), (9, 4), (9, 9), (4, 4), (12, 12)], key=repr)


def test_bands_find_pairs_at_the_bound():
    r = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        x = r.integers(0, 1 << 63, 200).astype(np.uint64)
        a, b = similar.minima(x[:180], 100).reshape(20, 5), similar.minima(x[20:], 100).reshape(20, 5)  # 160 of 200
        met += (a == b).all(1).any()
    assert met >= 298


def test_fingerprints_are_unchanged():
    assert simhash.fingerprint("a b c d e f") == simhash.fingerprint("A b  c d e f") != 0 == simhash.fingerprint(" ")
