"""No link at the bound or above is lost, also where bands of minima would lose it."""

import random

from docloom.llm import similar
from test_similar import shingles


def similarity(x: str, y: str) -> float:
    a, b = shingles(x), shingles(y)
    return len(a & b) / len(a | b)


def texts() -> list[str]:
    r = random.Random(7)
    core = [f"c{k}" for k in range(120)]  # one passage that all of these share; only the two of a pair share more
    out = []
    for k in range(40):
        own = [f"p{k}-{n}" for n in range(100)]
        out += [" ".join([*core, *own, *(f"x{r.randrange(10**9)}" for _ in range(60))]) for _ in range(2)]
    return out


def test_pairs_at_a_low_bound(spark):
    """Similarities of 0.63 within a pair and 0.26 between pairs; bands of five minima find most, but not all."""
    rows = list(enumerate(texts()))
    assert similarity(rows[0][1], rows[1][1]) >= 0.6 > similarity(rows[0][1], rows[2][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(docs, least=0.6).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}


def test_fingerprints_first_change_nothing(spark):
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*base[:200], *([f"e{k}"] if k else []), *base[200:]])) for k in range(30)] + [(50, " ".join(base[:340])), (51, " ".join(base[:300])), (52, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, first = ({r["doc_id"]: r["component_id"] for r in similar.groups(docs, radius=radius).collect()} for radius in (None, 4))
    assert plain == first == {**{k: 0 for k in range(30)}, 50: 0, 51: 0, 52: 52}


def test_a_passage_of_many_texts_makes_no_pairs(spark, monkeypatch):
    """All pairs of the texts that share it were made, stored and compared with those tried before."""
    made, keep = [], similar.may_be_similar
    monkeypatch.setattr(similar, "SAMPLE", 0)  # no order to push the passage out of the prefixes
    monkeypatch.setattr(similar, "may_be_similar", lambda pairs, *rest: made.append(pairs.count()) or keep(pairs, *rest))
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string"), least=0.6).collect()}
    assert got == {k: k - k % 2 for k, _ in rows} and sum(made) < 200
