"""The training-data operators against brute force, on edge cases."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import ann, bpe, components, covertree, langid, lm, packing, quality, simhash, token_counts, warc
from docloom.llm.common import shared_dir, stored

TEXTS = [None, "", " ", "\n\t", "Hello world hello", "a" * 300, "été ÜBER ß 漢字 😀\u0085x\u001c", "it's 12345 !!! <|endoftext|> x", "one two three four five " * 40, "one two three four five " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_bpe_is_the_library(spark, docs):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        assert list(got[i]["ids"]) == enc.encode_ordinary(text or "")
        assert bytes(got[i]["decoded"] or b"") == (text or "").encode()
    assert bpe.digests(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_token_counts_are_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path, memo_words=3).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}


def test_simhash_components(spark):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefgh") * 3 for _ in range(30)) for _ in range(20)]
    texts = [None, "", "  ", "x"] + base + [b + " zz" for b in base] + base[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = np.array([simhash.fingerprint(t) for t in texts]).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    want = covertree.least_labels(len(texts), i, j).tolist()
    for blocks in (1, 2):
        got = simhash.near_duplicates(docs, blocks=blocks).orderBy("doc_id").collect()
        assert [x["component_id"] for x in got] == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 8))
    rows = [*x, *(x[:20] + 0.05), *x[:5], *[x[0] + 1e-4 * k for k in range(40)]]
    rows = [v.tolist() for v in rows] + [None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, [1.0, 2.0]]
    return rows, spark.createDataFrame([(i, v, "c") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, v string")


def test_cover_tree_is_exact(spark):
    rows, df = vectors(spark)
    n = 125
    u = np.array(rows[:n])
    u /= np.linalg.norm(u, axis=1)[:, None]
    i, j = np.nonzero(u @ u.T >= 0.9)
    label, links = covertree.least_labels(n, i, j), np.bincount(i, minlength=n) - 1
    got = covertree.near_duplicates(df, block_rows=16).orderBy("vec_id").collect()
    assert len(got) == len(rows)
    assert [g["n_links"] for g in got] == links.tolist() + [0] * 6
    assert [g["component_id"] for g in got] == label.tolist() + list(range(n, len(rows)))


def test_nearest_neighbours(spark):
    rows, df = vectors(spark)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()
    x = np.array(rows[:125])
    hits = 0
    for q in range(0, 125, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({g["vec_id"] for g in got if g["query_id"] == q} & set(np.lexsort((np.arange(125), -s))[:5].tolist()))
    assert hits >= 0.9 * 35 and all(g["query_id"] < 125 for g in got)


def test_language_mixture(spark):
    rows = [(i, ("the house and the dog " if i % 2 else "das haus und der hund ") * 5, "en" if i % 2 else "de") for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = "the house and the dog " * 20 + "das haus und der hund " * 10
    docs = spark.createDataFrame([(0, None), (1, "123 !"), (2, "the dog"), (3, mixed)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in range(4)] == ["und", "und", "en", "en"]
    assert set(got[3]["languages"]) == {"en", "de"} and 0.5 < got[3]["score"] < 0.8
    none = langid.train(spark.createDataFrame([(0, "a", None)], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_language_model_is_normalised(spark, docs):
    counts = lm.count_words(docs)
    model = lm.train(docs, counts, vocab=8, hot=6, rounds=1)
    a, b, z = lm.tables(model.params)
    assert np.allclose(np.exp(a[:, None] + b[None] - z[..., None]).sum(-1), 1, atol=1e-3)
    got = {r["doc_id"]: r for r in lm.score(docs, model, counts).collect()}
    assert got[0]["n_tokens"] == 1 and got[9]["n_tokens"] == 201 and got[9]["score"] == pytest.approx(got[8]["score"])


def test_language_model_learns(spark):
    """On a Markov chain of five successors a word, held-out texts score far above their unigrams; the score is brute force."""
    r = random.Random(1)
    follow = [[r.randrange(400) for _ in range(5)] for _ in range(400)]

    def text() -> str:
        out = [r.randrange(400)]
        while len(out) < 200:
            out.append(r.choice(follow[out[-1]]))
        return " ".join(f"w{k}" for k in out)

    train = spark.createDataFrame([(k, text()) for k in range(2000)], "doc_id long, text string")
    held = [(k, text()) for k in range(50)]
    counts = stored(lm.count_words(train), "counts")
    model = lm.train(train, counts)
    got = {x["doc_id"]: x for x in lm.score(spark.createDataFrame(held, "doc_id long, text string"), model, counts).collect()}
    gain = sum(x["score"] - x["base_score"] for x in got.values()) / sum(x["n_tokens"] for x in got.values())
    assert gain >= 0.5
    p, start = model.params, len(model.prior)
    outputs = [model.hot[w][0] for w in [*lm.words_of(held[0][1]), lm.END]]
    total, u, v = 0.0, start, start
    for w in outputs:
        logits = (p["r"][u] @ p["c2"] + p["r"][v] @ p["c1"]) @ p["q"].T.astype(float) + p["b"]
        total += logits[w] - np.log(np.exp(logits).sum())
        u, v = v, w
    assert got[0]["score"] == pytest.approx(total / np.log(10), rel=1e-4)


def test_quality_learns(spark):
    good = [(i, f"A plain sentence number {i} with some words. " * 4) for i in range(60)]
    bad = [(100 + i, f"BUY NOW!!! {i} $$$ ### " * 9) for i in range(60)]
    docs = spark.createDataFrame(good + bad + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert np.mean([got[i] >= 0.7 for i in range(40, 60)]) > 0.9 and np.mean([got[100 + i] < 0.7 for i in range(40, 60)]) > 0.9
    assert len(got) == 122 and {r["score"] for r in quality.score(docs, None).collect()} == {0.5}


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, compression):
    pages = spark.createDataFrame([(1, "u1", "<p>x"), (2, "u2", "<p>x"), (3, "u3", None), (4, "u4", ""), (5, "u5", "é\r\n\r\nWARC/1.1" * 999)], "page_id long, url string, html string")
    found = warc.with_revisits(pages, "page_id", F.col("html"))
    original = {r["page_id"]: r["original"] for r in found.collect()}
    assert original == {1: 2, 2: None, 3: 4, 4: None, 5: None}
    records = found.select(F.col("page_id").cast("string").alias("record_id"), F.when(F.col("original").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("url").alias("target_uri"), "payload_digest", "payload_bytes", "payload", F.col("original").cast("string").alias("refers_to"))
    path = shared_dir(spark, "test")
    warc.write_warc(records, path, compression=compression, fileBytes="1000")
    got = {int(r["record_id"]): r for r in warc.read_warc(spark, path).collect()}
    assert bytes(got[5]["payload"]).decode() == "é\r\n\r\nWARC/1.1" * 999 and got[5]["payload_bytes"] == len(got[5]["payload"])
    assert got[5]["payload_digest"] == base64.b32encode(hashlib.sha1(got[5]["payload"]).digest()).decode()
    revisits = warc.read_warc(spark, path, "record_id string, record_type string, refers_to string").where("record_type = 'revisit'")
    assert sorted(tuple(r) for r in revisits.collect()) == [("1", "revisit", "2"), ("3", "revisit", "4")]


def test_header_names_hold_in_any_case(spark, tmp_path):
    record = b"WARC/1.1\r\nwarc-type: resource\r\nWARC-RECORD-ID: <urn:x:1>\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(record * 2)
    got = warc.read_warc(spark, str(tmp_path)).where("record_type = 'resource'").collect()
    assert [(r["record_id"], bytes(r["payload"])) for r in got] == [("<urn:x:1>", b"abc")] * 2


def test_packing_takes_the_tightest_bin():
    """Against a plain search over all open bins, piece by piece."""
    r = random.Random(3)
    for _ in range(30):
        bins, open_bins = packing.Bins(50, 4), []
        for size, source, cluster in sorted(((r.randrange(1, 51), r.randrange(-1, 4), r.randrange(-1, 6)) for _ in range(120)), reverse=True):
            able = [(left, b) for b, (left, sources, clusters) in enumerate(open_bins) if left >= size and (source < 0 or source not in sources) and (cluster < 0 or cluster not in clusters)]
            got = bins.place(size, source, cluster)
            if able:
                assert open_bins[got][0] == min(able)[0] and got in [b for _, b in able]
            else:
                assert got == len(open_bins)
                open_bins.append([50, set(), set()])
            open_bins[got][0] -= size
            open_bins[got][1].add(source)
            open_bins[got][2].add(cluster)


def test_packing_is_tightest_without_conflicts(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(0, 150), r.choice(["a", "b", "c", None]), r.choice(["x", None, f"t{i}"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, n int, source string, copy string")
    got = packing.pack(docs, F.col("n"), F.col("source"), F.col("copy"), capacity=100, shard_rows=1000).collect()
    by = {i: x for x in rows for i in [x[0]]}
    assert {g["doc_id"] for g in got} == set(by)
    want = {}
    for g in sorted(got, key=lambda g: (g["bin"], g["bin_offset"])):
        want.setdefault(g["bin"], []).append(g)
    for pieces in want.values():
        assert sum(p["n_tokens"] for p in pieces) <= 100
        for k in (2, 3):
            seen = [by[p["doc_id"]][k] for p in pieces if by[p["doc_id"]][k] is not None]
            assert len(seen) == len(set(seen))
    bins = packing.Bins(10, 2)
    assert [bins.place(*x) for x in [(6, 0, -1), (5, 1, -1), (4, 0, -1), (4, 1, -1), (5, 0, -1)]] == [0, 1, 1, 0, 2]
