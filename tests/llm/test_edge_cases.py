"""Every query and pipeline stage on hostile and on empty tables, held against plain Python.

The tables hold nulls in each column, empty, blank and very long texts, ties, repeated rows and
columns whose names the operators use themselves.
"""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import bpe, covertree, quality, queries

CLASH = ["_text", "_score", "_gone", "_id", "fp", "n", "node", "component", "score", "lang_pred", "languages", "words", "ids", "at", "shard", "piece", "length", "cluster", "_order", "payload", "original", "v", "block", "box", "id", "kind", "mark", "is_query"]
LONG = " ".join(f"w{k % 977}" for k in range(60_000))


def texts() -> list[str | None]:
    en = "The old house near the river was quiet and the people of the town walked home {} in the evening."
    de = "Das alte Haus am Fluss war still und die Leute der Stadt gingen am Abend {} nach Hause."
    out = [None, "", " ", "\n\t\x0b", "a", "a b c", "123 456 !!", "\u0085x\u001cy z", "<|endoftext|> x", "漢字 😀 été", LONG, LONG + " end", "x" * 50_000]
    for k in range(40):
        out += [en.format(f"number {k} of {k * k}") * 3, de.format(f"Nummer {k} von {k * k}") * 3]
    out += ["Same text again and again in the evening of the old town."] * 12
    out += [f"BUY NOW!!! {k} $$$ ### %%% " * 9 for k in range(30)]
    return out


def write(folder, name: str, columns: dict, empty: bool) -> None:
    n = len(next(iter(columns.values())))
    columns |= {c: pa.array([f"{c}{k % 3}" if k % 5 else None for k in range(n)]) for c in CLASH if c not in columns}
    found = pa.table(columns)
    pq.write_table(found.slice(0, 0) if empty else found, f"{folder}/{name}.parquet")


def tables(folder, empty: bool = False):
    t = texts()
    ids = [*range(len(t)), 7, 7, 20, None, None]
    t = [*t, t[7], t[7], "another text under an id that occurs twice", None, "a text without an id"]
    n = len(t)
    lang = [None if i is None or i % 11 == 0 else "de" if x and x.startswith("Das") else "en" for i, x in zip(ids, t)]
    source = [None if k % 7 == 0 else "hot" if k % 3 else f"s{k}" for k in range(n)]
    write(folder, "documents", {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(t), "lang": pa.array(lang), "source": pa.array(source), "n_chars": pa.array([None if x is None else len(x) for x in t], pa.int64())}, empty)
    marked = [i for i in range(13, 135) if i % 3]
    good = [None if i % 13 == 0 else int(i < 105) for i in marked]
    write(folder, "labels", {"doc_id": pa.array([*marked, 15, None], pa.int64()), "quality": pa.array([*good, 1, 1], pa.int32()), "toxic": pa.array([None] * (len(marked) + 2), pa.int32())}, empty)
    r = np.random.default_rng(3)
    x = r.normal(size=(90, 8)).astype("f4")
    v = [*x.tolist(), *(x[:20] * 2).tolist(), *[x[0].tolist()] * 30, None, [], [0.0] * 8, [math.nan] * 8, [math.inf] * 8, [None] * 8, [1.0, 2.0]]
    write(folder, "embeddings", {"vec_id": pa.array([*range(len(v)), None], pa.int64()), "embedding": pa.array([*v, x[0].tolist()], pa.list_(pa.float32())), "label": pa.array([None] * (len(v) + 1), pa.int32())}, empty)
    html = [None, "", "<p>a", "<p>a", "<p>a", "é\r\n\r\n" * 9, "<b>" * 100_000, None]
    write(folder, "pages", {"page_id": pa.array(range(10, 10 + len(html)), pa.int64()), "url": pa.array([None, "u\r\nx", *["u"] * (len(html) - 2)]), "html": pa.array(html)}, empty)
    write(folder, "benchmark", {"item_id": pa.array([1, None], pa.int64()), "text": pa.array(["The old house near the river.", None])}, empty)
    return str(folder)


@pytest.fixture(scope="module")
def hostile(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("hostile"))


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), empty=True)


def documents(folder) -> list[tuple]:
    t = pq.read_table(f"{folder}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def remainder(key, m: int) -> int:
    return zlib.crc32(("" if key is None else str(key)).encode()) % m


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ordered(rows: list) -> list:
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", [*sorted(queries.queries()), "pipeline"])
def test_empty_tables(spark, empty, name):
    assert ({**queries.queries(), "pipeline": corpus_pipeline.run}[name])(spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(queries.queries()) if re.match("op(1|3|4|6|9|10)_", n)])
def test_a_row_per_document(spark, hostile, name):
    got = queries.queries()[name](spark, hostile).collect()
    assert ordered([r["doc_id"] for r in got]) == ordered([i for i, _ in documents(hostile)])
    if "held_out" in got[0]:
        m, rest = (10, 0) if name.startswith("op4") else (4, 2)
        assert all(r["held_out"] == (remainder(r["doc_id"], m) == rest) for r in got)


def test_encoding_is_the_library(spark, hostile):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in documents(hostile):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op1_byte_bpe(spark, hostile).collect()]
    assert ordered(got) == ordered(want)


def test_token_counts(spark, hostile):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in documents(hostile):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op6_token_counts(spark, hostile).collect()]
    assert ordered(got) == ordered(want)


def test_base_scores(spark, hostile):
    docs = documents(hostile)
    counts = Counter(w for i, t in docs if remainder(i, 10) for w in [*split(t), ""])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        words = [*split(t), ""]
        want.append((i, len(words), sum(counts[w] > 0 for w in words), total, round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words), 4)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in queries.op4_log_bilinear_score(spark, hostile).collect()]
    assert ordered(got) == ordered(want)


def fingerprint(text: str | None) -> int:
    words = split(text)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs: list[tuple]) -> list[tuple]:
    """(id, fingerprint, component); rows without an id link with nothing."""
    fps = [fingerprint(t) for _, t in docs]
    known = [k for k, (i, _) in enumerate(docs) if i is not None]
    known.sort(key=lambda k: docs[k][0])
    f = np.array([fps[k] for k in known], np.uint64)
    label = covertree.least_labels(len(known), *np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 4))
    named = {k: docs[known[c]][0] for k, c in zip(known, label.tolist())}
    return [(i, fps[k], named.get(k)) for k, (i, _) in enumerate(docs)]


def similar_components(docs: list[tuple]) -> list[tuple]:
    """(id, None, component): chains of a Jaccard similarity of 0.8 or more on shingles of five words."""
    known = sorted((k for k, (i, _) in enumerate(docs) if i is not None), key=lambda k: docs[k][0])
    sets = [{tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} if (w := split(docs[k][1])) else set() for k in known]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    label = covertree.least_labels(len(known), *(np.array(x, int) for x in zip(*pairs)))
    named = {k: docs[known[c]][0] for k, c in zip(known, label.tolist())}
    return [(i, None, named.get(k)) for k, (i, _) in enumerate(docs)]


def test_simhash(spark, hostile):
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in queries.op9_simhash_balls(spark, hostile).collect()]
    assert ordered(got) == ordered(components(documents(hostile)))


def good_vectors(folder) -> tuple[list, list, np.ndarray]:
    t = pq.read_table(f"{folder}/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist()))
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    return rows, [i for i, _ in good], np.array([v for _, v in good])


def test_cover_tree(spark, hostile):
    rows, ids, x = good_vectors(hostile)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(u @ u.T >= 0.9)
    links, label = np.bincount(i, minlength=len(ids)) - 1, covertree.least_labels(len(ids), i, j)
    known = {ids[k]: (int(links[k]), ids[label[k]]) for k in range(len(ids))}
    want = [(i, *known.get(i, (0, i)), None if i is None else known.get(i, (0, i))[1] == i) for i, _ in rows]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in queries.op2_cover_tree_dedup(spark, hostile).collect()]
    assert ordered(got) == ordered(want)


def test_neighbours(spark, hostile):
    _, ids, x = good_vectors(hostile)
    got: dict[int, list] = {}
    for r in sorted(queries.op8_projection_neighbours(spark, hostile).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    for q, found in got.items():
        s = {i: float(x[ids.index(q)] @ x[k]) for k, i in enumerate(ids) if i != q}
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s[i] - score) < 1e-9 for i, score in found)
        least = sorted(s.values())[-20] - 1e-9
        hits += sum(score >= least for _, score in found)
    assert hits >= 18 * len(got)


def test_warc(spark, hostile):
    t = pq.read_table(f"{hostile}/pages.parquet")
    rows = [(i, (h or "").encode()) for i, h in zip(t["page_id"].to_pylist(), t["html"].to_pylist())]
    latest = {h: i for i, h in sorted(rows)}
    got = {r["page_id"]: r for r in queries.op5_warc_round_trip(spark, hostile).collect()}
    assert len(got) == len(rows)
    for i, h in rows:
        assert got[i]["payload_bytes"] == len(h)
        assert got[i]["record_type"] == ("response" if latest[h] == i else "revisit")
        assert got[i]["refers_to"] == (None if latest[h] == i else latest[h])


def check_bins(got: list, docs: list[tuple], capacity: int = 2048) -> None:
    """Each document's tokens are placed once; no bin is too full or holds a source or text twice."""
    lengths = Counter()
    bins: dict[tuple, list] = {}
    for r in got:
        lengths[r["doc_id"]] += r["n_tokens"]
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
    want = Counter()
    for i, t, _ in docs:
        want[i] += len(split(t)) + 1
    assert lengths == want
    source, once = {i: s for i, _, s in docs}, {i for i, n in Counter(d[0] for d in docs).items() if n == 1}
    text = {i: hashlib.md5((t or "").encode()).digest() for i, t, _ in docs}
    for rows in bins.values():
        assert sum(r["n_tokens"] for r in rows) <= capacity
        for kept in (source, text):
            seen = [kept[r["doc_id"]] for r in rows if r["doc_id"] in once and kept[r["doc_id"]] is not None]
            assert len(seen) == len(set(seen))


def test_packing(spark, hostile):
    t = pq.read_table(f"{hostile}/documents.parquet")
    check_bins(queries.op7_best_fit_packing(spark, hostile).collect(), list(zip(*(t[c].to_pylist() for c in ("doc_id", "text", "source")))))


def test_pipeline(spark, hostile, tmp_path):
    """Each stage against plain Python on what its predecessor kept."""
    docs = spark.read.parquet(f"{hostile}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, hostile).write.parquet(f"{tmp_path}/{k}")
        found = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns
            kept[name] = [tuple(r) for r in found.select("doc_id", "text", "source").collect()]
            docs = found
        else:
            packed = found.collect()
    scored = {r["doc_id"]: r["predicted"] for r in queries.op10_pu_quality(spark, hostile).collect()}
    whole = [d for d in documents(hostile) if scored[d[0]] or [i for i, _ in documents(hostile)].count(d[0]) > 1]
    assert {d[0] for d in kept["quality"]} <= {d[0] for d in whole} and {i for i, p in scored.items() if p} <= {d[0] for d in kept["quality"]} | {7, 20, None}
    assert sum(13 <= (i or 0) < 93 for i, _, _ in kept["quality"]) >= 76  # clean prose stays
    assert not any(105 <= (i or 0) < 135 for i, _, _ in kept["quality"])  # shouting goes
    assert set(kept["language"]) <= set(kept["quality"]) and not any(t is None or not re.search(r"[^\W\d_]", t) for _, t, _ in kept["language"])
    assert sum(13 <= (i or 0) < 93 for i, _, _ in kept["language"]) >= 76
    named = similar_components([d[:2] for d in kept["language"]])
    assert {i for i, _, _ in kept["near_duplicates"] if i is not None} == {c for _, _, c in named if c is not None}
    assert len({i for i, _, _ in kept["near_duplicates"] if i is not None}) == len([i for i, _, _ in kept["near_duplicates"] if i is not None])
    check_bins(packed, kept["near_duplicates"])


def test_pipeline_is_its_stages(spark, hostile):
    assert corpus_pipeline.run(spark, hostile).count() > 0
    assert quality.THRESHOLD == 0.7
