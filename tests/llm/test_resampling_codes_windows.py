"""Operators 11 to 13 against plain Python on hostile and on empty tables: nulls in every column, empty and
very long texts, ties, repeated rows, and columns named like those that the operators use."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from docloom.llm import codes, queries, resampling, windows

CLASH = ["_at", "_part", "_first", "rank", "weight", "score", "n_words", "n_features", "stream", "ids", "ends", "words", "bucket", "n", "id", "v", "code", "error", "label_error", "part", "entry", "start", "length", "offset", "sequence_id", "_label"]


def texts() -> list[str | None]:
    r = random.Random(5)
    words = ["River", "old-house", "été", "漢字", "x1", "the", "THE", "a.b", "don't", "\t", "\n\n", "  ", "<|endoftext|>", "\u0085", "\x1c", " "]
    out = [None, "", " ", "\n\t", "!!!", "<|endoftext|>", " <|endoftext|> x", "a  b   c \n d", "one " * 19, "one " * 20, "y" * 30_000, " ".join(r.choice(words) for _ in range(40_000))]
    out += [" ".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(150)]
    return out + [out[30]] * 8


def write(path: str, columns: dict, empty: bool) -> None:
    n = len(next(iter(columns.values())))
    columns |= {c: pa.array([f"{c}{k % 3}" if k % 5 else None for k in range(n)]) for c in CLASH}
    found = pa.table(columns)
    pq.write_table(found.slice(0, 0) if empty else found, path)


def tables(folder, empty: bool = False) -> str:
    t = texts()
    ids = [*range(len(t) - 4), 3, 3, None, None]
    write(f"{folder}/documents.parquet", {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(t), "lang": pa.array([None] * len(t), pa.string()), "source": pa.array(["hot"] * len(t))}, empty)
    write(f"{folder}/benchmark.parquet", {"item_id": pa.array([1, None, 3], pa.int64()), "text": pa.array(["the river the old house", None, ""])}, empty)
    x = np.random.default_rng(2).normal(size=(120, 16)).astype("f4")
    v = [*x.tolist(), *[x[0].tolist()] * 40, None, [], [0.0] * 16, [math.nan] * 16, [1.0] * 15 + [math.inf], [None] * 16, [1.0, 2.0], [1e30] * 16, [3e5] + [-7e4] * 15]
    ids = [*range(len(v) - 2, 0, -1), 5, None]
    labels = [None if k % 3 == 0 else k % 4 for k in range(len(v))]
    write(f"{folder}/embeddings.parquet", {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(v, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}, empty)
    return str(folder)


@pytest.fixture(scope="module")
def hostile(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("hostile"))


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), empty=True)


def column(folder: str, table: str, *names: str) -> list[tuple]:
    t = pq.read_table(f"{folder}/{table}.parquet")
    return list(zip(*(t[n].to_pylist() for n in names)))


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)


def features(text: str | None) -> tuple[int, list[int]]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_resampling(spark, hostile):
    docs = [(i, *features(t)) for i, t in column(hostile, "documents", "doc_id", "text")]
    s = Counter(b for _, _, f in docs for b in f)
    t = Counter(b for (text,) in column(hostile, "benchmark", "text") for b in features(text)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    rows = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[2], r[1]))
    drawn = 5 * len(able) // 100
    assert drawn >= 4
    expected = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]]
    found = queries.op11_importance_resampling(spark, hostile)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert ordered(found.collect()) == ordered(expected)


def test_resampling_does_not_depend_on_blocks_or_partitions(spark, hostile):
    docs, target = (spark.read.parquet(f"{hostile}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = ordered(resampling.resample(docs, target, percent=30).collect())
    assert ordered(resampling.resample(docs.repartition(7), target, percent=30, block=50).collect()) == whole
    assert sum(r[-1] is not None for r in whole) > 10


def plain_codes(rows: list[tuple], parts: int = 8, rounds: int = 6):
    """Rows of (id, label, integers) by a full search."""
    width = len(rows[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in rows]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][2]))[:16]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for x in cut:
                groups[near(x[p], book)[1]].append(x[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(book)]
    found = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for (_, label, _), e in zip(rows, errors):
        labels[label] += e
    return [(i, "".join(f"{e:02x}" for _, e in f), error, labels[label], digest) for (i, label, _), f, error in zip(rows, found, errors)]


def test_codes(spark, hostile):
    rows = []
    for i, label, v in column(hostile, "embeddings", "vec_id", "label", "embedding"):
        if v and len(v) == 16 and all(x is not None and math.isfinite(x) and abs(x) < 1e12 for x in v):
            rows.append((i, label, [math.floor(4096 * float(x)) for x in v]))
    assert len(rows) == 162
    found = queries.op12_partial_distance_codes(spark, hostile)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert ordered(found.collect()) == ordered(plain_codes(rows))


def test_partial_distances_agree_with_whole_ones():
    r = np.random.default_rng(1)
    for high in (3, 5000, 1 << 40):  # ties, usual numbers, numbers whose squares need over 64 bits
        v, book = r.integers(-high, high, (500, 8)), r.integers(-high, high, (16, 8))
        whole = ((v[:, None].astype(object) - book[None]) ** 2).sum(2)
        code, error = codes.nearest(v, book)
        assert code.tolist() == whole.argmin(1).tolist()
        assert [int(e) for e in error] == whole.min(1).tolist()


def test_fewer_vectors_than_entries_and_wrong_widths(spark):
    few = spark.createDataFrame([(k, [float(k), 0.5], None) for k in range(3)], "vec_id long, embedding array<double>, label int")
    found = codes.compress(few, parts=2).collect()
    assert [(r.code, r.error) for r in sorted(found)] == [("0000", 0), ("0100", 0), ("0200", 0)]
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(few, parts=3)


def whole_ids(folder: str) -> list[tuple]:
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in column(folder, "documents", "doc_id", "text")]


def check_windows(rows, docs: list[tuple], capacity: int = 2048) -> int:
    """Every id in one piece, windows without gaps; the tokens of padding."""
    pieces, used = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        used[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for i, ids in docs:
        expected[i, len(ids)].append(ids)
    assert set(pieces) == set(expected)
    for key, several in expected.items():
        # rows of one id may be of equal length: each start then comes as often as there are rows
        assert sum(n for _, n, _ in pieces[key]) == key[1] * len(several)
        sums = {(s, n): {zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for ids in several} for s, n, _ in pieces[key]}
        assert all(crc in sums[s, n] for s, n, crc in pieces[key])
        cover = Counter(k for s, n, _ in pieces[key] for k in range(s, s + n))
        assert set(cover.values()) == {len(several)}
    padding = 0
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_windows(spark, hostile):
    found = queries.op13_sum_of_squares_packing(spark, hostile)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = whole_ids(hostile)
    assert check_windows(found.collect(), docs) == 0
    path = public_tokenizers.path("byte_bpe_50k.json")
    small = windows.pack(spark.read.parquet(f"{hostile}/documents.parquet").repartition(5), path, capacity=256, pending=3000)
    assert check_windows(small.collect(), docs, 256) == 0


def test_both_libraries_give_the_same_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    own = [*(t or "" for t in texts()), " " * 2_000_000, "a" + "\n" * 2_000_000 + "b <|endoftext|>"]
    expected = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in own]
    encoder = windows.Encoder(path)
    assert encoder.fast is not None
    assert list(encoder.ids(own)) == expected
    encoder.fast = None
    assert list(encoder.ids(own)) == expected
    # this one folds case and marks the ends of words: only the tokenizer library reads it
    assert windows.Encoder(public_tokenizers.path("word_bpe_49k.json")).fast is None


def test_level_of_the_least_sum_of_squares():
    """Each placement is held against the sum of squares of every choice."""
    r, capacity = random.Random(9), 40
    levels = windows.Levels(capacity)
    squares = lambda n: sum(int(x) ** 2 for x in n[1:capacity])
    full = 0
    for _ in range(600):
        size = r.randrange(1, capacity)
        costs = []
        for h in range(capacity - size + 1):
            if h == 0 or levels.n[h]:
                n = levels.n.copy()
                n[h] -= h > 0
                n[h + size] += 1
                costs.append((squares(n), -h))
        assert levels.level(size) == -min(costs)[1]
        full += levels.put(size, (0, size, "d", memoryview(bytes(4 * size)))) is not None
        assert int((levels.n * np.arange(capacity + 1)).sum()) == sum(x[1] for ws in levels.at.values() for w in ws for x in w)
    assert full > 200


def test_most_windows_are_filled_before_closing():
    r = random.Random(4)
    levels = windows.Levels(2048)
    sizes = [1 + int(r.expovariate(1 / 400)) % 2047 for _ in range(100_000)]  # whole windows of longer ones never come here
    full = sum(levels.put(s, (0, s, k, memoryview(b""))) is not None for k, s in enumerate(sizes))
    assert full * 2048 > 0.98 * sum(sizes)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_partial_distance_codes", "op13_sum_of_squares_packing"])
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("positives", [1, 2, 3, 9])
def test_quality_of_few_positives(spark, positives):
    """Under eight positives the class prior is a half; from one on every text gets a score."""
    from docloom.llm import quality

    docs = spark.createDataFrame([(k, f"A quiet text number {k} about the old town.") for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(positives)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    scores = [r.score for r in quality.score(docs, net).collect()]
    assert len(scores) == 30 and all(0 <= s <= 1 for s in scores)
    assert (quality.estimate_prior(np.zeros((positives, 3)), np.zeros((20, 3))) == 0.5) == (positives < quality.LEAST_ROWS)
