"""Language-model scoring by a log-bilinear neural model (operator 4).

Token counts of the whole training corpus are summed in Spark and stored. The most frequent words
(``hot``, a bounded number) travel to the tasks in a broadcast dictionary; every rarer token is
counted by a join on the stored table, which covers all words, so the vocabulary may grow without
bound. The neural model predicts one of ``vocab`` frequent words, the end, or one of a fixed number
of classes of rarer words (by ending) from the two tokens before; within its class a rarer word has
its smoothed relative frequency, so the probabilities of all texts are normalised.

Training is noise-contrastive: a round visits every position of every text. Each task trains a copy in
numpy on its texts, a bounded block at a time; ``syncs`` times a round, each after a share of the
positions of each block, Spark averages the copies, at most TRAINERS of them. Scoring computes all normalisers at
once as a product of matrices: exp(A[u, w] + B[v, w] + b[w]) summed over w is exp(A) @ exp(B + b).T.

Defined results: null and blank texts are one end token; with no training text N = V = 0 and both
scores are the uniform values the formulas give; copies count as often as they occur.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

END = b""  # no word is empty
CLASSES = 256
SMOOTH = 0.1
BLOCK = 1 << 18  # tokens that a task holds at once in training, and one text more
TRAINERS = 4096  # copies of the parameters that are averaged at once, at most


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode().lower().split()


def class_of(word: bytes) -> int:
    """Class of a rare word: by its ending."""
    return zlib.crc32(word[-3:]) % CLASSES


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (binary; the end is empty) and its count over ``docs``; tasks send partial counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                total.update(words_of(text.as_py()))
                total[END] += 1
            if len(total) > 200_000:
                yield rows()
                total = Counter()
        if total:
            yield rows()

    return docs.select(text_col).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int, max_bytes: int = 256) -> DataFrame:
    """The rows of ``counts`` (word, n) of the highest counts, ``most`` at most, words of over ``max_bytes``
    left out: what they take is bounded. A histogram over steps of the logarithm gives the least count,
    so that no task sends words that are not wanted."""
    counts = counts.where(F.octet_length("word") <= max_bytes)
    step = F.floor(F.log2("n") * 32)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()  # 2,048 rows at most
    room, least = most, None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["step"]
    return counts.where(step >= least) if least is not None else counts.limit(0)


@dataclass
class Model:
    """What scoring needs, all of bounded size but for the table of counts, which stays in Spark."""

    total: int
    distinct: int
    hot: dict[bytes, tuple[int, int]]  # word to (output, count); outputs from ``vocab`` on are classes
    vocab: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    prior: np.ndarray  # unigram probabilities of outputs
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def rare_log10(self, cls: int, count: int) -> float:
        return math.log10((count + SMOOTH) / (self.class_total[cls] + SMOOTH * (self.class_distinct[cls] + 1)))


def start_params(prior: np.ndarray, dim: int, seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = len(prior)
    eye = np.eye(dim, dtype=np.float32)
    return {
        "r": r.normal(0, 0.1, (n + 1, dim)).astype(np.float32),  # the last row stands before the first token
        "q": r.normal(0, 0.1, (n, dim)).astype(np.float32),
        "c1": eye.copy(), "c2": eye * 0.5, "b": np.log(prior).astype(np.float32),
    }


def nce_epoch(params: dict[str, np.ndarray], prior: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, rate: float = 0.15, batch: int = 1024, noise: int = 48, seed: int | list[int] = 0, acc: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """One pass of noise-contrastive estimation with Adagrad over contexts (u, v) and words w; each
    batch sums its gradients and shares its noise words, drawn from the unigram distribution. ``acc``:
    Adagrad's sums of earlier passes, which this one goes on with; it changes them."""
    p = {k: x.astype(np.float32).copy() for k, x in params.items()}
    if acc is None:
        acc = {}
    for k, x in p.items():
        acc.setdefault(k, np.full_like(x, 1e-2))
    r = np.random.default_rng(seed)
    log_kp = np.log(noise * prior).astype(np.float32)
    order, cumulative = r.permutation(len(w)), np.cumsum(prior)
    narrow = np.uint16 if len(params["r"]) < 1 << 16 else np.int64  # sorted by radix

    def descend(name: str, at: np.ndarray | None, grad: np.ndarray) -> None:
        if at is None:
            acc[name] += grad * grad
            p[name] -= rate * grad / np.sqrt(acc[name])
            return
        by = np.argsort(at.astype(narrow), kind="stable")
        at = at[by]
        firsts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rows, sums = at[firsts], np.add.reduceat(grad[by], firsts, axis=0)
        total = acc[name][rows] + sums * sums
        acc[name][rows] = total
        p[name][rows] -= rate * sums / np.sqrt(total)

    for k in range(0, len(order), batch):
        i = order[k : k + batch]
        x = np.minimum(np.searchsorted(cumulative, r.random(noise) * cumulative[-1]), len(prior) - 1)
        ui, vi, wi = u[i], v[i], w[i]
        ru, rv = p["r"][ui], p["r"][vi]
        h = ru @ p["c2"] + rv @ p["c1"]
        qw, qx = p["q"][wi], p["q"][x]
        s_w = (h * qw).sum(1) + p["b"][wi] - log_kp[wi]
        s_x = h @ qx.T + (p["b"][x] - log_kp[x])
        d_w = 1 / (1 + np.exp(-np.clip(s_w, -30, 30))) - 1
        d_x = 1 / (1 + np.exp(-np.clip(s_x, -30, 30)))
        dh = d_w[:, None] * qw + d_x @ qx
        grads = {"c2": ru.T @ dh, "c1": rv.T @ dh}
        du, dv = dh @ p["c2"].T, dh @ p["c1"].T
        descend("q", np.r_[wi, x], np.vstack([d_w[:, None] * h, d_x.T @ h]))
        descend("b", np.r_[wi, x], np.r_[d_w, d_x.sum(0)])
        descend("r", np.r_[ui, vi], np.vstack([du, dv]))
        descend("c1", None, grads["c1"])
        descend("c2", None, grads["c2"])
    return p


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)]).astype(np.float32)


def unpack(flat: np.ndarray, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(shapes):
        size = math.prod(shapes[k])
        out[k] = flat[at : at + size].reshape(shapes[k])
        at += size
    return out


def contexts(outputs: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens two before and one before each; ``start`` stands before the first."""
    padded = np.r_[start, start, outputs]
    return padded[:-2], padded[1:-1]


def train(docs: DataFrame, counts: DataFrame, text_col: str = "text", vocab: int = 2048, hot: int = 131_072, dim: int = 32, rounds: int = 1, syncs: int = 4) -> Model:
    """Fits the model to ``docs``, whose stored counts are ``counts``: ``rounds`` passes over all positions,
    the copies averaged ``syncs`` times in each."""
    spark = docs.sparkSession
    top = sorted(((bytes(r["word"]), r["n"]) for r in most_frequent(counts, hot).select("word", "n").collect()), key=lambda x: (-x[1], x[0]))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = {w: i for i, (w, _) in enumerate(top[:vocab])}
    known = {w: (frequent.get(w, vocab + class_of(w)), n) for w, n in top}
    shared_frequent = spark.sparkContext.broadcast(frequent)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in shared_frequent.value:
                    n[class_of(word)] += c
                    v[class_of(word)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(n), pa.array(v)], ["cls", "n", "v"])

    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.select("word", "n").mapInArrow(by_class, "cls int, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        class_total[r["cls"]], class_distinct[r["cls"]] = r["n"], r["v"]
    unigram = np.r_[np.array([n for _, n in top[:vocab]], float), np.zeros(vocab - len(frequent)), class_total] + 0.5
    model = Model(int(whole["n"]), int(whole["v"]), known, vocab, class_total, class_distinct, unigram / unigram.sum())
    model.params = start_params(model.prior, dim)
    if not top:
        return model
    outputs = spark.sparkContext.broadcast({w: o for w, (o, _) in known.items()})
    start = len(model.prior)

    kind = np.uint16 if start < 1 << 16 else np.int32

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = outputs.value.get
        for batch in batches:
            block: list[int] = []
            for text in batch.column(0):
                block += (start, start)
                block += (o if (o := get(w)) is not None else vocab + class_of(w) for w in (*words_of(text.as_py()), END))
                if len(block) >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array([np.array(block, kind).tobytes()], pa.binary())], ["x"])
                    block = []
            if block:
                yield pa.RecordBatch.from_arrays([pa.array([np.array(block, kind).tobytes()], pa.binary())], ["x"])

    chunks = stored(docs.select(text_col).mapInArrow(coded, "x binary"), "contexts")
    chunks = chunks.coalesce(TRAINERS)
    state = model.params | {f"acc {k}": np.full_like(x, 1e-2) for k, x in model.params.items()}
    parts = 64
    width = math.ceil(len(pack(state)) / parts)
    model_prior = spark.sparkContext.broadcast(model.prior)
    for turn in range(rounds * syncs):
        shared = spark.sparkContext.broadcast(pack(state))
        pace, share = 0.15 / (1 + turn / 2), turn % syncs
        like = {k: x.shape for k, x in state.items()}

        def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {k: x.copy() for k, x in unpack(shared.value, like).items()}
            params, acc = ({k.removeprefix("acc "): x for k, x in found.items() if k.startswith("acc ") == wanted} for wanted in (False, True))
            visited, salt, blocks = 0, 0, 0
            for x in (x for batch in batches for x in batch.column(0)):
                tokens = np.frombuffer(x.as_py(), kind).astype(np.int32)
                at = np.flatnonzero(tokens != start)[share::syncs]  # two starts stand before each text
                params = nce_epoch(params, model_prior.value, tokens[at - 2], tokens[at - 1], tokens[at], rate=pace, seed=[turn, blocks, zlib.crc32(tokens.tobytes())], acc=acc)
                visited, blocks = visited + len(at), blocks + 1
                salt = salt or int(tokens[:64].sum()) % 64
            if not visited:
                return
            flat = pack(params | {f"acc {k}": x for k, x in acc.items()})
            cut = [flat[k * width : (k + 1) * width].tobytes() for k in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([salt] * parts, pa.int32()), pa.array([float(visited)] * parts), pa.array(cut, pa.binary())], ["part", "salt", "n", "x"])

        copies = chunks.mapInArrow(fitted, "part int, salt int, n double, x binary")
        for keys in (["part", "salt"], ["part"]):  # averaged in two steps: no task holds all copies
            copies = copies.groupBy(*keys).applyInArrow(_average, "part int, salt int, n double, x binary")
        rows = {r["part"]: np.frombuffer(r["x"], np.float32) for r in copies.collect()}  # 64 rows
        if rows:
            state = unpack(np.concatenate([rows[k] for k in range(parts)]), like)
    model.params = {k: x for k, x in state.items() if not k.startswith("acc ")}
    return model


def _average(rows: pa.Table) -> pa.Table:
    n = rows.column("n").to_numpy()
    total = sum(w * np.frombuffer(x, np.float32) for w, x in zip(n, rows.column("x").to_pylist()))
    return pa.table({"part": rows.column("part")[:1], "salt": rows.column("salt")[:1], "n": pa.array([n.sum()]), "x": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def tables(params: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A[u, w], B[v, w] (with the bias) and log Z[u, v], by products of matrices."""
    a = (params["r"] @ params["c2"]) @ params["q"].T
    b = (params["r"] @ params["c1"]) @ params["q"].T + params["b"]
    top_a, top_b = a.max(1), b.max(1)
    left, right = a - top_a[:, None], b - top_b[:, None]
    z = np.exp(left, out=left) @ np.exp(right, out=right).T
    np.log(z, out=z)
    z += top_a[:, None]
    z += top_b
    return a, b, z


#: The broadcast model that this Python worker has used last, its tables and the places of its frequent words.
_LAST: list = [None, None]


def _tables_of(shared) -> tuple:
    """Tables and places, made once a worker and not once a task."""
    if _LAST[0] is not shared:
        m, words, numbers = shared.value
        _LAST[:] = [shared, (m, numbers, *tables(m.params), dict(zip(words.split(b"\n"), range(len(numbers[0]) - 1))))]
    return _LAST[1]


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Per document: its id, the columns of ``keep``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (log10 probabilities)."""
    spark = docs.sparkSession
    base_unit = model.total + SMOOTH * (model.distinct + 1)
    rare_unit = model.class_total + SMOOTH * (model.class_distinct + 1)
    keep = keep or {}
    # frequent words travel as one text and three arrays, whose last values stand for any other word
    complete = len(model.hot) >= model.distinct
    numbers = [(o, math.log10((n + SMOOTH) / base_unit), model.rare_log10(o - model.vocab, n) if o >= model.vocab else 0.0) for o, n in model.hot.values()]
    columns = [np.array([*c], kind) for c, kind in zip(zip(*numbers, (0, 0.0, 0.0)), (np.int32, float, float))]
    shared = spark.sparkContext.broadcast((replace(model, hot={}), b"\n".join(model.hot), columns))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (output_of, base_of, rare_of), a, b, z, place = _tables_of(shared)
        start = len(m.prior)
        for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            sizes, knowns, bases, scores, rares, tfs, ends = [], [], [], [], [], [], [0]
            for text in batch.column(batch.num_columns - 1):
                words = [*words_of(text.as_py()), END]
                at = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
                outputs, other = output_of[at], np.flatnonzero(at < 0).tolist()
                outputs[other] = [m.vocab + class_of(words[i]) for i in other]
                rare = Counter(words[i] for i in other)
                u, v = contexts(outputs, start)
                neural = float((a[u, outputs] + b[v, outputs] - z[u, v]).sum(dtype=np.float64)) / math.log(10)
                sizes.append(len(words))
                knowns.append(len(words) - len(other))
                bases.append(math.fsum(base_of[at].tolist()))
                scores.append(neural + math.fsum(rare_of[at].tolist()))
                if complete:  # the dictionary holds every known word: what is left is unseen
                    n = sum(rare.values())
                    bases[-1] += n * math.log10(SMOOTH / base_unit)
                    scores[-1] += sum(tf * math.log10(SMOOTH / rare_unit[class_of(w)]) for w, tf in rare.items())
                    rare = {}
                rares.extend(rare)
                tfs.extend(rare.values())
                ends.append(len(rares))
            rows = pa.StructArray.from_arrays([pa.array(rares, pa.binary()), pa.array(tfs, pa.int64()), pa.array([rare_unit[class_of(w)] for w in rares], pa.float64())], ["word", "tf", "unit"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(sizes, pa.int64()), pa.array(knowns, pa.int64()), pa.array(bases), pa.array(scores), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)],
                [*names, "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    # a row of its own for each document, whatever its id: repeated ids stay apart
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), *(c.alias(k) for k, c in keep.items()), F.col(text_col).alias("_text"))
    names = rows.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", n_tokens long, n_known long, base_score double, score double, rare array<struct<word:binary,tf:long,unit:double>>"
    firsts = rows.mapInArrow(scored, schema)
    sums = ["n_tokens", "n_known", "base_score", "score"]
    spread = firsts.select(*names, *sums, F.posexplode_outer("rare").alias("pos", "r"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    # rows without a rare word get a key that no word has, each its own, and so match nothing
    word = F.coalesce(F.col("r.word"), F.concat(F.lit(" "), F.col("_row").cast("string")).cast("binary")).alias("word")
    spread = spread.select(*names, *(F.when(first, F.col(c)).otherwise(F.lit(0)).alias(c) for c in sums), word, F.coalesce("r.tf", F.lit(0)).alias("tf"), F.coalesce("r.unit", F.lit(1.0)).alias("unit"))
    joined = spread.join(counts.select(F.col("word").alias("_w"), F.col("n").alias("c")), F.col("word") == F.col("_w"), "left")
    c = F.coalesce("c", F.lit(0))
    out = joined.groupBy(*names).agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score") + F.col("tf") * F.log10((c + SMOOTH) / base_unit)).alias("base_score"),
        F.sum(F.col("score") + F.col("tf") * F.log10((c + SMOOTH) / F.col("unit"))).alias("score"),
    )
    return out.withColumn("train_tokens", F.lit(model.total).cast("long")).drop("_row")
