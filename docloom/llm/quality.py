"""Quality classifier by positive-unlabelled learning (operator 10).

A small network in numpy minimises the non-negative unbiased risk: trusted positives (label 1)
against unlabelled web text, with a class prior estimated from how few unlabelled texts a first
model can leave in for the share of positives it leaves in. Labels reach the driver only as the
features of a bounded sample of labelled rows (``sample``, the rows of least hash); features of
fixed width come from whole texts inside the tasks, so nothing is shuffled.

Defined results: null and empty texts have the features of the empty text and a score like any
other; without positives every score is 0.5; rows with a null label never train as positives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_hashed

HASHED = 256
DENSE = 24
WIDTH = DENSE + HASHED
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 stop or comma, 7 other mark, 8 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 8 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c in ".," else 7 if _c.isprintable() else 0
_FOLDED = np.array([16 if c in (2,) else 17 if c in (3,) else (b & 15) if c in (1, 8) else 18 + c for b, c in enumerate(_CLASS)], np.int64)


def features(text: str | None) -> np.ndarray:
    """Shares of character classes, word, line and repetition statistics, and hashed byte bigrams."""
    out = np.zeros(WIDTH, np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_CLASS[b], minlength=9)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, n_words, n_lines = len(raw), max(len(words), 1), max(len(lines), 1)
    often = Counter(words)
    common = [c for _, c in often.most_common(3)] + [0, 0, 0]
    marks = np.bincount(b[_CLASS[b] == 7], minlength=128)[:128]
    out[:9] = kinds / n
    out[9] = np.log1p(n) / 10
    out[10] = len(often) / n_words
    out[11:14] = [c / n_words for c in common[:3]]
    out[14] = min(n / n_words, 40) / 20
    out[15] = len(set(lines)) / n_lines
    out[16] = np.log1p(n / n_lines) / 8
    out[17] = np.log1p(n_words / len(often)) if often else 0
    out[18] = marks.max() / n_words
    out[19] = kinds[7] / n_words
    out[20] = kinds[2] / max(kinds[1] + kinds[2], 1)
    out[21] = sum(not w[-1:].isalpha() for w in words) / n_words
    out[22] = sum(len(w) == 1 for w in words) / n_words
    out[23] = np.log1p(n_words) / 8
    f = _FOLDED[b]
    out[DENSE:] = np.sqrt(np.bincount((f[:-1] * 31 + f[1:] * 17 + (f[:-1] ^ f[1:])) % HASHED, minlength=HASHED) / n)
    return out


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: int = 32, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = [r.normal(0, (2 / len(mean)) ** 0.5, (len(mean), width)), np.zeros(width), r.normal(0, (1 / width) ** 0.5, width), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0
        self.slope, self.shift = 1.0, 0.0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def step(self, x: np.ndarray, h: np.ndarray, slope: np.ndarray, rate: float, decay: float = 1e-4) -> None:
        """Adam on the sum over rows of slope x output."""
        back = slope[:, None] * self.p[2] * (1 - h * h)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        grads = [z.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]
        self.t += 1
        for i, g in enumerate(grads):
            g = g + decay * self.p[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] -= rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.forward(x)[1] + self.shift, -30, 30)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 40, batch: int = 512, rate: float = 2e-3, seed: int = 7) -> Network:
    """Minimises prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), l the sigmoid loss;
    while the bracket is negative the step goes the other way on it alone."""
    every = np.vstack([pos, unl])
    net = Network(every.mean(0), every.std(0) + 1e-3, seed=seed)
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        order_u = r.permutation(len(unl))
        order_p = r.permutation(np.resize(np.arange(len(pos)), len(unl)))
        for k in range(0, len(unl), batch):
            xp, xu = pos[order_p[k : k + batch]], unl[order_u[k : k + batch]]
            (hp, gp), (hu, gu) = net.forward(xp), net.forward(xu)
            sp, su = sigmoid(gp), sigmoid(gu)
            dp, du = sp * (1 - sp) / len(gp), su * (1 - su) / len(gu)  # slope of l(-g) = sigmoid(g)
            rest = su.mean() - prior * sp.mean()
            if rest < 0:
                slope_p, slope_u = prior * dp, -du
            else:
                slope_p, slope_u = -2 * prior * dp, du
            net.step(np.vstack([xp, xu]), np.vstack([hp, hu]), np.concatenate([slope_p, slope_u]), rate)
    return net


#: From so many positives and unlabelled rows on the class prior is estimated; it is a half below.
LEAST_ROWS = 8


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 7) -> float:
    """Class prior: the least ratio of the unlabelled to the positive share above a threshold of a
    first model's output, among thresholds that keep enough positives; a half under LEAST_ROWS of either."""
    if min(len(pos), len(unl)) < LEAST_ROWS:
        return 0.5
    half_p, half_u = len(pos) // 2, len(unl) // 2
    net = fit_nnpu(pos[:half_p], unl[:half_u], 0.5, epochs=10, seed=seed)
    gp, gu = net.forward(pos[half_p:])[1], net.forward(unl[half_u:])[1]
    ratios = []
    for q in np.linspace(0.0, 0.8, 81):
        t = np.quantile(gp, q)
        share_p, share_u = (gp >= t).mean(), (gu >= t).mean()
        margin = np.sqrt(1 / (4 * len(gp))) + np.sqrt(1 / (4 * len(gu)))
        ratios.append((share_u + margin) / max(share_p - margin, 1e-6))
    return float(np.clip(min(ratios), 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 12_000, usable: Column | None = None) -> Network | None:
    """Fits on at most ``sample`` positives and as many unlabelled rows among the ``usable`` ones
    (all, by default); None without positives (``score`` then gives every text 0.5). The labelled rows also set where the score passes
    THRESHOLD: midway between the lowest positives and the highest others, if label 0 occurs."""
    rows = docs if usable is None else docs.where(usable)
    key = docs.schema[id_col].dataType.simpleString()
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast(key).alias(id_col)).agg(F.max(label_col).alias("mark"))
    ids = rows.select(F.col(id_col).alias("id")).join(marks, F.col("id") == F.col(id_col), "left").select("id", "mark")
    sizes = ids.agg(F.count("*").alias("all"), F.count_if(F.col("mark") == 1).alias("good"), F.count_if(F.col("mark") == 0).alias("bad")).first()
    parts = [(1, "mark = 1", sample, sizes["good"]), (0, "mark = 0", sample // 4, sizes["bad"]), (-1, "true", sample, sizes["all"])]
    chosen = [least_hashed(ids.where(which), "id", n, rows_, salt=int(kind < 0)).select("id", F.lit(kind).alias("kind")) for kind, which, n, rows_ in parts]
    kinds = chosen[0].unionAll(chosen[1]).unionAll(chosen[2])
    wanted = {}
    for r in kinds.collect():  # at most 2.25 x sample ids
        wanted.setdefault(r["id"], []).append(r["kind"])
    if not any(1 in k for k in wanted.values()):
        return None
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, features(text.as_py()).tobytes()) for key, text in zip(batch.column(0).to_pylist(), batch.column(1)) for k in shared.value.get(key, ())]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["kind", "x"])

    table = rows.select(id_col, text_col).mapInArrow(measured, "kind int, x binary").toPandas().sort_values(["kind", "x"], ignore_index=True)
    x = np.frombuffer(b"".join(table.x), np.float32).reshape(-1, WIDTH)  # 4 bytes a feature: 30 MB at the default sample
    kind = table.kind.to_numpy()
    shuffled = np.random.default_rng(11).permutation(len(x))
    x, kind = x[shuffled], kind[shuffled]
    pos, neg, unl = x[kind == 1], x[kind == 0], x[kind == -1]
    net = fit_nnpu(pos, unl, estimate_prior(pos, unl))
    gp = net.forward(pos)[1]
    low = np.quantile(gp, 0.002)
    if len(neg) >= 20:
        gn = net.forward(neg)[1]
        cuts = np.unique(np.concatenate([gp, gn]))
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        cuts = cuts[np.linspace(0, len(cuts) - 1, min(len(cuts), 2000)).astype(int)]
        wrong = np.array([3 * (gp < c).mean() + (gn >= c).mean() for c in cuts])  # a good text lost is the worse error
        best = cuts[wrong <= wrong.min() + 1e-9]
        low = float(best[len(best) // 2])
    net.slope = 4 / (np.quantile(gp, 0.5) - low + 1e-6) if np.quantile(gp, 0.5) > low else 1.0
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - net.slope * low)
    return net


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document: its id, or the columns of ``keep``, and ``score``, the likeliness of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.select(*(keep or [id_col]))
    kept_names, n_kept = kept.columns, len(kept.columns)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.array([features(text.as_py()) for text in batch.column(n_kept)], float).reshape(n, WIDTH)
            s = shared.value.score(x) if shared.value is not None and n else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(s, pa.float64())], [*kept_names, "score"])

    return docs.select(*kept.columns, F.col(text_col).alias("_text")).mapInArrow(scored, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))
