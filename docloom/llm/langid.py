"""Language identification by multilingual mixture inference (operator 3).

Training counts byte 4-grams of each language over all labelled training texts (a shuffle of at
most buckets x languages rows a task). A document is a mixture of those languages' n-gram models:
expectation-maximisation estimates the proportions, and languages join the set in order of their
proportion as long as the gain in log-likelihood outweighs a penalty a language.

Defined results: null texts and texts without letters are ``und`` with score 0; with no labelled
text every document is ``und``; ties go to the language that sorts first; null labels never train.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 15
UND = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes that are no letters become spaces, so that n-grams see words and their edges.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed byte 4-grams of a text and their counts."""
    b = _FOLD[np.frombuffer((" " + text.lower() + "  ").encode(), np.uint8)]
    h = ((b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    counts = np.bincount(h[b[1:-2] != 32], minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(float)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the log-probabilities (buckets x languages) of their n-grams."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                at, n = grams(text.as_py())
                total.setdefault(lang, np.zeros(1 << BITS))[at] += n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))], ["lang", "gram", "n"])

    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(lang_col).cast("string").alias(lang_col))
    rows = labelled.mapInArrow(counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows.lang.unique())
    counts = np.full((1 << BITS, len(langs)), 0.5)
    if langs:
        counts[rows.gram.to_numpy(), np.searchsorted(langs, rows.lang)] += rows.n.to_numpy()
    return langs, np.log(counts / counts.sum(0))


def proportions(logp: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood after ``rounds`` of expectation-maximisation."""
    top = logp.max(1)
    p, w, total = np.exp(logp - top[:, None]), start, n.sum()
    for _ in range(rounds):
        w = w * ((n / (p @ w)) @ p) / total
    return w, float(n @ (np.log(p @ w) + top))


def mixture(at: np.ndarray, n: np.ndarray, logp: np.ndarray, penalty: float = 3.0, rounds: int = 12) -> dict[int, float]:
    """The selected languages and their proportions."""
    own = logp[at]
    alone = n @ own
    best = int(np.argmax(alone))
    chosen, shares, score = [best], np.ones(1), float(alone[best])
    if own.shape[1] > 1:
        every, _ = proportions(own, n, np.full(own.shape[1], 1 / own.shape[1]), rounds)
        for lang in np.argsort(-every, kind="stable").tolist():
            if lang == best or every[lang] < 0.01:
                continue
            w, found = proportions(own[:, [*chosen, lang]], n, np.full(len(chosen) + 1, 1 / (len(chosen) + 1)), rounds)
            if found - score <= penalty * np.log(n.sum() + 1):
                break
            chosen, shares, score = [*chosen, lang], w, found
    return dict(zip(chosen, shares.tolist()))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document: its id, or the columns of ``keep``, ``lang_pred``, ``score`` (that language's share) and ``languages``, a map
    of the selected languages to their shares."""
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)  # 2**BITS rows, a column a language
    kept = docs.select(*(keep or [id_col]))
    kept_names, n_kept = kept.columns, len(kept.columns)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, shares = [], [], []
            for text in batch.column(n_kept):
                text = text.as_py() or ""
                mix = mixture(*grams(text), shared.value) if langs and _LETTER.search(text) else {}
                top = max(mix, key=lambda k: (mix[k], -k), default=None)
                names.append(UND if top is None else langs[top])
                scores.append(0.0 if top is None else min(1.0, mix[top]))
                shares.append([(langs[k], v) for k, v in mix.items()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_kept], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                [*kept_names, "lang_pred", "score", "languages"],
            )

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))]
    return docs.select(*kept.columns, F.col(text_col).alias("_text")).mapInArrow(predicted, T.StructType([*kept.schema.fields, *added]))
