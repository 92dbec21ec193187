"""Token counts by byte-pair merging over a heap and a linked list (operator 6).

A document costs one pass of the pre-tokenizer and a look-up per word; each word is merged once a
Python worker, its count kept in a memo of bounded size. Nothing is shuffled and no ids are made.

Defined results: null and empty texts count 0; special strings inside a text are one token each,
as the tokenizer library has them by default; any length of text and word is handled.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer of byte-level tokenizers. Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Initial symbols less merges: pops the lowest-ranked adjacent pair, leftmost first, until none
    is left; stale heap entries are those whose pair has changed since."""
    n = len(symbols)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(pair)) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = following[i]
        if j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        merges += 1
        k = following[i] = following[j]
        following[j] = n
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


class Counter(dict):
    """Tokens of each word seen, counted at first sight; emptied once it holds ``most`` words."""

    def __init__(self, path: str, most: int):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.symbols = byte_symbols()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(WORDS).findall
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = n = count_merged([self.symbols[b] for b in word.encode()], self.ranks)
        return n

    def count(self, text: str) -> int:
        if not self.special or not self.special.search(text):
            return sum(map(self.__getitem__, self.words(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.words(part))) for part in parts)


#: Counters of this Python worker, by path: later tasks of the worker know earlier tasks' words.
_COUNTERS: dict[tuple[str, int], Counter] = {}


def _counter(path: str, memo_words: int) -> Counter:
    return _COUNTERS.get((path, memo_words)) or _COUNTERS.setdefault((path, memo_words), Counter(path, memo_words))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", memo_words: int = 1_200_000) -> DataFrame:
    """Per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, memo_words)
        for batch in batches:
            counts = [counter.count(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    key = docs.schema[id_col].dataType.simpleString()
    counts = docs.select(id_col, text_col, size).mapInArrow(counted, f"{id_col} {key}, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
