"""Sum-of-squares online packing into fixed windows (operator 13).

Each task packs the documents of its partition as they come: a document's ids are made once, placed
once and leave the task with their window; nothing is shuffled and no other task is asked. Of a
document longer than a window, whole windows are filled first and the rest is placed like any other
document. The window that takes it is of the fill level (0: a new one) at which the sum over all
partly filled levels of their squared numbers of windows comes out least, ties to the fullest; a
level array holds these numbers.

Windows that are still partly filled when the partition ends, or when they hold ``pending`` tokens
together, are closed: the fullest take tokens from the ends of the emptiest until they are full, and
the one that remains, if any, is cut at its largest powers of two, lengths that take no padding. So a task
holds ``pending`` tokens and one block of texts at most, and no window is padded.

Ids are those of the tokenizer file. Where its merges number their tokens in turn, as byte-level vocabularies do, ranks are
read from it for a faster library of the same merges; a text that this library refuses (white space runs of
millions) and any other file go to the tokenizer library itself.

Defined results: null and empty texts are one token (the end); special strings inside texts are the
library's special ids; rows without an id and repeated rows are documents of their own; texts of any length are
packed whole; an empty table gives no rows; further columns are not read. Windows depend on how rows lie in partitions.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import WORDS, byte_symbols

#: Characters of text that are encoded together by the tokenizer library.
BLOCK = 1 << 22


class Encoder:
    """Packed little-endian 32-bit ids of texts, as the tokenizer library gives them for the file at ``path``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict) -> tiktoken.Encoding | None:
        """The same vocabulary by ranks, if ids follow the merges and nothing but the byte-level pattern splits texts."""
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")
        if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        in_turn = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))
        if not in_turn or len(vocab) != 256 + len(pairs) or any(model.get(o) for o in options) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            return None
        byte = {c: b for b, c in enumerate(byte_symbols())}
        return tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens=added)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        if self.fast is None:
            for e in self._library().encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()
            return
        for text in texts:
            try:
                yield self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:
                yield np.array(self._library().encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _library(self):
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow


#: Encoders of this Python worker, by path.
_ENCODERS: dict[str, Encoder] = {}


class Levels:
    """Open windows by fill level; ``n[h]`` counts those of level h."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, np.int64)
        self.at: dict[int, list] = {}

    def level(self, size: int) -> int:
        """The level that takes ``size`` tokens: the least sum of squares afterwards, ties to the fullest."""
        last = self.capacity - size
        # squares change by 2n + 1 where a window comes and by 1 - 2n where it goes; levels 0 and full don't count
        change = 2 * self.n[size:] + 1
        change[last] = 0
        change[1:] += 1 - 2 * self.n[1 : last + 1]
        change[1:][self.n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(change[::-1].argmin())

    def put(self, size: int, piece) -> list | None:
        """Places a piece; its window's pieces if that is full now. A window is a list of pieces."""
        h = self.level(size)
        window = self.at[h].pop() if h else []
        if h:
            self.n[h] -= 1
        window.append(piece)
        if h + size == self.capacity:
            return window
        self.n[h + size] += 1
        self.at.setdefault(h + size, []).append(window)
        return None

    def closed(self, cut) -> Iterator[list]:
        """Empties the levels: full windows, then powers of two. ``cut(piece, n)``: its first tokens up to the last n, and those."""
        rest = [(h, w) for h in sorted(self.at) for w in self.at[h]]
        self.n[:] = 0
        self.at = {}
        low, high = 0, len(rest) - 1
        while low < high:
            fill, window = rest[high]
            have, source = rest[low]
            while fill < self.capacity and have:
                n = min(self.capacity - fill, have, source[-1][1])
                kept, moved = cut(source.pop(), n)
                if kept:
                    source.append(kept)
                window.append(moved)
                fill, have = fill + n, have - n
            rest[high], rest[low] = (fill, window), (have, source)
            if fill == self.capacity:
                yield window
                high -= 1
            if not have:
                low += 1
        fill, window = rest[low] if low == high else (0, [])
        while fill:
            short, want = [], 1 << (fill.bit_length() - 1)
            fill -= want
            while want:
                n = min(want, window[-1][1])
                kept, moved = cut(window.pop(), n)
                if kept:
                    window.append(kept)
                short.append(moved)
                want -= n
            yield short


def cut(piece: tuple, n: int) -> tuple[tuple | None, tuple]:
    """A piece (start, length, document, ids) without its last ``n`` tokens, and these."""
    start, length, doc, ids = piece
    kept = (start, length - n, doc, ids[: 4 * (length - n)]) if n < length else None
    return kept, (start + length - n, n, doc, ids[4 * (length - n) :])


def windows(documents: Iterator[tuple], capacity: int, pending: int) -> Iterator[list]:
    """Windows of pieces (start, length, document, ids) for (document, ids) in turn."""
    levels, held = Levels(capacity), 0
    for doc, ids in documents:
        total = len(ids) // 4
        whole = total - total % capacity
        for start in range(0, whole, capacity):
            yield [(start, capacity, doc, ids[4 * start : 4 * (start + capacity)])]
        if whole < total:
            # an own copy: a slice would keep the ids of a whole long document
            full = levels.put(total - whole, (whole, total - whole, doc, memoryview(bytes(ids[4 * whole :]))))
            held += total - whole
            if full:
                held -= capacity
                yield full
            if held > pending:
                yield from levels.closed(cut)
                held = 0
    yield from levels.closed(cut)


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, pending: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: its document's id, ``start``, ``length``, ``ids_crc32`` and ``doc_tokens``, ``sequence_id`` and ``offset``."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def documents(batches: Iterator[pa.RecordBatch], seen: list) -> Iterator[tuple]:
        """((id, tokens), packed ids) of each document."""
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))

        def encoded(ids: list, texts: list[str]) -> Iterator[tuple]:
            for doc, found in zip(ids, encoder.ids(texts)):
                yield (doc, len(found) // 4 + 1), memoryview(found + end)

        for batch in batches:
            seen[:] = [batch.schema.field(0).type]
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > BLOCK:
                    yield from encoded(ids, texts)
                    ids, texts, size = [], [], 0
            yield from encoded(ids, texts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list = []
        first = TaskContext.get().partitionId() << 33

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], seen[0]), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        rows = []
        for k, window in enumerate(windows(documents(batches, seen), capacity, pending)):
            offset = 0
            for start, length, (doc, total), ids in window:
                rows.append((doc, start, length, zlib.crc32(ids), total, first + k, offset))
                offset += length
            if len(rows) >= 4096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[1:])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(packed, schema)
