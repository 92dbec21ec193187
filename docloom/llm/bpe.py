"""Byte-level byte-pair encoding and decoding (operator 1).

The work is dealt over documents; only counts of sampled words are shuffled. Tasks gather documents
into blocks of bounded size and find each block's distinct pre-tokens; Spark higher-order functions
then fold the ranked merges over the byte arrays of those words, once a word and block, and decode
the ids by concatenating binary pieces; a document is put together from its words by position.

Words that are frequent in a bounded sample of the documents are encoded once, by the same fold, and
travel with the tasks (``shared`` words of 64 bytes at most): a memo that saves work and changes no
result. Words of over ``LONG`` bytes are folded over the merges that can occur in them, in order of
rank, each merging all its places at once from left to right; that equals merging one place after
another because a token's rank exceeds those of its parts, which is checked for the rank file.

Defined results: null and empty texts have no ids (0 tokens, digests of nothing); a text longer than
a block is a block of its own; a word of any length is encoded (one of 50,000 bytes takes seconds);
other columns of the input are kept out of the work; repeated rows give repeated results; an empty
table gives no rows; a rank file must hold all 256 bytes.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Words of more bytes take the fold over ranked merges.
LONG = 512
SHARED_BYTES = 64
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Merges:
    """The rank map in numbers. A byte b has the number b + 1, a longer token its rank + 257; a pair
    of numbers is one key, ``left * base + right``. Ranks are kept negative (less ``shift``), so that
    they differ from numbers; NONE stands where two symbols don't merge.

    Of the ways to split a token only one ever meets: two symbols stand side by side in some text only
    if they do in the merging of their own bytes, as nothing beyond their ends had a part in making
    them. So the last merge of a token's own bytes is the only one that gives it."""

    NONE = -1

    def __init__(self, ranks: dict[bytes, int], n_buckets: int = 65_521):
        self.ranks, self.n_buckets = ranks, n_buckets
        number = {t: t[0] + 1 if len(t) == 1 else r + 257 for t, r in ranks.items()}
        most = max(number.values(), default=256)
        self.base = 1 << (most + 1).bit_length()
        self.edge = self.base - 1  # a symbol that merges with none
        self.shift = 4 * self.base
        self.pairs: dict[int, int] = {}  # the reachable ones
        self.unmade: dict[bytes, int] = {}  # tokens that merges don't give; as whole words they are taken as they are
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merged_bytes(token, ranks)
                if len(parts) == 2:
                    self.pairs[number[parts[0]] * self.base + number[parts[1]]] = rank
                else:
                    self.unmade[token] = rank
        self.first = [self.NONE] * (257 * 257)  # by two bytes, each plus one; 0 stands after the last
        for key, rank in self.pairs.items():
            if key // self.base <= 256 and key % self.base <= 256:
                self.first[key // self.base * 257 + key % self.base] = rank - self.shift
        self.text, self.hex = [""] * (most + 1), [""] * (most + 1)  # decimal id and bytes, by number
        for token, n in number.items():
            self.text[n], self.hex[n] = str(ranks[token]), token.hex()
        #: Code point of the symbol with number 0 in the fold over very long words.
        self.plane = 0x100 if most + 0x100 < 0xD800 else 0x10000
        self.rising = all(rank + 257 > max(k // self.base, k % self.base) for k, rank in self.pairs.items())

    def tables(self) -> str:
        """All tables as JSON, to be parsed once for each block."""
        buckets: list[tuple[list, list]] = [([], []) for _ in range(self.n_buckets)]
        for key, rank in self.pairs.items():
            keys, values = buckets[key % self.n_buckets]
            keys.append(key)
            values.append(rank - self.shift)
        return json.dumps({"pairs": buckets, "first": self.first, "text": self.text, "hex": self.hex}, separators=(",", ":"))

    def parsed(self) -> Column:
        """The rank map and the other tables, from the column ``tables``."""
        parsed = F.from_json("tables", "pairs array<array<array<bigint>>>, first array<bigint>, text array<string>, hex array<string>")
        return _bound(parsed, lambda t: F.struct(F.transform(t["pairs"], lambda b: F.map_from_arrays(b[0], b[1])).alias("pairs"), t["first"].alias("first"), t["text"].alias("text"), t["hex"].alias("hex")))

    def ranking(self) -> str:
        """The merges in order of rank as JSON: the token's bytes as symbols and in hexadecimal, the pair that makes it and the token's own symbol."""
        pairs = sorted((rank, key) for key, rank in self.pairs.items())
        spell = lambda key: "".join(chr(self.plane + b + 1) for b in bytes.fromhex(self.hex[key]))
        rows = [[spell(rank + 257), self.hex[rank + 257], chr(self.plane + key // self.base) + chr(self.plane + key % self.base), chr(self.plane + rank + 257)] for rank, key in pairs]
        return json.dumps(rows, ensure_ascii=False, separators=(",", ":"))

    def ranked(self) -> Column:
        """The merges in order of rank, from the column ``ranking``."""
        parsed = F.from_json("ranking", "array<array<string>>")
        return F.transform(parsed, lambda m: F.struct(m[0].alias("letters"), F.unhex(m[1]).alias("token"), m[2].alias("pair"), m[3].alias("joined")))

    def stored(self, spark: SparkSession) -> DataFrame:
        """``tables`` and ``ranking`` in one row that is joined to blocks. As literals their megabytes would stand in every plan,
        and the driver keeps the text of the plans of its last thousand queries."""
        return stored(spark.createDataFrame([(self.tables(), self.ranking())], "tables string, ranking string"), "merges")


def merged_bytes(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of ``token`` before the merge that would make it whole."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        found = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        least = min(found)
        if least == NEVER:
            break
        at = found.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def encode_word(word: Column, merges: Merges, pairs: Column, first: Column) -> Column:
    """Numbers of one pre-token (its bytes, each plus one, and a closing 0): a fold that joins the leftmost
    pair of the lowest rank until no adjacent pair has a rank.

    State: one array of the symbols and, between each two, the rank of their pair, within an edge
    symbol on either side. The lowest value of the array is the next rank, its place the next merge.
    """
    n = F.size(word) - 1
    edge, none = F.lit(merges.edge).cast("long"), F.lit(merges.NONE).cast("long")

    def rank_of(key: Column) -> Column:
        return F.coalesce(pairs[(key % merges.n_buckets).cast("int")][key], none)

    def step(state: Column, _: Column) -> Column:
        def merge(at: Column) -> Column:
            joined = state[at - 1] + (merges.shift + 257)
            return F.concat(
                F.slice(state, F.lit(1), at - 3),
                F.array(rank_of(state[at - 4] * merges.base + joined), joined, rank_of(joined * merges.base + state[at + 2])),
                F.slice(state, at + 3, F.size(state)),
            )

        least = F.array_min(state)
        return F.when(least == merges.NONE, state).otherwise(_bound(F.array_position(state, least).cast("int"), merge))

    inner = F.flatten(F.zip_with(F.slice(word, F.lit(1), n), F.slice(word, F.lit(2), n), lambda x, y: F.array(x, first[(x * 257 + y).cast("int")])))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.concat(F.array(edge, none), inner, F.array(edge)), step)
    return F.array_remove(F.array_remove(folded, merges.NONE), merges.edge)


def encode_long_word(word: Column, ranked: Column, plane: int) -> Column:
    """Numbers of one very long pre-token (its bytes, the same as symbols, and the distinct ones of these): a fold over the merges that may occur."""
    able = F.filter(ranked, lambda m: (F.call_function("translate", m["letters"], word["letters"], F.lit("")) == "") & F.contains(word["bytes"], m["token"]))
    folded = F.aggregate(able, word["symbols"], lambda s, m: F.replace(s, m["pair"], m["joined"]))
    return _bound(folded, lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1))).cast("long") - plane))


#: The broadcast memo that this Python worker has read last, and the places of its words.
_READ: list = [None, {}]


def _words_of(shared) -> dict[str, int]:
    """Places of a memo's words, listed once a worker and not once a task."""
    if shared is not None and _READ[0] is not shared:
        _READ[:] = [shared, {word.as_py(): k for k, word in enumerate(shared.value.column("word"))}]
    return _READ[1] if shared is not None else {}


def word_blocks(docs: DataFrame, id_col: str, text_col: str, pattern: str, block_bytes: int, known: pa.Table | None, long: int, plane: int) -> DataFrame:
    """Blocks of documents: the distinct pre-tokens of a block and each document's words as places
    among them: known words come first, then those to be folded, then the very long ones. A block
    ends once its texts reach ``block_bytes``."""
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"docs array<struct<id:{key},at:array<int>>>, known_text array<string>, known_hex array<string>, words array<array<bigint>>, long array<struct<bytes:binary,symbols:string,letters:string>>"
    shared = docs.sparkSession.sparkContext.broadcast(known) if known is not None and known.num_rows else None

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known_words = regex.compile(pattern).findall, _words_of(shared)
        ids, at, ends, size = [], array("i"), [0], 0

        class Places(dict):
            """Three times the place within its kind, and the kind: 0 known, 1 to fold, 2 very long."""

            def __init__(self):
                self.kinds: tuple[list, list, list] = ([], [], [])

            def __missing__(self, word: str) -> int:
                if (memoed := known_words.get(word)) is not None:
                    kind, value = 0, memoed
                else:
                    value = word.encode()
                    kind = 2 if len(value) > long else 1
                self[word] = n = 3 * len(self.kinds[kind]) + kind
                self.kinds[kind].append(value)
                return n

        places = Places()

        def spell(word) -> str:
            return "".join(chr(plane + b + 1) for b in word)

        def listed(values: list, kind: pa.DataType) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

        def memo(name: str, at: list[int]) -> pa.ListArray:
            found = shared.value.column(name).combine_chunks().take(pa.array(at, pa.int64())) if at else pa.array([], pa.string())
            return pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), found)

        def block() -> pa.RecordBatch:
            memoed, fold, lengthy = places.kinds
            code = np.frombuffer(at, np.int32) if len(at) else np.zeros(0, np.int32)
            place = code // 3 + np.array([0, len(memoed), len(memoed) + len(fold)])[code % 3]
            inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place.astype(np.int32)))
            rows = pa.StructArray.from_arrays([pa.array(ids, id_type), inner], ["id", "at"])
            raw = np.frombuffer(b"\0".join([*fold, b""]), np.uint8).astype(np.int64) + 1
            stops = np.cumsum([len(w) + 1 for w in fold], dtype=np.int64)
            raw[stops - 1] = 0
            words = pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), pa.array(raw))
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), rows), memo("text", memoed), memo("hex", memoed),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), listed([{"bytes": w, "symbols": spell(w), "letters": spell(sorted(set(w)))} for w in lengthy], pa.struct([("bytes", pa.binary()), ("symbols", pa.string()), ("letters", pa.string())])),
                ],
                ["docs", "known_text", "known_hex", "words", "long"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(key)
                at.extend(map(places.__getitem__, find(text)))
                ends.append(len(at))
                size += len(text) + 64
                if size >= block_bytes:
                    yield block()
                    ids, at, ends, size, places = [], array("i"), [0], 0, Places()
        if ids:
            yield block()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(blocks, schema)


def frequent_words(docs: DataFrame, pattern: str, text_col: str = "text", most: int = 262_144, sample_chars: int = 64_000_000) -> DataFrame:
    """``word``: pre-tokens that occur at least twice in a sample of about ``sample_chars`` characters, the
    most frequent ones, ``most`` at most and none of over SHARED_BYTES."""
    from .lm import most_frequent

    size = F.length(text_col)
    total = docs.agg(F.sum(size).alias("n")).first()["n"] or 0
    share = min(1.0, sample_chars / max(total, 1))
    drawn = docs.where(F.pmod(F.xxhash64(F.substring(text_col, 1, 64), size), F.lit(1 << 20)) < int(share * (1 << 20)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, found = regex.compile(pattern).findall, Counter()

        def rows() -> pa.RecordBatch:
            kept = [(w, n) for w, n in found.items() if len(w) <= SHARED_BYTES and len(w.encode()) <= SHARED_BYTES]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                found.update(find(text.as_py() or ""))
                if len(found) > 150_000:
                    yield rows()
                    found = Counter()
        yield rows()

    counts = stored(drawn.select(text_col).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    return most_frequent(counts.where("n > 1"), most)


def known_words(docs: DataFrame, merges: Merges, pattern: str, text_col: str = "text", most: int = 262_144, sample_chars: int = 64_000_000) -> pa.Table:
    """``word``, ``text`` and ``hex`` of the shared words: encoded by the fold, or tokens that it doesn't give."""
    plain = [(t.decode(), str(r), t.hex()) for t, r in merges.unmade.items() if _is_text(t)]
    fixed = pa.table({name: pa.array([x[i] for x in plain], pa.string()) for i, name in enumerate(("word", "text", "hex"))})
    if not most:
        return fixed
    words = frequent_words(docs, pattern, text_col, most, sample_chars).select("word").repartition(32, "word")
    rows = _per_doc(words, merges, r"(?s:.+)", "word", "word", 1 << 21, fixed, lambda parts, spelled: F.struct(F.array_join(parts, "").alias("text"), F.array_join(spelled, "").alias("hex")))
    return pa.concat_tables([fixed, rows.toArrow().select(["word", "text", "hex"]).cast(fixed.schema)])


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 12_000_000, shared: int = 0) -> DataFrame:
    """One row per document: its id, ``ids`` array<int> and ``decoded`` binary."""
    merges = Merges(ranks)
    known = known_words(docs, merges, pattern, text_col, shared)

    def result(parts: Column, spelled: Column) -> Column:
        ids = F.filter(F.split(F.array_join(parts, " "), " "), lambda x: x != "").cast("array<int>")
        return F.struct(ids.alias("ids"), F.unhex(F.array_join(spelled, "")).alias("decoded"))

    return _per_doc(docs, merges, pattern, id_col, text_col, block_bytes, known, result)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 12_000_000, shared: int = 262_144) -> DataFrame:
    """One row per document: its id, ``n_tokens``, and SHA-256 of the ids' text and of the decoded bytes."""
    merges = Merges(ranks)
    known = known_words(docs, merges, pattern, text_col, shared)

    def result(parts: Column, spelled: Column) -> Column:
        return _bound(
            F.array_join(parts, " "),
            lambda text: F.struct(
                F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_tokens"),
                F.sha2(text.cast("binary"), 256).alias("ids_sha256"),
                F.sha2(F.unhex(F.array_join(spelled, "")), 256).alias("decoded_sha256"),
            ),
        )

    return _per_doc(docs, merges, pattern, id_col, text_col, block_bytes, known, result)


def _per_doc(docs: DataFrame, merges: Merges, pattern: str, id_col: str, text_col: str, block_bytes: int, known: pa.Table | None, of_doc) -> DataFrame:
    """``of_doc`` gives a struct from a document's words: the decimal ids of each, joined by blanks, and the
    bytes that those ids stand for, in hexadecimal."""
    if not merges.rising:
        long = 1 << 31  # without that order of ranks only one place after another is right
    else:
        long = LONG
    blocks = word_blocks(docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")), "_key", "_text", pattern, block_bytes, known, long, merges.plane)

    def rows_of(words: Column) -> Column:
        def rows(text: Column, spelled: Column) -> Column:
            return F.transform("docs", lambda doc: F.struct(doc["id"].alias("id"), of_doc(F.transform(doc["at"], lambda i: text[i]), F.transform(doc["at"], lambda i: spelled[i])).alias("result")))

        return _bound(words["text"], lambda text: _bound(words["hex"], lambda spelled: rows(text, spelled)))

    def encoded(tables: Column) -> Column:
        short = _bound(tables["pairs"], lambda pairs: _bound(tables["first"], lambda first: F.transform("words", lambda w: encode_word(w, merges, pairs, first))))
        lengthy = F.when(F.size("long") > 0, _bound(merges.ranked(), lambda ranked: F.transform("long", lambda w: encode_long_word(w, ranked, merges.plane)))).otherwise(F.array().cast("array<array<bigint>>"))
        return _bound(F.concat(short, lengthy), lambda numbers: F.struct(F.concat("known_text", written(numbers, tables["text"], " ")).alias("text"), F.concat("known_hex", written(numbers, tables["hex"], "")).alias("hex")))

    words = _bound(merges.parsed(), encoded)
    blocks = blocks.crossJoin(F.broadcast(merges.stored(docs.sparkSession)))
    return blocks.select(F.explode(_bound(words, rows_of)).alias("row")).select(F.col("row.id").alias(id_col), "row.result.*")


def written(numbers: Column, table: Column, between: str) -> Column:
    """For each word, what its numbers stand for in ``table``: decimal ids, or pieces of bytes in hexadecimal."""
    return F.transform(numbers, lambda word: F.array_join(F.transform(word, lambda n: table[n.cast("int")]), between))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ``ids`` stand for: their pieces, concatenated."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    return _bound(F.from_json(F.when(ids.isNotNull(), F.lit(json.dumps(pieces))), "array<string>"), lambda table: F.unhex(F.array_join(F.transform(ids, lambda i: table[i]), "")))
