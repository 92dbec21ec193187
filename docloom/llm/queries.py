"""The queries of the training-data operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, codes, covertree, langid, lm, packing, quality, resampling, similar, simhash, token_counts, warc, windows
from .common import bucket_of, shared_dir, stored, table

#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covertree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = bucket_of("doc_id", 4) == 2
    model = langid.train(docs.where(~held))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")


def op4_log_bilinear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = bucket_of("doc_id", 10) == 0
    training = docs.where(~held)
    counts = stored(lm.count_words(training), "counts")
    model = lm.train(training, counts)
    scored = lm.score(docs, model, counts, keep={"held_out": held})
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def page_of(record: Column) -> Column:
    return F.regexp_extract(record, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.with_revisits(table(spark, sf_dir, "pages"), "page_id", F.col("html"), least_bytes=0)
    response = F.col("original").isNull()
    records = pages.select(
        record_id(F.col("page_id")).alias("record_id"),
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"),
        record_id(F.col("original")).alias("refers_to"),
        "payload_bytes",
        F.when(response, F.col("payload")).alias("payload"),
    )
    path = shared_dir(spark, "warc")
    warc.write_warc(records, path)
    # responses are read whole: bytes and digest come from the payload that the archive holds;
    # revisits are picked by a predicate on the record's header and their payload is never asked for
    read = warc.read_warc(spark, path).where("record_type = 'response'")
    responses = read.select(page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), warc.base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long"
    revisits = warc.read_warc(spark, path, heads).where("record_type = 'revisit'")
    revisits = revisits.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to"))
    return responses.unionAll(revisits)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def packed(docs: DataFrame) -> DataFrame:
    """Bins of 2,048 tokens (words and an end); a bin holds no source twice and no two texts of one
    group of near copies (5-word Jaccard similarity of 0.8 or more, also by chains)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    length = F.regexp_count(text, F.lit(WORD)) + 1
    # the row stands for its id, so that rows without an id and rows of one id have groups of their own
    row = F.struct("doc_id", length.alias("length"), F.col("source").cast("string").alias("source"), F.md5(text.cast("binary")).alias("copy"))
    found = similar.groups(docs.select(row.alias("row"), "text"), least=0.8, width=5, id_col="row")
    rows = found.select("row.doc_id", "row.length", "row.source", F.col("component_id.copy").alias("cluster"))
    return packing.pack(rows, F.col("length"), F.col("source"), F.col("cluster"), capacity=2048)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op8_projection_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = bucket_of("doc_id", 4) == 2
    net = quality.train(docs, table(spark, sf_dir, "labels"), usable=~held)
    scored = quality.score(docs, net)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5)


def op12_partial_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


def op13_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_byte_bpe, op2_cover_tree_dedup, op3_language_mixture, op4_log_bilinear_score, op5_warc_round_trip, op6_token_counts, op7_best_fit_packing, op8_projection_neighbours, op9_simhash_balls, op10_pu_quality, op11_importance_resampling, op12_partial_distance_codes, op13_sum_of_squares_packing]
    return {f.__name__: f for f in found}


#: DuckDB: base32 of the SHA-1 from eight groups of five hexadecimal digits.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
b AS (
  SELECT page_id, payload_bytes, x, max(page_id) OVER (PARTITION BY x) AS latest,
    array_to_string(list_transform(range(8), lambda i: translate(
      to_base(CAST('0x' || substr(x, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT), 32, 4),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest
  FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM b
"""


#: DuckDB: words of a text, and a feature's bucket, found once: crc32 goes byte by byte through the table of its polynomial.
OP11_SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS steps),
texts AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 0, NULL, text FROM benchmark),
docs AS MATERIALIZED (
  SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
features AS MATERIALIZED (
  SELECT r, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS f
  FROM docs, range(1, 4) g(n)),
buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT)),
    lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS x FROM features) d, crc),
found AS MATERIALIZED (SELECT r, bucket, count(*) AS n FROM features JOIN buckets USING (f) GROUP BY r, bucket),
counts AS (SELECT bucket, CAST(sum(n) FILTER (r > 0) AS DOUBLE) AS s, CAST(sum(n) FILTER (r = 0) AS DOUBLE) AS t FROM found GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((coalesce(s, 0) + 1) * (all_t + 10000)))) AS BIGINT) AS gain
  FROM counts, totals),
weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM found JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('42:', doc_id)), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (r) WHERE r > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""


def op12_sql(rounds: int = 6) -> str:
    """DuckDB: a round is one assignment of all parts by the least (distance, entry) and new means."""
    assigned = """(SELECT vec_id, label, p, v, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + e) AS k
      FROM parts JOIN book{0} USING (p) GROUP BY ALL)"""
    book = """book{1} AS MATERIALIZED (
      SELECT p, e, coalesce(m, c) AS c FROM book{0} LEFT JOIN (
        SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS m FROM (
          SELECT p, k % 16 AS e, j, sum(v[j]) AS s, count(*) AS n FROM """ + assigned + """ a, range(1, 9) g(j) GROUP BY ALL) t
        GROUP BY p, e) u USING (p, e))"""  # fmt: skip
    return f"""
    WITH whole AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, label, CAST(p AS BIGINT) AS p, v[8 * p + 1 : 8 * p + 8] AS v FROM whole, range(8) g(p)),
    book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM parts QUALIFY e < 16),
    {", ".join(book.format(k, k + 1) for k in range(rounds))},
    final AS (
      SELECT vec_id, label, string_agg(lower(lpad(hex(CAST(k % 16 AS BIGINT)), 2, '0')), '' ORDER BY p) AS code, CAST(sum(k // 16) AS BIGINT) AS error
      FROM {assigned.format(rounds)} a GROUP BY vec_id, label),
    digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM final, digest
    """


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_round_trip": OP5_SQL, "op11_importance_resampling": OP11_SQL, "op12_partial_distance_codes": op12_sql()}
