"""Titles in a reader's order and files written and read back, over customers, nations and orders, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.checkpoints import fresh_folder
from docloom.operators import collated
from docloom.sources import filetree

from .catalog_queries import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Titles in Chinese and Latin letters with numbers.
_TITLES = """w AS (SELECT c_nationkey AS book, c_custkey AS id, ['第', '章节', 'Résumé ', 'zebra', '附录', 'Anhang_', '说明 ', '图'][CAST(c_custkey % 8 + 1 AS BIGINT)] || (c_custkey * 7 % 120) ||
  ['', '部分', '.', '.0', '.' || c_custkey % 5][CAST(c_custkey % 5 + 1 AS BIGINT)] || [' 王', ' 李', ' 张', '', ' a', ' B'][CAST(c_custkey * 5 % 6 + 1 AS BIGINT)] AS title FROM customer)"""


def _titles(spark, d):
    key = F.col("c_custkey")
    pick = lambda n, *of: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in of]), (n + 1).cast("int"))
    title = F.concat(pick(key % 8, "第", "章节", "Résumé ", "zebra", "附录", "Anhang_", "说明 ", "图"), (key * 7 % 120).cast("string"), pick(key % 5, "", "部分", ".", ".0", F.concat(F.lit("."), (key % 5).cast("string"))), pick(key * 5 % 6, " 王", " 李", " 张", "", " a", " B"))
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("book"), key.alias("id"), title.alias("title"))


@query(f"WITH {_TITLES} SELECT book, id, title, row_number() OVER (PARTITION BY book ORDER BY title COLLATE zh, id) AS place FROM w")
def collated_titles(spark, d):
    return collated.ranked(_titles(spark, d), "book", [collated.in_language(F.col("title")), F.col("id")]).select("book", "id", "title", "place")


@query(f"""WITH {_TITLES}, n AS (SELECT *, list_concat(list_transform(regexp_extract_all(title, '[0-9]+'), lambda x: CAST(x AS DOUBLE)), [0.0, 0.0, 0.0])[1:3] AS numbers FROM w)
SELECT book, id, row_number() OVER (PARTITION BY book ORDER BY numbers, title COLLATE zh, id) AS place FROM n""")
def natural_titles(spark, d):
    return collated.ranked(_titles(spark, d), "book", [*collated.natural(F.col("title")), F.col("id")]).select("book", "id", "place")


_FOLDERS = """['中文', 'Deutsch', 'annex', '附件', 'Zoo'][CAST(book % 5 + 1 AS BIGINT)]"""


@query(f"""WITH {_TITLES}, p AS (SELECT id, title, CASE WHEN id % 4 = 0 THEN [] WHEN id % 4 = 1 THEN [{_FOLDERS}] ELSE [{_FOLDERS}, '卷' || id % 3, 'x' || id % 2][1 : id % 4] END AS parts FROM w),
f AS (SELECT DISTINCT parts[1 : k] AS parts FROM p, range(1, 4) g(k) WHERE k <= len(parts)),
n AS (SELECT parts, CAST(NULL AS BIGINT) AS id, parts[len(parts)] AS name, len(parts) - 1 AS depth FROM f UNION ALL SELECT parts, id, title, len(parts) FROM p),
s AS (SELECT n.*, CASE WHEN id IS NULL THEN (SELECT count(*) FROM p WHERE p.parts[1 : len(n.parts)] = n.parts) ELSE 1 END AS n_files FROM n)
SELECT row_number() OVER (ORDER BY
    CASE WHEN id IS NULL OR len(parts) >= 1 THEN 0 ELSE 1 END, CASE WHEN len(parts) >= 1 THEN parts[1] ELSE name END COLLATE zh, CASE WHEN len(parts) = 0 THEN id ELSE 0 END,
    CASE WHEN id IS NULL AND len(parts) = 1 THEN 0 WHEN len(parts) = 1 THEN 2 ELSE 1 END, CASE WHEN len(parts) >= 2 THEN parts[2] ELSE name END COLLATE zh, CASE WHEN len(parts) = 1 THEN id ELSE 0 END,
    CASE WHEN id IS NULL AND len(parts) = 2 THEN 0 WHEN len(parts) = 2 THEN 2 ELSE 1 END, CASE WHEN len(parts) >= 3 THEN parts[3] ELSE name END COLLATE zh, CASE WHEN len(parts) = 2 THEN id ELSE 0 END,
    CASE WHEN id IS NULL THEN 0 ELSE 1 END, name COLLATE zh, id) - 1 AS number, depth, name, coalesce(id, -1) AS id, n_files FROM s""")
def title_tree(spark, d):
    book = F.element_at(F.array(*map(F.lit, ("中文", "Deutsch", "annex", "附件", "Zoo"))), (F.col("book") % 5 + 1).cast("int"))
    parts = F.array(book, F.concat(F.lit("卷"), (F.col("id") % 3).cast("string")), F.concat(F.lit("x"), (F.col("id") % 2).cast("string")))
    path = F.concat_ws("/", F.slice(parts, F.lit(1), (F.col("id") % 4).cast("int")))
    return collated.file_tree(_titles(spark, d).withColumn("path", path), "id", "path", "title").withColumn("id", F.coalesce("id", F.lit(-1)))


@query("""WITH p AS (SELECT o_orderkey AS id, 'c' || o_custkey % 40 || '/' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '.md' END AS base, o_orderstatus || ' é ' || o_orderkey AS content FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) - 1 AS k FROM p)
SELECT CASE WHEN k = 0 THEN base WHEN base LIKE '%.md' THEN replace(base, '.md', ' (' || k || ').md') ELSE base || ' (' || k || ')' END AS path, CAST(strlen(content) AS BIGINT) AS n_bytes, sha256(content) AS sha256 FROM n""")
def file_sink(spark, d):
    """Each order a file; many share a name. They are tiny, so they are packed. What comes back is read from the archives, not from the table."""
    key = F.col("o_orderkey")
    base = F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string"), F.lit("/"), "o_orderpriority", F.when(key % 3 == 0, "").otherwise(".md"))
    rows = t(spark, d, "orders").select(key.alias("id"), base.alias("path"), F.concat("o_orderstatus", F.lit(" é "), key.cast("string")).alias("content"))
    folder = fresh_folder(spark, "files")
    filetree.write_files(filetree.with_unique_paths(rows, "id"), folder, packed=True)
    found = filetree.read_files(spark, folder)
    return found.select("path", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
