"""Tables of contents and cards out of pages, which are made from regions, nations, suppliers and orders; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import extract, listing

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


def _toc_pages(spark, d):
    """A page for each nation, with two payloads that say nothing or, for every third, the page's state."""
    supplier, nation = t(spark, d, "supplier"), t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct(F.concat(F.lit("s"), "s_suppkey").alias("uuid"), F.concat(F.lit("n"), "s_nationkey").alias("parent_uuid"), F.lit("DOC").alias("type"), "s_suppkey", F.concat("s_name", F.lit(" +%")).alias("title"), F.col("s_suppkey").alias("doc_id"))
    docs = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(entry)).alias("docs"))
    folder = lambda u, p, title: F.struct(F.concat(F.lit(u[0]), u[1]).alias("uuid"), p.alias("parent_uuid"), F.lit("TITLE").alias("type"), title.alias("title"))
    folders = F.array(folder(("r", F.concat("n_nationkey", F.lit("."), "n_regionkey")), F.lit(""), F.concat("r_name", F.lit(" + x"))), folder(("n", F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), "n_nationkey", F.lit("."), "n_regionkey"), F.col("n_name")))
    whole = nation.join(docs, "n_nationkey", "left").select(F.col("n_nationkey").alias("page"), F.to_json(folders).alias("a"), F.coalesce(F.to_json("docs"), F.lit("[]")).alias("b"))
    toc = F.concat(F.substring_index("a", "]", 1), F.when(F.col("b") != "[]", F.lit(",")).otherwise(""), F.expr("substring(b, 2)"))
    book = F.concat(F.lit('{"book":{"toc":'), toc, F.lit("}}"))
    encoded = F.replace(F.url_encode(book), F.lit("+"), F.lit("%20"))
    payload = F.concat(F.lit('<script>x = decodeURIComponent("%7Bbroken"); y = decodeURIComponent("%7B%22book%22%3A%7B%7D%7D"); z = JSON.parse(decodeURIComponent("'), encoded, F.lit('"))</script>'))
    state = F.concat(F.lit("<script>window.__INITIAL_STATE__ = "), F.replace(book, F.lit('"book"'), F.lit('"repository"')), F.lit(" ;</script>"))
    return whole.select("page", F.when(F.col("page") % 3 == 0, state).otherwise(payload).alias("html"))


@query(r"""SELECT CAST(s_nationkey AS BIGINT) AS page, s_suppkey AS doc_id, regexp_replace(r_name || ' + x', ' ', '_', 'g') || '/' || replace(n_name, ' ', '_') AS path, s_name || ' +%' AS title
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def page_tocs(spark, d):
    rows = extract.toc_rows(_toc_pages(spark, d), "page", "html")
    paths = listing.doc_paths(rows, listing.toc_paths(rows))
    docs = rows.where("type = 'DOC'").select(F.col("page").cast("long").alias("page"), "doc_id", "title")
    return listing.with_paths(docs, paths, "doc_id").select("page", "doc_id", "path", "title")


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord FROM orders)
SELECT doc, CAST(ord AS INTEGER) AS ord, CASE WHEN k % 3 = 2 THEN 'image' ELSE 'math' END AS name, CASE WHEN k % 3 = 0 THEN k || '" & <b' ELSE 'data:' || k END AS value, CASE WHEN k % 2 = 0 THEN 'i' || k ELSE '' END AS id FROM o""")
def page_cards(spark, d):
    """Documents with a card for each order, some with attributes that were escaped twice."""
    key = F.col("o_orderkey")
    name = F.when(key % 3 == 0, "\\&quot;math\\&quot;").when(key % 3 == 1, "math").otherwise(" image ")
    value = F.when(key % 3 == 0, F.format_string('\\&quot;%d\\&quot; &amp; &#60;b', key)).otherwise(F.format_string("data:%d", key))
    own = F.when(key % 2 == 0, F.format_string(' id="i%d"', key)).otherwise("")
    card = F.concat(F.lit('<p>a<card type="inline" name="'), name, F.lit('" value="'), value, F.lit('"'), own, F.when(key % 2 == 0, "></card></p>").otherwise("/></p>"))
    docs = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, card.alias("c")))), lambda x: x["c"]), "\\n").alias("html"))
    docs = docs.withColumn("html", F.concat(F.lit('<!DOCTYPE lake><meta name="doc-version">'), "html"))
    return extract.cards(docs, "doc", "html", ["name", "value", "id"])
