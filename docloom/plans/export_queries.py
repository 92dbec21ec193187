"""Queries of an export's work items over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import files, geometry, jobs

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


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'deferred' ELSE 'failed' END"
_RETRY = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 1000 END"


def _items(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.expr(_STATUS).alias("status"), F.expr(_RETRY).alias("next_retry"), F.col("o_orderpriority").alias("error"), (F.col("o_custkey") % 4).cast("int").alias("defer_count"), (F.col("o_custkey") % 3).cast("int").alias("hard_interrupts"))


@query(f"""WITH o AS (SELECT o_orderkey, {_STATUS} AS status, {_RETRY} AS next_retry FROM orders)
SELECT o_orderkey, CASE WHEN status = 'deferred' AND (next_retry IS NULL OR next_retry <= 500) THEN 'pending' ELSE status END AS status,
CASE WHEN status = 'deferred' AND (next_retry IS NULL OR next_retry <= 500) THEN 0 ELSE coalesce(next_retry, -1) END AS next_retry FROM o""")
def due_released(spark, d):
    return jobs.release_due(_items(spark, d), F.lit(500)).select("o_orderkey", "status", F.coalesce("next_retry", F.lit(-1)).alias("next_retry"))


@query(f"""WITH o AS (SELECT *, {_STATUS} AS s FROM orders)
SELECT o_orderkey, CASE WHEN s = 'success' THEN s ELSE 'pending' END AS start_status, CASE WHEN s = 'success' THEN o_orderpriority ELSE '' END AS start_error,
CASE WHEN s = 'failed' THEN 'pending' ELSE s END AS retry_status, CAST(CASE WHEN s = 'failed' THEN 0 ELSE o_custkey % 4 END AS INT) AS retry_defer_count,
CASE WHEN s = 'failed' THEN -1 ELSE coalesce({_RETRY}, -1) END AS retry_next FROM o""")
def status_reset(spark, d):
    rows = _items(spark, d)
    start = jobs.reset(rows, F.col("status") != "success").select("o_orderkey", F.col("status").alias("start_status"), F.coalesce("error", F.lit("")).alias("start_error"))
    retry = jobs.reset(rows, F.col("status") == "failed").select("o_orderkey", F.col("status").alias("retry_status"), F.col("defer_count").alias("retry_defer_count"), F.coalesce("next_retry", F.lit(-1)).alias("retry_next"))
    return start.join(retry, "o_orderkey")


@query("SELECT CAST(count_if(NOT event_type = 'click') AS BIGINT) AS repos, CAST(count_if(event_type = 'click') AS BIGINT) AS bookmarks FROM events")
def repo_counts(spark, d):
    return t(spark, d, "events").agg(F.count_if(F.col("event_type") != "click").alias("repos"), F.count_if(F.col("event_type") == "click").alias("bookmarks"))


@query("SELECT CAST(coalesce(sum(s_suppkey % 17), 0) AS BIGINT) AS docs FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 2")
def selected_docs(spark, d):
    chosen = t(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return t(spark, d, "supplier").join(chosen, "s_nationkey").agg(F.coalesce(F.sum(F.col("s_suppkey") % 17), F.lit(0)).alias("docs"))


_TYPE = "CASE doc_id % 6 WHEN 0 THEN 'Doc' WHEN 1 THEN 'Sheet' WHEN 2 THEN 'Table' WHEN 3 THEN 'Board' WHEN 4 THEN '' ELSE 'Thread' END"


@query(f"""WITH f AS (SELECT doc_id AS id, CASE WHEN lang = 'de' THEN '' ELSE source END AS title, coalesce(nullif({_TYPE}, ''), 'Doc') AS type, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'c' || n_chars END AS c, 'u' || n_chars AS u FROM documents)
SELECT id, coalesce(nullif(title, ''), '未命名文档') AS title, type, coalesce(nullif(c, ''), u) AS updated_at FROM f WHERE type IN ('Doc', 'Sheet', 'Table', 'Board')""")
def file_projection(spark, d):
    n = F.col("n_chars").cast("string")
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", "").otherwise(F.col("source")).alias("title"), F.expr(_TYPE).alias("type"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("c"), n)).alias("content_updated_at"), F.concat(F.lit("u"), n).alias("updated_at"))
    return files.listed_files(docs)


_BOOK = "CASE c_custkey % 6 WHEN 0 THEN 'personal' WHEN 1 THEN 'collab' WHEN 2 THEN 'team' WHEN 3 THEN 'wiki' WHEN 4 THEN 'org-personal' ELSE 'other' END"
_ORG = "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END"
_GROUP = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'G: ' || c_nationkey END"


@query(f"""WITH b AS (SELECT c_custkey, {_BOOK} AS kind, 'Book ' || replace(c_name, '#', '_') AS name, coalesce(nullif({_ORG}, ''), '团队空间') AS org, coalesce({_GROUP}, '团队') AS grp FROM customer),
s AS (SELECT *, replace(name, ' ', '_') AS n, regexp_replace(replace(grp, ':', '_'), '[_ ]+', '_', 'g') AS g FROM b)
SELECT c_custkey, CASE kind WHEN 'personal' THEN '个人空间/我个人的/' WHEN 'collab' THEN '个人空间/邀请协作的/' WHEN 'team' THEN org || '/' || g || '/' WHEN 'wiki' THEN org || '/公共区/' WHEN 'org-personal' THEN org || '/我个人的/' ELSE '' END || n AS folder,
kind IN ('collab', 'team', 'org-personal', 'wiki') OR c_nationkey = 3 AS needs_permission FROM s JOIN customer USING (c_custkey)""")
def book_folders(spark, d):
    kind = F.expr(_BOOK)
    folder = files.book_folder(kind, F.concat(F.lit("Book "), F.replace("c_name", F.lit("#"), F.lit("_"))), F.expr(_ORG), F.expr(_GROUP))
    return t(spark, d, "customer").select("c_custkey", folder.alias("folder"), files.needs_permission(F.col("c_nationkey") == 3, kind).alias("needs_permission"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'my out' END AS sub, p_brand AS book, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'a b//' || p_type END AS folder, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name || '?' END AS title FROM part),
s AS (SELECT *, replace(sub, ' ', '_') AS s1, replace(replace(book, '#', '#'), ' ', '_') AS s2, replace(replace(coalesce(folder, ''), 'a b//', 'a_b/'), ' ', '_') AS s3, replace(replace(title, '?', '_'), ' ', '_') AS s4 FROM p)
SELECT p_partkey, concat_ws('/', nullif(s1, ''), nullif(s2, ''), nullif(s3, ''), coalesce(nullif(s4, ''), '未命名文档') || '.md') AS file_path, concat_ws('/', nullif(s1, ''), nullif(s2, ''), nullif(s3, ''), 'assets/img 1.png') AS image_path,
coalesce(nullif(concat_ws('/', nullif(folder, ''), nullif(title, '')), ''), '-') AS display_path FROM s""")
def export_paths(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_size % 3 = 0 THEN '' ELSE 'my out' END").alias("sub"), F.col("p_brand").alias("book"), F.expr("CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'a b//' || p_type END").alias("folder"), F.expr("CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name || '?' END").alias("title"))
    parts = [F.col("sub"), F.col("book"), F.col("folder")]
    return rows.select("p_partkey", files.file_path(parts, F.col("title"), F.lit("md")).alias("file_path"), files.image_path(parts, F.lit("assets/img 1.png")).alias("image_path"), files.display_path([F.col("folder"), F.col("title")]).alias("display_path"))


#: Full-width and other compatibility forms, as most titles have them, and what they are unified to.
_WIDE, _PLAIN = "：？（）＊．／ＡＢｃ　①", ":?()*./ABc 1"
_WIDE_TITLE = "['问：答？（一）', '第　章', 'ＡＢｃ①', '文档．', '／a／', 'plain'][CAST(p_partkey % 6 + 1 AS BIGINT)]"


@query(f"""WITH w AS (SELECT p_partkey, {_WIDE_TITLE} || p_size AS title, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '卷：' || p_size % 3 || '/附／录//' || p_brand END AS folder FROM part),
u AS (SELECT p_partkey, translate(title, '{_WIDE}', '{_PLAIN}') AS title, array_to_string(list_transform(string_split(folder, '/'), lambda s: translate(s, '{_WIDE}', '{_PLAIN}')), '|') AS folder FROM w),
s AS (SELECT p_partkey, regexp_replace(regexp_replace(title, '[/:?*]', '_', 'g'), '[ _]+', '_', 'g') AS title,
  replace(regexp_replace(replace(regexp_replace(folder, '[/:?*]', '_', 'g'), '||', '|'), '[ _]+', '_', 'g'), '|', '/') AS folder FROM u)
SELECT p_partkey, '个人空间/我个人的/' || title AS folder, concat_ws('/', nullif(folder, ''), title || '.md') AS file_path, concat_ws('/', nullif(folder, ''), 'assets/图 1.png') AS image_path FROM s""")
def unified_paths(spark, d):
    size = F.col("p_size").cast("string")
    title = F.concat(F.element_at(F.array(*map(F.lit, ("问：答？（一）", "第　章", "ＡＢｃ①", "文档．", "／a／", "plain"))), (F.col("p_partkey") % 6 + 1).cast("int")), size)
    folder = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("卷："), (F.col("p_size") % 3).cast("string"), F.lit("/附／录//"), "p_brand"))
    rows = t(spark, d, "part").select("p_partkey", title.alias("title"), folder.alias("path"))
    none = F.lit(None).cast("string")
    book = files.book_folder(F.lit("personal"), F.col("title"), none, none)
    return rows.select("p_partkey", book.alias("folder"), files.file_path([F.col("path")], F.col("title"), F.lit("md")).alias("file_path"), files.image_path([F.col("path")], F.lit("assets/图 1.png")).alias("image_path"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'given/' || c_custkey WHEN c_nationkey = 7 THEN '' WHEN c_custkey % 2 = 0 THEN c_mktsegment || '/b' || c_nationkey ELSE c_name || '/b' || c_nationkey END AS namespace FROM customer""")
def namespaces(spark, d):
    key = F.col("c_custkey")
    given = F.when(key % 3 == 0, F.concat(F.lit("given/"), key.cast("string"))).otherwise("")
    logins = [F.when(key % 2 == 0, F.col("c_mktsegment")), F.col("c_name")]
    slug = F.when(F.col("c_nationkey") != 7, F.concat(F.lit("b"), F.col("c_nationkey").cast("string")))
    return t(spark, d, "customer").select("c_custkey", files.namespace(given, logins, slug).alias("namespace"))


_LONG = "CASE page_id % 4 WHEN 0 THEN 'data:image/png;base64,AA' WHEN 1 THEN url || repeat('z', 120) WHEN 2 THEN '/x/' || page_id ELSE url || '&x-oss-process=image%2Fwatermark%2Cabc&k=1' END"


@query(rf"""WITH u AS (SELECT page_id, url, {_LONG} AS long_url, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, NOT regexp_matches(path, '(?i)^/(dashboard|settings|explore|notifications|search|login|register|account|new)') AND NOT regexp_matches(path, '(?i)^/(api|r)/') AND len(list_filter(string_split(path, '/'), lambda s: s <> '')) >= 3 AS is_document,
CASE WHEN long_url LIKE 'http%' THEN long_url WHEN long_url LIKE '/%' THEN 'https://www.yuque.com' || long_url ELSE 'https://www.yuque.com/' || long_url END AS absolute_url,
regexp_replace(long_url, 'x-oss-process=image%2Fwatermark%2C[^&]*', '') AS clean_url,
CASE WHEN long_url LIKE 'data:%' THEN 'data:...' WHEN length(long_url) > 120 THEN substr(long_url, 1, 117) || '...' ELSE long_url END AS summary,
coalesce(nullif(substr(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'x') AS svg_id FROM u""")
def url_texts(spark, d):
    url = F.expr(_LONG)
    return t(spark, d, "pages").select("page_id", files.is_document_url(F.col("url")).alias("is_document"), files.absolute_url(url).alias("absolute_url"), files.without_watermark(url).alias("clean_url"), files.url_summary(url).alias("summary"), files.svg_id(F.col("url")).alias("svg_id"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN o_custkey % 1000 ELSE o_orderkey * 13 END AS ms FROM orders)
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, CASE WHEN coalesce(ms, 0) <= 0 THEN '-' WHEN ms < 1000 THEN ms || ' ms' ELSE printf('%.2f s', CASE WHEN ms % 250 = 125 THEN ms + 5 ELSE ms END / CAST(1000 AS DOUBLE)) END AS duration FROM o""")
def duration_texts(spark, d):
    ms = F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN o_custkey % 1000 ELSE o_orderkey * 13 END")
    return t(spark, d, "orders").select("o_orderkey", files.day_text(F.col("o_orderdate")).alias("day"), files.duration_text(ms).alias("duration"))


@query("""SELECT p_brand, p_partkey, detail FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY detail = '', p_partkey) AS rn FROM (SELECT p_brand, p_partkey, CASE WHEN p_size % 3 = 0 AND p_brand <> 'Brand#11' THEN p_name ELSE '' END AS detail FROM part)) WHERE rn = 1""")
def detail_first(spark, d):
    rows = t(spark, d, "part").select("p_brand", "p_partkey", F.expr("CASE WHEN p_size % 3 = 0 AND p_brand <> 'Brand#11' THEN p_name ELSE '' END").alias("detail"))
    return files.with_detail_first(rows, "p_brand", "detail", "p_partkey")


@query("SELECT p_partkey, CAST(coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM part")
def running_offsets(spark, d):
    return files.running_offsets(t(spark, d, "part"), "p_brand", "p_size", "p_partkey").select("p_partkey", "start")


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def without_repeats(spark, d):
    return files.without_repeats(t(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "event_type")


@query("""WITH c AS (SELECT l_orderkey AS table_id, l_linenumber AS id, l_linenumber AS ord, l_orderkey % 3 = 0 AS incl, CASE WHEN l_orderkey % 4 <> 0 AND l_linenumber % 3 <> 0 THEN 10 - l_linenumber END AS pos, l_linenumber % 2 = 0 AS hidden, l_linenumber = 4 AS forced FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
h AS (SELECT *, count(pos) OVER (PARTITION BY table_id) > 0 AS has FROM c)
SELECT table_id, CAST(id AS INT) AS id, row_number() OVER (PARTITION BY table_id ORDER BY pos IS NULL, pos, ord) AS place FROM h WHERE NOT has OR pos IS NOT NULL AND (incl OR NOT hidden OR forced) OR pos IS NULL AND incl""")
def view_columns(spark, d):
    columns = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("ord")).distinct()
    view = columns.where("table_id % 4 <> 0 and id % 3 <> 0").select("table_id", "id", (10 - F.col("id")).alias("pos"), (F.col("id") % 2 == 0).alias("hidden"), (F.col("id") == 4).alias("forced"))
    return files.view_columns(columns, view, F.col("table_id") % 3 == 0)


@query("""WITH b AS (SELECT s_suppkey AS box_id, s_suppkey % 90 AS x0, s_nationkey AS y0, s_suppkey % 90 + 6 AS x1, s_nationkey + 4 AS y1 FROM supplier), p AS (SELECT p_size * 2 AS x, p_partkey % 30 AS y FROM part)
SELECT box_id, count(x) AS n FROM b LEFT JOIN p ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY box_id""")
def points_inside(spark, d):
    s = F.col("s_suppkey") % 90
    boxes = t(spark, d, "supplier").select(F.col("s_suppkey").alias("box_id"), s.alias("x0"), F.col("s_nationkey").alias("y0"), (s + 6).alias("x1"), (F.col("s_nationkey") + 4).alias("y1"))
    points = t(spark, d, "part").select((F.col("p_size") * 2).alias("x"), (F.col("p_partkey") % 30).alias("y"))
    return files.points_inside(points, boxes, 5.0)


@query("SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS place FROM part) WHERE place <= 4")
def first_four_by_place(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_retailprice", "p_partkey"))
    return t(spark, d, "part").select("p_brand", "p_partkey", place.cast("long").alias("place")).where("place <= 4")


@query("""WITH p AS (SELECT c_custkey, c_nationkey AS k, CAST(round(c_acctbal) AS BIGINT) AS x FROM customer), l AS (SELECT s_nationkey AS k, CAST(round(s_acctbal) AS BIGINT) AS lx, s_name, s_suppkey FROM supplier)
SELECT c_custkey, coalesce(s_name, '') AS label FROM (SELECT c_custkey, s_name, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(x - lx), s_suppkey) AS rn FROM p LEFT JOIN l ON p.k = l.k) WHERE rn = 1""")
def nearest_stage(spark, d):
    points = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", F.round("c_acctbal").cast("long").alias("x"))
    labels = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.round("s_acctbal").cast("long").alias("x"), F.col("s_name").alias("text"), F.col("s_suppkey").alias("ord"))
    return geometry.nearest_labels(points, labels, "k", "c_custkey")


@query("""WITH e AS (SELECT user_id % 40 AS k, event_type || event_id % 3 AS text, event_id AS ord, CAST(round(value * 10) AS BIGINT) AS x FROM events WHERE value IS NOT NULL),
s AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY x, ord) AS rn, x - lag(x) OVER (PARTITION BY k ORDER BY x, ord) AS gap FROM e),
d AS (SELECT k, count(*) FILTER (c > 1) AS again FROM (SELECT k, text, count(*) AS c FROM e GROUP BY k, text) GROUP BY k),
g AS (SELECT k, rn AS cut, gap AS widest FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY gap DESC NULLS LAST, rn) = 1),
r AS (SELECT s.k, s.ord, n, CASE WHEN n < 10 OR again < 3 THEN 0 WHEN n % 2 = 0 THEN CAST(rn > n / 2 AS INT) WHEN widest < 120 THEN 0 ELSE CAST(rn >= cut AS INT) END AS grp FROM s JOIN d ON s.k = d.k JOIN g ON s.k = g.k)
SELECT k, ord, grp FROM (SELECT *, count(*) OVER (PARTITION BY k, grp) AS size FROM r) WHERE n < 10 OR size >= 3""")
def label_groups(spark, d):
    rows = t(spark, d, "events").where("value is not null").select((F.col("user_id") % 40).alias("k"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("text"), F.col("event_id").alias("ord"), F.round(F.col("value") * 10).cast("long").alias("x"))
    return geometry.split_labels(rows, "k").select("k", "ord", "grp")


@query("""SELECT page_id, regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#x200B;|&#[0-9]+;|' || chr(8203), '', 'g') AS text FROM pages""")
def shape_texts(spark, d):
    return t(spark, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'md|' || lower(o_orderstatus) WHEN 1 THEN 'word' ELSE '' END AS types FROM orders""")
def refused_types(spark, d):
    low = F.lower("o_orderstatus")
    message = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("要求是 md, "), low, F.lit(" 其中的一个"))).when(F.col("o_orderkey") % 3 == 1, F.lit("要求是word，其中的一个"))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(tx.accepted_types(message), "|").alias("types"))
