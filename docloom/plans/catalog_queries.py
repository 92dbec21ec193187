"""Catalog, listing, routing and job queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import catalog, jobs, listing


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _toc(spark: SparkSession, d: str) -> DataFrame:
    region, nation, supplier = (t(spark, d, n) for n in ("region", "nation", "supplier"))
    node = lambda df, u, p, kind, title: df.select(F.concat(F.lit(u[0]), F.col(u[1:]).cast("string")).alias("uuid"), p.alias("parent_uuid"), F.lit(kind).alias("type"), F.col(title).alias("title"), F.col(u[1:]).cast("long").alias("ord"))
    rows = node(region, "rr_regionkey", F.lit(None).cast("string"), "TITLE", "r_name")
    rows = rows.unionAll(node(nation, "nn_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "TITLE", "n_name"))
    return rows.unionAll(node(supplier, "ss_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), "DOC", "s_name"))


_PATHS_SQL = r"""SELECT 'r' || r_regionkey AS uuid, '' AS path FROM region
UNION ALL SELECT 'n' || n_nationkey, regexp_replace(r_name, '\s+', '_', 'g') FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 's' || s_suppkey, regexp_replace(r_name, '\s+', '_', 'g') || '/' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(_PATHS_SQL)
def toc_paths(spark, d):
    return listing.toc_paths(_toc(spark, d))


@query(r"""SELECT s_suppkey AS doc_id, regexp_replace(r_name, '\s+', '_', 'g') || '/' || n_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def toc_doc_paths(spark, d):
    toc = _toc(spark, d).withColumn("doc_id", F.when(F.col("type") == "DOC", F.col("ord")))
    return listing.doc_paths(toc, listing.toc_paths(toc))


@query(r"""WITH n AS (SELECT n_nationkey, regexp_replace(r_name, '\s+', '_', 'g') || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey AS doc_id, c_name AS title, coalesce(path, '') AS path FROM customer LEFT JOIN n ON c_nationkey = n_nationkey""")
def docs_with_paths(spark, d):
    folders = listing.toc_paths(_toc(spark, d)).join(t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("uuid"), "n_nationkey", "n_name"), "uuid")
    folders = folders.select(F.col("n_nationkey").alias("c_nationkey"), F.concat_ws("/", "path", "n_name").alias("path"))
    return listing.with_paths(t(spark, d, "customer"), folders, "c_nationkey").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), "path")


@query(r"""WITH p AS (SELECT regexp_replace(r_name, '\s+', '_', 'g') AS r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS prefix, 1 AS depth, count(*) AS n FROM p GROUP BY r_name UNION ALL SELECT r_name || '/' || n_name, 2, count(*) FROM p GROUP BY r_name, n_name""")
def path_tree(spark, d):
    return listing.path_tree(docs_with_paths(spark, d), "path")


@query(r"SELECT regexp_replace(r_name, '\s+', '_', 'g') AS ancestor, count(*) AS leaves FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def leaf_counts(spark, d):
    paths = listing.toc_paths(_toc(spark, d)).where("uuid like 's%'")
    return paths.groupBy(F.split("path", "/")[0].alias("ancestor")).agg(F.count("*").alias("leaves"))


@query("SELECT source, lang, count(*) AS docs FROM documents GROUP BY source, lang")
def doc_type_counts(spark, d):
    return t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"))


@query("SELECT count(DISTINCT nullif(c_mktsegment, '')) AS folders, count(DISTINCT c_nationkey) AS books FROM customer")
def folder_count(spark, d):
    return t(spark, d, "customer").agg(F.count_distinct(F.nullif("c_mktsegment", F.lit(""))).alias("folders"), F.count_distinct("c_nationkey").alias("books"))


@query("""WITH u AS (SELECT c_nationkey AS id, c_name AS name, 0 AS source_rank, c_custkey AS ord FROM customer UNION ALL SELECT s_nationkey, s_name, 1, s_suppkey FROM supplier)
SELECT id, name, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_rank, ord) AS rn FROM u) WHERE rn = 1""")
def catalog_first_wins(spark, d):
    a = t(spark, d, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    b = t(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    return catalog.first_wins(catalog.union_sources([a, b]), ["id"], [F.col("source_rank"), F.col("ord")]).select("id", "name", "source_rank")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins_index(spark, d):
    return catalog.last_wins(t(spark, d, "events"), ["user_id"], "event_type", F.col("event_id"))


@query("SELECT n_nationkey AS id, n_name AS name, row_number() OVER (ORDER BY n_name DESC) AS ord FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def selected_books(spark, d):
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    chosen = nation.join(t(spark, d, "region").where("r_name like 'A%'"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy().agg(F.sort_array(F.collect_list(F.struct("name", "id")), asc=False).alias("s"))  # 25 nations
    selection = chosen.select(F.posexplode("s").alias("pos", "b")).select(F.col("b.id").alias("id"), (F.col("pos") + 1).cast("long").alias("ord"))
    return catalog.selected(nation, selection, "id").select("id", "name", "ord")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def encrypted_anti(spark, d):
    return catalog.without(t(spark, d, "documents").select("doc_id", "source"), t(spark, d, "labels").where("toxic = 1"), ["doc_id"])


@query("""SELECT event_id AS id, 'doc' AS kind, 'bookmarks/' || user_id AS folder FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, 'book', 'bookmarks/books' FROM events WHERE event_type = 'click'""")
def bookmark_split(spark, d):
    e = t(spark, d, "events")
    docs = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.lit("doc").alias("kind"), F.concat(F.lit("bookmarks/"), F.col("user_id").cast("string")).alias("folder"))
    return docs.unionByName(e.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.lit("book").alias("kind"), F.lit("bookmarks/books").alias("folder")))


#: Formats of each type, the default first. Fixed values.
FORMATS = {"Doc": ["md", "docx", "pdf", "jpg"], "Sheet": ["xlsx", "csv", "md", "html"], "Table": ["xlsx", "csv", "md"], "Board": ["png", "jpg", "svg"]}
_KIND = "CASE p_size % 4 WHEN 0 THEN 'Doc' WHEN 1 THEN 'Sheet' WHEN 2 THEN 'Table' ELSE 'Board' END"
_CHOICE = "CASE p_size % 7 WHEN 0 THEN 'md' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'jpg' WHEN 3 THEN 'html' WHEN 4 THEN 'csv' WHEN 5 THEN 'svg' ELSE 'png' END"


@query(f"""WITH p AS (SELECT p_partkey AS doc_id, {_KIND} AS doc_type, {_CHOICE} AS choice FROM part),
f AS (SELECT *, CASE WHEN doc_type = 'Doc' AND choice IN ('md','docx','pdf','jpg') OR doc_type = 'Sheet' AND choice IN ('xlsx','csv','md','html') OR doc_type = 'Table' AND choice IN ('xlsx','csv','md') OR doc_type = 'Board' AND choice IN ('png','jpg','svg') THEN choice
 WHEN doc_type = 'Doc' THEN 'md' WHEN doc_type = 'Board' THEN 'png' ELSE 'xlsx' END AS format FROM p)
SELECT doc_id, doc_type, format, CASE WHEN doc_type = 'Board' THEN 'board' WHEN doc_type IN ('Sheet','Table') AND format IN ('md','csv','html') THEN 'local_sheet' WHEN doc_type = 'Doc' AND format = 'md' THEN 'local_doc' ELSE 'api' END AS route FROM f""")
def format_route(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_KIND).alias("doc_type"), F.expr(_CHOICE).alias("choice"))
    options = F.create_map(*[x for k, v in FORMATS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("doc_type")]
    p = p.withColumn("format", F.when(F.array_contains(options, F.col("choice")), F.col("choice")).otherwise(options[0]))
    kind, fmt = F.col("doc_type"), F.col("format")
    route = F.when(kind == "Board", "board").when(kind.isin("Sheet", "Table") & fmt.isin("md", "csv", "html"), "local_sheet").when((kind == "Doc") & (fmt == "md"), "local_doc").otherwise("api")
    return p.select("doc_id", "doc_type", "format", route.alias("route"))


@query(r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(url, '[\\/]+'), lambda s: regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[<>:"|?*]', '_', 'g'), '\s+', '_', 'g'), '_+', '_', 'g'), '[. ]+$', '')), lambda s: s <> ''), '/') || '.md' AS file_path FROM pages""")
def file_paths(spark, d):
    return t(spark, d, "pages").select("page_id", F.concat(tx.sanitize_segments(F.col("url")), F.lit(".md")).alias("file_path"))


@query("""SELECT p_partkey, CASE WHEN k = 0 THEN p_type ELSE p_type || ' (' || k || ')' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS k FROM part)""")
def collision_suffix(spark, d):
    return catalog.numbered_collisions(t(spark, d, "part"), "p_type", F.col("p_partkey")).select("p_partkey", "unique_name")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'pending' END"


@query(f"""WITH o AS (SELECT {_STATUS} AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS ms, o_orderpriority FROM orders)
SELECT o_orderpriority, count(*) AS total, CAST(count_if(status = 'success') AS BIGINT) AS success, CAST(count_if(status = 'failed') AS BIGINT) AS failed, CAST(count_if(status = 'pending') AS BIGINT) AS pending,
CAST(coalesce(sum(ms) FILTER (status = 'success'), 0) AS BIGINT) AS sum_duration, CAST(coalesce(floor(sum(ms) FILTER (status = 'success') / nullif(count_if(status = 'success'), 0) + 0.5), 0) AS BIGINT) AS avg_duration,
CAST(floor(count_if(status = 'success') * 100 / count(*) + 0.5) AS BIGINT) AS percent FROM o GROUP BY o_orderpriority""")
def job_summary(spark, d):
    o = t(spark, d, "orders").select(F.expr(_STATUS).alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("ms"), "o_orderpriority")
    return jobs.summary(o, "status", F.col("ms"), ["o_orderpriority"])


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_STATUS} = 'success' AND o_totalprice > 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def slowest_top10(spark, d):
    o = t(spark, d, "orders").withColumn("status", F.expr(_STATUS))
    return jobs.slowest(o, "status", "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey FROM orders WHERE {_STATUS} NOT IN ('success', 'failed')")
def status_filter(spark, d):
    return t(spark, d, "orders").where(~F.expr(_STATUS).isin("success", "failed")).select("o_orderkey")


_LINE = "CASE event_type WHEN 'error' THEN '[12:00] 导出失败: ' WHEN 'purchase' THEN '[12:00] 导出成功 ' WHEN 'click' THEN '跳过加密文档 ' WHEN 'view' THEN '[12:00] 文档类型: ' ELSE '开始 ' END"


@query(f"""WITH l AS (SELECT {_LINE} || event_id AS line FROM events)
SELECT CASE WHEN regexp_matches(line, '成功|完成|获取到') THEN 'success' WHEN regexp_matches(line, '失败|错误|Error') THEN 'error' WHEN regexp_matches(line, '暂停|取消|跳过|加密') THEN 'warn' ELSE '' END AS level,
count(*) AS n FROM l WHERE NOT regexp_matches(line, '文档类型:') GROUP BY 1""")
def log_levels(spark, d):
    lines = t(spark, d, "events").select(F.concat(F.expr(_LINE), F.col("event_id").cast("string")).alias("line"))
    return lines.where(jobs.shown_log(F.col("line"))).groupBy(jobs.log_level(F.col("line")).alias("level")).agg(F.count("*").alias("n"))


@query(f"SELECT {_LINE} || user_id AS line, min(event_id) AS first_at FROM events GROUP BY 1")
def merged_logs(spark, d):
    lines = t(spark, d, "events").select(F.concat(F.expr(_LINE), F.col("user_id").cast("string")).alias("line"), "event_id")
    return jobs.merged_logs(lines, "line", F.col("event_id"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS idx, o_custkey * 7 AS cur FROM orders WHERE o_orderstatus = 'P')
SELECT o_custkey, coalesce(min(idx) FILTER (idx >= cur), min(idx)) AS next_idx FROM o GROUP BY o_custkey""")
def next_runnable(spark, d):
    return jobs.next_runnable(t(spark, d, "orders"), "o_orderkey", F.col("o_orderstatus") == "P", F.col("o_custkey") * 7, ["o_custkey"])


@query("SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'error' AND event_id > 100), 0) AS next_retry FROM events GROUP BY user_id")
def next_retry_min(spark, d):
    due = (F.col("event_type") == "error") & (F.col("event_id") > 100)
    return t(spark, d, "events").groupBy("user_id").agg(F.coalesce(F.min(F.when(due, F.col("event_id"))), F.lit(0)).alias("next_retry"))


@query("""SELECT event_id, CAST(n AS BIGINT) AS nth, CASE n WHEN 1 THEN 'retry+45' WHEN 2 THEN 'retry+90' WHEN 3 THEN 'retry+180' WHEN 4 THEN 'retry+300' ELSE 'failed' END AS outcome
FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')""")
def deferral_backoff(spark, d):
    return jobs.deferrals(t(spark, d, "events").where("event_type = 'error'"), "user_id", ["ts", "event_id"]).select("event_id", F.col("nth").cast("long").alias("nth"), "outcome")


_EVENT = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'interrupted' ELSE 'other' END"


@query(f"""WITH e AS (SELECT *, {_EVENT} AS kind FROM events), r AS (SELECT *, sum(CASE WHEN kind = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
s AS (SELECT *, sum(CASE WHEN kind = 'interrupted' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT event_id, CAST(k AS BIGINT) AS hard_interrupts, CASE WHEN kind = 'success' THEN 'success' WHEN k >= 3 THEN 'failed' ELSE 'pending' END AS state FROM s""")
def interrupt_machine(spark, d):
    return jobs.interruptions(t(spark, d, "events"), "user_id", F.expr(_EVENT), ["ts", "event_id"]).select("event_id", "hard_interrupts", "state")


@query("""WITH e AS (SELECT *, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
l AS (SELECT user_id, run, list(struct_pack(us := epoch_us(ts), id := event_id) ORDER BY ts, event_id) AS x FROM r GROUP BY user_id, run),
s AS (SELECT user_id, unnest(list_reduce(list_transform(x, lambda v: [v]), lambda a, b: CASE WHEN b[1].us - a[len(a)].us >= 172800000000 THEN list_concat(a, b) ELSE a END)) AS v FROM l)
SELECT v.id AS event_id, user_id FROM s""")
def progress_throttled(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return jobs.throttled(t(spark, d, "events"), "user_id", us, "event_type", ["ts", "event_id"], 172_800_000_000).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 30")
def log_ring(spark, d):
    return jobs.log_ring(t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 30).select("event_id", "user_id")


@query("SELECT p_brand, p_type, count(*) AS n_items, min(p_name) AS first_item, max(p_name) AS last_item FROM part GROUP BY p_brand, p_type")
def nested_catalog(spark, d):
    return catalog.nested(t(spark, d, "part"), "p_brand", "p_type", "p_name")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_labels(spark, d):
    return t(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")
