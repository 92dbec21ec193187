"""Sheets, tables, pages, geometry and diagram queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import diagrams, geometry, html, sheets, tables

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


_CELLS = "SELECT l_suppkey AS sheet, CAST(l_linenumber AS INT) - 1 AS r, CAST(extract('month' FROM l_shipdate) AS INT) - 1 AS c, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS v FROM lineitem GROUP BY 1, 2, 3"
_GRID = f"""cells AS ({_CELLS}), b AS (SELECT sheet, max(r) AS mr, max(c) AS mc FROM cells GROUP BY sheet),
g AS (SELECT sheet, r, unnest(range(mc + 1)) AS c FROM (SELECT sheet, mc, unnest(range(mr + 1)) AS r FROM b)),
grid AS (SELECT g.sheet, CAST(g.r AS INT) AS r, CAST(g.c AS INT) AS c, coalesce(v, '') AS v FROM g LEFT JOIN cells ON g.sheet = cells.sheet AND g.r = cells.r AND g.c = cells.c)"""


def _cells(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("sheet"), (F.col("l_linenumber") - 1).cast("int").alias("r"), (F.month("l_shipdate") - 1).cast("int").alias("c"), "l_quantity")
    return rows.groupBy("sheet", "r", "c").agg(F.sum("l_quantity").cast("long").cast("string").alias("v"))


def _grid(spark, d):
    return sheets.dense_grid(_cells(spark, d), "sheet", "r", "c", "v")


@query(f"WITH {_GRID} SELECT sheet, r, c, v FROM grid")
def sheet_grid(spark, d):
    return _grid(spark, d).select("sheet", "r", "c", "v")


@query(f"WITH {_GRID}, l AS (SELECT sheet, r, string_agg(v, ',' ORDER BY c) AS line FROM grid GROUP BY sheet, r) SELECT sheet, string_agg(line, chr(10) ORDER BY r) AS text FROM l GROUP BY sheet")
def sheet_csv(spark, d):
    return sheets.sheet_text(sheets.row_texts(_grid(spark, d), "sheet", "r", "c", sheets.csv_cell(F.col("v")), ","), "sheet", "r")


_MARKDOWN = f"""WITH {_GRID}, l AS (SELECT sheet, r, '| ' || string_agg(replace(replace(v, '|', chr(92) || '|'), chr(10), ' '), ' | ' ORDER BY c) || ' |'
 || CASE WHEN r = 0 THEN chr(10) || '| ' || string_agg('---', ' | ') || ' |' ELSE '' END AS line FROM grid GROUP BY sheet, r), texts AS (SELECT sheet, string_agg(line, chr(10) ORDER BY r) AS text FROM l GROUP BY sheet)"""


@query(f"{_MARKDOWN} SELECT sheet, text FROM texts")
def sheet_markdown(spark, d):
    return sheets.sheet_text(sheets.markdown_lines(_grid(spark, d), "sheet", "r", "c", "v"), "sheet", "r")


@query(f"""{_MARKDOWN}, books AS (SELECT sheet // 3 AS book, count(*) AS n, any_value(text) AS one, string_agg('## Sheet' || sheet || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY sheet) AS many FROM texts GROUP BY 1)
SELECT CAST(book AS BIGINT) AS book, CASE WHEN n = 1 THEN one ELSE many END AS text FROM books""")
def workbook_markdown(spark, d):
    texts = sheet_markdown(spark, d).withColumn("book", F.floor(F.col("sheet") / 3))
    return sheets.joined_sheets(texts, "book", F.concat(F.lit("Sheet"), F.col("sheet").cast("string")), "sheet", "## ", "\n\n")


@query(f"""WITH {_GRID}, l AS (SELECT sheet, r, string_agg(v, ',' ORDER BY c) AS line FROM grid GROUP BY sheet, r), texts AS (SELECT sheet, string_agg(line, chr(10) ORDER BY r) AS text FROM l GROUP BY sheet),
books AS (SELECT sheet // 3 AS book, count(*) AS n, any_value(text) AS one, string_agg('--- Sheet' || sheet || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY sheet) AS many FROM texts GROUP BY 1)
SELECT CAST(book AS BIGINT) AS book, CASE WHEN n = 1 THEN one ELSE many END AS text FROM books""")
def workbook_csv(spark, d):
    texts = sheet_csv(spark, d).withColumn("book", F.floor(F.col("sheet") / 3))
    return sheets.joined_sheets(texts, "book", F.concat(F.lit("Sheet"), F.col("sheet").cast("string")), "sheet", "--- ", " ---\n")


@query(f"WITH {_GRID}, l AS (SELECT sheet, r, '<tr>' || string_agg('<td>' || v || '</td>', '' ORDER BY c) || '</tr>' AS line FROM grid GROUP BY sheet, r) SELECT sheet, '<table>' || string_agg(line, '' ORDER BY r) || '</table>' AS text FROM l GROUP BY sheet")
def sheet_html(spark, d):
    cell = F.concat(F.lit("<td>"), tx.escape_xml(F.col("v")), F.lit("</td>"))
    lines = sheets.row_texts(_grid(spark, d), "sheet", "r", "c", cell, "").withColumn("line", F.concat(F.lit("<tr>"), "line", F.lit("</tr>")))
    return sheets.sheet_text(lines, "sheet", "r", "").withColumn("text", F.concat(F.lit("<table>"), "text", F.lit("</table>")))


@query("SELECT l_returnflag, CAST(sum(l_quantity) FILTER (l_linestatus = 'O') AS BIGINT) AS o_qty, CAST(sum(l_quantity) FILTER (l_linestatus = 'F') AS BIGINT) AS f_qty FROM lineitem GROUP BY l_returnflag")
def sheet_pivot(spark, d):
    wide = t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity").cast("long"))
    return wide.select("l_returnflag", F.col("O").alias("o_qty"), F.col("F").alias("f_qty"))


@query(f"""WITH cells AS ({_CELLS}) SELECT sheet, r, c, v, CASE WHEN r % 3 = 0 AND c % 4 = 0 THEN 2 ELSE 1 END AS row_span, CASE WHEN r % 3 = 0 AND c % 4 = 0 THEN 2 ELSE 1 END AS col_span
FROM cells x WHERE NOT (r % 3 < 2 AND c % 4 < 2) OR (r % 3 = 0 AND c % 4 = 0)""")
def merge_ranges(spark, d):
    bounds = t(spark, d, "supplier").select(F.col("s_suppkey").alias("sheet"))
    merges = bounds.select("sheet", F.explode(F.sequence(F.lit(0), F.lit(6), F.lit(3))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(8), F.lit(4))).alias("col"), F.lit(2).alias("row_count"), F.lit(2).alias("col_count"))
    return sheets.covered_cells(_cells(spark, d), merges, "sheet").select("sheet", "r", "c", "v", "row_span", "col_span")


@query("SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END, o_orderstatus) AS label FROM orders")
def option_lookup(spark, d):
    return t(spark, d, "orders").select("o_orderkey", tables.option_label(F.col("o_orderstatus"), {"F": "Finished", "O": "Open"}).alias("label"))


@query("""WITH v AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS ord FROM part WHERE p_size > 40)
SELECT part.p_partkey, row_number() OVER (ORDER BY coalesce(v.ord, 9223372036854775807), part.p_partkey) AS pos FROM part LEFT JOIN v ON part.p_partkey = v.p_partkey""")
def grid_view_order(spark, d):
    part = t(spark, d, "part")
    view = tables.ordinals(part.where("p_size > 40"), [F.desc("p_retailprice"), F.col("p_partkey")], "ord").select("p_partkey", "ord")
    return tables.view_order(part, view, "p_partkey").select("p_partkey", F.col("pos").cast("long").alias("pos"))


@query("SELECT p_type AS grp, count(*) AS n, string_agg(p_name, chr(10) ORDER BY p_partkey) AS items FROM part GROUP BY p_type")
def kanban(spark, d):
    return tables.kanban(t(spark, d, "part"), F.col("p_type"), "p_name", "p_partkey")


@query("SELECT r_name AS grp, count(s_suppkey) AS n, coalesce(string_agg(s_name, chr(10) ORDER BY s_suppkey), '') AS items FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey < 10 LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")
def kanban_empty_groups(spark, d):
    rows = t(spark, d, "supplier").join(t(spark, d, "nation").where("n_nationkey < 10"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tables.with_empty_groups(t(spark, d, "region").select(F.col("r_name").alias("grp")), tables.kanban(rows, F.col("r_name"), "s_name", "s_suppkey"))


@query("SELECT p_brand AS label, count(*) AS n, row_number() OVER (ORDER BY min(p_partkey)) AS pos FROM part GROUP BY p_brand")
def chart_counts(spark, d):
    return tables.chart_counts(t(spark, d, "part"), tx.missing_as(F.col("p_brand"), "(empty)"), "p_partkey")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def calendar(spark, d):
    day = F.coalesce(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("(no date)"))
    return t(spark, d, "orders").groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"), F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|h[1-6]|tr)>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '[ \t]+\n', chr(10), 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS text FROM pages""")
def html_text(spark, d):
    return t(spark, d, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS h FROM pages)
SELECT page_id, CAST(i AS INT) AS ord, h[i + 1] AS href FROM (SELECT page_id, h, unnest(range(len(h))) AS i FROM l)""")
def html_links(spark, d):
    return html.links(t(spark, d, "pages"), "page_id", "html")


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS h FROM pages), x AS (SELECT page_id, i, h[i + 1] AS href FROM (SELECT page_id, h, unnest(range(len(h))) AS i FROM l))
SELECT page_id, href, 'assets/' || page_id || '_' || (i + 1) || '.' || CASE WHEN lower(regexp_extract(href, '\\.([A-Za-z0-9]+)(?:\\?|$)', 1)) IN ('png','jpg','jpeg','gif','webp','svg','bmp') THEN lower(regexp_extract(href, '\\.([A-Za-z0-9]+)(?:\\?|$)', 1)) ELSE 'png' END AS asset FROM x""".replace("\\\\", "\\"))
def link_manifest(spark, d):
    l = html.links(t(spark, d, "pages"), "page_id", "html")  # noqa: E741
    return l.select("page_id", "href", F.concat(F.lit("assets/"), F.col("page_id").cast("string"), F.lit("_"), (F.col("ord") + 1).cast("string"), F.lit("."), tx.image_extension(F.col("href"))).alias("asset"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS INT) AS headings FROM pages""")
def page_titles(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<h[1-6][^>]*>")).alias("headings"))


@query()
def html_to_markdown(spark, d):
    return t(spark, d, "pages").select("page_id", html.to_markdown(F.col("html")).alias("markdown"))


@query("SELECT s_nationkey AS grp, min(s_suppkey) AS min_x, min(CAST(round(s_acctbal * 100) AS BIGINT)) AS min_y, max(s_suppkey) AS max_x, max(CAST(round(s_acctbal * 100) AS BIGINT)) AS max_y FROM supplier GROUP BY 1")
def bbox_union(spark, d):
    return geometry.bbox(t(spark, d, "supplier").withColumnRenamed("s_nationkey", "grp"), ["grp"], F.col("s_suppkey"), F.round(F.col("s_acctbal") * 100).cast("long"))


@query("SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS cx, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS cy, round(max(sqrt(CAST(embedding[1] AS DOUBLE) ** 2 + CAST(embedding[2] AS DOUBLE) ** 2)) / 0.8, 6) AS radius FROM embeddings GROUP BY label")
def centroid_radius(spark, d):
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return t(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(x), 6).alias("cx"), F.round(F.avg(y), 6).alias("cy"), F.round(F.max(F.hypot(x, y)) / 0.8, 6).alias("radius"))


_POINTS = "SELECT c_custkey AS pid, CAST(round(c_acctbal) AS BIGINT) AS x, c_custkey % 1000 AS y FROM customer"
_NODES = "SELECT s_suppkey AS nid, CAST(round(s_acctbal) AS BIGINT) AS x, s_suppkey * 37 % 1000 AS y FROM supplier"
_NEAR = f"""p AS ({_POINTS}), n AS ({_NODES}), m AS (SELECT pid, nid, CAST((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) AS DOUBLE) AS d2 FROM p JOIN n ON abs(p.x - n.x) < {{0}} AND abs(p.y - n.y) < {{0}})"""


def _points(spark, d):
    p = t(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.round("c_acctbal").cast("long").alias("x"), (F.col("c_custkey") % 1000).alias("y"))
    n = t(spark, d, "supplier").select(F.col("s_suppkey").alias("nid"), F.round("s_acctbal").cast("long").alias("x"), (F.col("s_suppkey") * 37 % 1000).alias("y"))
    return p, n


@query(f"WITH {_NEAR.format(160)} SELECT pid, arg_min(nid, {{'d': d2, 'n': nid}}) AS nid, min(d2) AS d2 FROM m WHERE d2 < 25600 GROUP BY pid")
def nearest_node(spark, d):
    return geometry.nearest(*_points(spark, d), "pid", "nid", 160)


@query(f"WITH {_NEAR.format(220)} SELECT pid, nid, d2, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, nid) AS rank FROM m WHERE d2 < 48400) WHERE rank <= 4")
def topk_nearby(spark, d):
    return geometry.nearest(*_points(spark, d), "pid", "nid", 220, k=4)


@query("SELECT p_partkey, CASE WHEN r <= 0.25 THEN 0 WHEN r <= 0.5 THEN 1 WHEN r <= 0.875 THEN 2 WHEN r <= 1 THEN 3 END AS lane FROM (SELECT p_partkey, p_size / 64.0 AS r FROM part)")
def lane_assign(spark, d):
    return geometry.lanes(t(spark, d, "part"), F.col("p_size") / 64.0, [0.25, 0.25, 0.375, 0.125]).select("p_partkey", "lane")


@query("""WITH e AS (SELECT user_id, event_id, abs(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events)
SELECT user_id, CAST(round(sum(coalesce(step, 0))) AS BIGINT) AS length FROM e GROUP BY user_id""")
def arc_length(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))  # whole microseconds add up exactly in any order
    return geometry.arc_lengths(t(spark, d, "events"), "user_id", us, F.lit(0), ["ts", "event_id"]).groupBy("user_id").agg(F.round(F.sum("step") / 1_000_000).cast("long").alias("length"))


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200000000 THEN 1 ELSE 0 END AS new, ts FROM events)
SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM e""")
def gap_cluster(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return geometry.gap_clusters(t(spark, d, "events"), "user_id", us, ["ts", "event_id"], 43_200_000_000).select("event_id", "user_id", "cluster")


@query("SELECT user_id, max(gap) AS widest FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id")
def largest_gap(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(spark, d, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.max("gap").alias("widest"))


@query("SELECT p_brand, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT), p_brand) AS pos FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort(spark, d):
    brands = t(spark, d, "part").select("p_brand").distinct()
    return tables.ordinals(brands, [F.regexp_extract("p_brand", "[0-9]+", 0).cast("long"), F.col("p_brand")], "pos").select("p_brand", F.col("pos").cast("long").alias("pos"))


@query("""WITH f AS (SELECT user_id, count_if(event_type = 'purchase') AS buys, count_if(event_type = 'error') AS errors, count_if(event_type = 'click') AS clicks, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN kinds < 3 THEN 'plain' WHEN errors > buys AND errors > clicks THEN 'trouble' WHEN buys >= clicks THEN 'buyer' ELSE 'browser' END AS kind FROM f""")
def kind_cascade(spark, d):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    f = t(spark, d, "events").groupBy("user_id").agg(kind("purchase").alias("buys"), kind("error").alias("errors"), kind("click").alias("clicks"), F.count_distinct("event_type").alias("kinds"))
    rules = [(F.col("kinds") < 3, "plain"), ((F.col("errors") > F.col("buys")) & (F.col("errors") > F.col("clicks")), "trouble"), (F.col("buys") >= F.col("clicks"), "buyer")]
    return f.select("user_id", diagrams.first_rule(rules, "browser").alias("kind"))


@query("""WITH e AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT a AS source, b AS target, count(*) AS n FROM e WHERE a <> b GROUP BY a, b)
SELECT source, target, n, source || ' -->|' || n || '| ' || target AS line FROM c""")
def flow_edges(spark, d):
    return diagrams.flow_edges(t(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("""WITH e AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT a || ' -->|' || count(*) || '| ' || b AS line, a, b FROM e WHERE a <> b GROUP BY a, b)
SELECT 'flowchart TD' || chr(10) || string_agg('  ' || line, chr(10) ORDER BY a, b) AS text FROM c""")
def flowchart_text(spark, d):
    return diagrams.flowchart(diagrams.flow_edges(t(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]))


@query("SELECT conv_id, 'sequenceDiagram' || chr(10) || string_agg('  ' || role || '->>' || CASE WHEN role = 'assistant' THEN 'user' ELSE 'assistant' END || ': ' || length(coalesce(text, '')), chr(10) ORDER BY turn, role, length(coalesce(text, ''))) AS text FROM conversations GROUP BY conv_id")
def sequence_text(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("source"), F.when(F.col("role") == "assistant", "user").otherwise("assistant").alias("target"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return diagrams.sequence(c.withColumn("message", F.col("n").cast("string")), "conv_id", ["turn", "source", "n"])


@query("SELECT strftime(o_orderdate, '%Y') AS section, 'section ' || strftime(o_orderdate, '%Y') || chr(10) || string_agg(DISTINCT strftime(o_orderdate, '%m'), chr(10) ORDER BY strftime(o_orderdate, '%m')) AS text FROM orders GROUP BY 1")
def timeline_text(spark, d):
    return diagrams.timeline(t(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy").alias("section"), F.date_format("o_orderdate", "MM").alias("item")).distinct())


@query("SELECT r_name AS root, 'mindmap' || chr(10) || '  ' || r_name || chr(10) || string_agg('    ' || n_name, chr(10) ORDER BY n_name) AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def mindmap_text(spark, d):
    rows = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("root"), F.col("n_name").alias("item"))
    return diagrams.mindmap(rows)


@query("""WITH b AS (SELECT min(p_size) AS x0, max(p_size) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part)
SELECT p_partkey, floor((p_size - x0) / (x1 - x0) * 100 + 0.5) / 100 AS qx, floor((p_retailprice - y0) / (y1 - y0) * 100 + 0.5) / 100 AS qy FROM part, b""")
def quadrant_points(spark, d):
    part = t(spark, d, "part")
    b = part.agg(F.min("p_size").alias("x0"), F.max("p_size").alias("x1"), F.min("p_retailprice").alias("y0"), F.max("p_retailprice").alias("y1"))
    rows = part.crossJoin(F.broadcast(b))  # one row
    return rows.select("p_partkey", tx.round_half_up((F.col("p_size") - F.col("x0")) / (F.col("x1") - F.col("x0")), 2).alias("qx"), tx.round_half_up((F.col("p_retailprice") - F.col("y0")) / (F.col("y1") - F.col("y0")), 2).alias("qy"))


@query("""WITH s AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type), m AS (SELECT p_brand, max(n) AS most FROM s GROUP BY p_brand)
SELECT s.p_brand, '[' || string_agg(CAST(floor(n * 50.0 / most + 0.5) AS BIGINT), ',' ORDER BY p_type) || ']' AS radar FROM s JOIN m ON s.p_brand = m.p_brand GROUP BY s.p_brand""")
def radar_values(spark, d):
    n = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return diagrams.radar(n, "p_brand", "p_type", "n")
