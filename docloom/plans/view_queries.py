"""Data tables as JSON, made from each customer's orders, and their texts by the active view; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import views

from .catalog_queries import t

QUERIES: dict = {}
SQL: dict[str, str] = {}

_COLUMNS = '[{"id":"k","name":"Key","type":"number"},{"id":"s","name":"State/x","type":"select","options":[{"id":"O","value":"Open"},{"id":"F","value":"Filled"}]},{"id":"p","type":"text"},{"id":"d","name":"Done","type":"checkbox"}]'
_VIEWS = '"g":{"name":"All","columns":[{"id":"s"},{"id":"k"},{"id":"p","hidden":true},{"id":"gone"}],"rows":[{"id":"none"},{"id":"r%d"}]},"c":{"name":"Cards","type":"CARD","cover":{"id":"p","titleId":"k"},"columns":[{"id":"d"},{"id":"k"},{"id":"p","hidden":true},{"id":"s","hidden":true}]},"b":{"type":"KANBAN","group":[{"id":"s"}],"columns":[{"id":"k"}]}'


def _contents(spark, d):
    key = F.col("o_orderkey")
    data = F.format_string('{"k":{"value":%d},"s":"%s","p":"%s","d":%s}', key, "o_orderstatus", "o_orderpriority", F.when(key % 3 == 0, "true").otherwise("false"))
    data = F.when(key % 11 == 0, '"bad{"').when(key % 2 == 0, data).otherwise(F.concat(F.lit('"'), F.replace(data, F.lit('"'), F.lit('\\"')), F.lit('"')))
    record = F.format_string('{"uuid":"r%d","data":%s}', key, data)
    rows = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, record.alias("r")))), lambda x: x["r"]), ",").alias("records"), F.max(key).alias("last"))
    who = F.col("doc")
    active = F.element_at(F.array(*[F.lit(x) for x in ('"activeView":"g",', '"activeView":"c",', '"activeView":"","defaultView":"b",', "")]), (who % 4 + 1).cast("int"))
    columns = F.when(who % 13 == 0, "[]").otherwise(_COLUMNS)
    whole = F.concat(F.lit('{"sheet":[{'), active, F.lit('"columns":'), columns, F.lit(',"views":{'), F.format_string(_VIEWS, "last"), F.lit('}}],"records":['), "records", F.lit("]}"))
    return rows.select("doc", whole.alias("content"))


def table_views(spark, d):
    return views.table_texts(_contents(spark, d), "doc", F.col("content"), F.when(F.col("doc") % 2 == 0, F.concat(F.lit("t"), F.col("doc").cast("string"))))


QUERIES["table_views"] = table_views
SQL["table_views"] = """WITH r AS (
  SELECT o_custkey AS doc, o_orderkey AS k, o_orderkey % 11 = 0 AS bad, o_orderpriority AS p, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE o_orderstatus END AS s,
    CASE WHEN o_orderkey % 3 = 0 THEN '[x]' ELSE '[ ]' END AS done, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders),
g AS (SELECT doc, chr(10) || '**All（GRID）**' || chr(10) || chr(10) || '| State/x | Key |' || chr(10) || '| --- | --- |' || coalesce(string_agg(CASE WHEN NOT bad THEN chr(10) || '| ' || s || ' | ' || k || ' |' END, '' ORDER BY NOT last, k), '') || chr(10) || chr(10) AS markdown FROM r WHERE doc % 4 = 0 GROUP BY doc),
c AS (SELECT doc, chr(10) || '**Cards（CARD）**' || chr(10) || chr(10) || string_agg(CASE WHEN bad THEN '### 未命名记录' ELSE '### ' || k || chr(10) || chr(10) || p || chr(10) || '- Done: ' || done END, chr(10) || chr(10) ORDER BY k) || chr(10) || chr(10) AS markdown FROM r WHERE doc % 4 = 1 GROUP BY doc),
b0 AS (SELECT doc, CASE WHEN bad THEN '未分组' ELSE s END AS grp, min(k) AS first, string_agg('- ' || CASE WHEN bad THEN '未命名记录' ELSE CAST(k AS VARCHAR) END, chr(10) ORDER BY k) AS items FROM r WHERE doc % 4 = 2 GROUP BY ALL),
b AS (SELECT doc, chr(10) || '**数据表格**' || chr(10) || chr(10) || string_agg('### ' || grp || chr(10) || items, chr(10) || chr(10) ORDER BY first) || chr(10) || chr(10) AS markdown FROM b0 GROUP BY doc),
n AS (SELECT doc, chr(10) || '**数据表格**' || chr(10) || chr(10) || '| Key | State/x | p | Done |' || chr(10) || '| --- | --- | --- | --- |' || coalesce(string_agg(CASE WHEN NOT bad THEN chr(10) || '| ' || k || ' | ' || s || ' | ' || p || ' | ' || done || ' |' END, '' ORDER BY k), '') || chr(10) || chr(10) AS markdown FROM r WHERE doc % 4 = 3 GROUP BY doc),
w AS (SELECT * FROM g UNION ALL SELECT * FROM c UNION ALL SELECT * FROM b UNION ALL SELECT * FROM n)
SELECT doc, CASE WHEN doc % 13 = 0 THEN CASE WHEN doc % 2 = 0 THEN chr(10) || '> 数据表格：t' || doc || chr(10) ELSE '' END ELSE markdown END AS markdown FROM w"""
