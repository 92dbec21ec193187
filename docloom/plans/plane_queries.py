"""Geometry of boards over orders, customers and suppliers, with SQL that tries all pairs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from docloom.operators import flow, plane, sequences

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


#: Boxes of orders, most of them small and some as large as a board; boxes of customers.
_BOXES = """a AS (SELECT o_orderkey % 20 AS board, o_orderkey AS polygon, o_custkey * 13 % 4000 AS x, o_orderkey * 7 % 3000 AS y,
  CASE WHEN o_orderkey % 50 = 0 THEN 4000 ELSE o_orderkey % 40 END AS w, CASE WHEN o_orderkey % 50 = 0 THEN 900 ELSE o_custkey % 30 END AS h FROM orders),
b AS (SELECT c_custkey % 20 AS board, c_custkey AS cluster, c_custkey * 31 % 4000 AS x, c_custkey * 17 % 3000 AS y, c_nationkey * 8 AS w, c_nationkey * 3 AS h FROM customer)"""


@query(f"WITH {_BOXES} SELECT board, polygon, cluster FROM a JOIN b USING (board) WHERE a.x <= b.x + b.w AND a.x + a.w >= b.x AND a.y <= b.y + b.h AND a.y + a.h >= b.y")
def box_overlaps(spark, d):
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    wide = key % 50 == 0
    a = t(spark, d, "orders").select((key % 20).alias("board"), key.alias("polygon"), (who * 13 % 4000).alias("x"), (key * 7 % 3000).alias("y"), F.when(wide, 4000).otherwise(key % 40).alias("width"), F.when(wide, 900).otherwise(who % 30).alias("height"))
    who, nation = F.col("c_custkey"), F.col("c_nationkey")
    b = t(spark, d, "customer").select((who % 20).alias("board"), who.alias("cluster"), (who * 31 % 4000).alias("x"), (who * 17 % 3000).alias("y"), (nation * 8).alias("width"), (nation * 3).alias("height"))
    return plane.overlaps(a, b, "board", "polygon", "cluster")


@query("""WITH l AS (SELECT o_custkey % 10 AS board, o_orderpriority AS text, o_orderkey AS id, o_orderkey % 211 AS x, o_custkey % 17 AS y FROM orders),
g AS (SELECT board, text, list([{'id': id, 'x': x, 'y': y}] ORDER BY id) AS items FROM l GROUP BY ALL),
k AS (SELECT board, text, unnest(list_reduce(items, lambda kept, e: CASE WHEN len(list_filter(kept, lambda f: sqrt((f.x - e[1].x) ** 2 + (f.y - e[1].y) ** 2) < 6)) > 0 THEN kept ELSE list_concat(kept, e) END)) AS s FROM g)
SELECT board, text, s.id AS id FROM k""")
def close_repeats(spark, d):
    key = F.col("o_orderkey")
    labels = t(spark, d, "orders").select((F.col("o_custkey") % 10).alias("board"), F.col("o_orderpriority").alias("text"), key.alias("id"), (key % 211).alias("x"), (F.col("o_custkey") % 17).alias("y"))
    return plane.without_close_repeats(labels, ["board", "text"], "id").select("board", "text", "id")


@query("""WITH c AS (SELECT o_custkey % 4 AS board, o_orderkey AS child, o_orderkey * 37 % 6000 AS x, o_orderkey * 11 % 4100 AS y FROM orders),
p AS (SELECT c_custkey % 4 AS board, c_custkey AS parent, c_custkey * 91 % 6000 AS px, c_custkey * 53 % 4100 AS py FROM customer),
j AS (SELECT board, child, parent, CASE WHEN y >= py THEN 1 ELSE -1 END AS side, CAST(1.4 AS DOUBLE) * abs(x - px) + abs(y - py) AS distance FROM c JOIN p USING (board) WHERE abs(x - px) <= 240 AND abs(y - py) <= 260)
SELECT board, child, parent, side, round(distance, 6) AS distance FROM j QUALIFY row_number() OVER (PARTITION BY child, side ORDER BY distance, parent) = 1""")
def strategy_parents(spark, d):
    key, who = F.col("o_orderkey"), F.col("c_custkey")
    children = t(spark, d, "orders").select((F.col("o_custkey") % 4).alias("board"), key.alias("child"), (key * 37 % 6000).alias("x"), (key * 11 % 4100).alias("y"))
    parents = t(spark, d, "customer").select((who % 4).alias("board"), who.alias("parent"), who.alias("ord"), (who * 91 % 6000).alias("x"), (who * 53 % 4100).alias("y"))
    return plane.nearest_per_side(children, parents, ["board"], "child", "parent", "ord").select("board", "child", "parent", "side", F.round("distance", 6).alias("distance"))


#: Vertices round each nation's centre and labels at angles of their own.
_CIRCLE = """v AS (SELECT c_nationkey AS polygon, c_custkey AS vertex, radians(c_custkey * 53 % 3600 / CAST(10 AS DOUBLE)) AS a FROM customer),
l AS (SELECT o_custkey % 25 AS polygon, o_orderkey AS label, radians((o_orderkey * 77 % 7200 - 3600) / CAST(10 AS DOUBLE) + CAST(0.013 AS DOUBLE)) AS a FROM orders)"""


def _circle(spark, d):
    who, key = F.col("c_custkey"), F.col("o_orderkey")
    vertices = t(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("polygon"), who.alias("vertex"), F.radians(who * 53 % 3600 / F.lit(10.0)).alias("angle"))
    labels = t(spark, d, "orders").select((F.col("o_custkey") % 25).alias("polygon"), key.alias("label"), F.radians((key * 77 % 7200 - 3600) / F.lit(10.0) + 0.013).alias("angle"))
    return vertices, labels


@query(f"""WITH {_CIRCLE}, j AS (SELECT polygon, label, vertex, abs(v.a - l.a) - floor(abs(v.a - l.a) / (2 * pi())) * 2 * pi() AS turn FROM l JOIN v USING (polygon))
SELECT polygon, label, vertex FROM j QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(least(turn, 2 * pi() - turn), 9), vertex) = 1""")
def circle_vertices(spark, d):
    vertices, labels = _circle(spark, d)
    return plane.nearest_on_circle(vertices, labels, "polygon", "vertex", "label")


@query(f"""WITH {_CIRCLE}, n AS (SELECT polygon, label, a + pi() / 2 - floor((a + pi() / 2) / (2 * pi())) * 2 * pi() AS turn FROM l)
SELECT polygon, label, row_number() OVER (PARTITION BY polygon ORDER BY round(turn, 9), label) AS place FROM n""")
def circle_places(spark, d):
    _, labels = _circle(spark, d)
    labels = labels.withColumn("angle", F.round(plane.turned(F.col("angle") + math.pi / 2), 9) - math.pi / 2)
    return plane.circle_order(labels, "polygon", "label").select("polygon", "label", "place")


@query("""WITH p AS (SELECT o_custkey AS line, o_orderkey AS ord, o_orderkey * 7 % 100 AS x, o_orderkey * 3 % 80 AS y FROM orders),
s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step, lag(x) OVER w AS fx, lag(y) OVER w AS fy FROM p WINDOW w AS (PARTITION BY line ORDER BY ord)),
c AS (SELECT *, sum(step) OVER (PARTITION BY line ORDER BY ord) AS so_far FROM s),
g AS (SELECT DISTINCT line, share FROM c, (VALUES (CAST(-1 AS DOUBLE)), (0.25), (0.5), (2)) v(share)),
f AS (SELECT g.line, share, greatest(0, least(1, share)) * max(so_far) OVER (PARTITION BY g.line, share) AS aim, ord, x, y, fx, fy, step, so_far FROM g JOIN c USING (line)),
n AS (SELECT * FROM f WHERE so_far >= aim - 1e-9 QUALIFY row_number() OVER (PARTITION BY line, share ORDER BY so_far, ord) = 1)
SELECT line, share, round(CASE WHEN fx IS NULL THEN x WHEN step = 0 THEN fx ELSE fx + (x - fx) * (aim - so_far + step) / step END, 6) AS x, round(CASE WHEN fy IS NULL THEN y WHEN step = 0 THEN fy ELSE fy + (y - fy) * (aim - so_far + step) / step END, 6) AS y FROM n""")
def polyline_points(spark, d):
    key = F.col("o_orderkey")
    points = t(spark, d, "orders").select(F.col("o_custkey").alias("line"), key.alias("ord"), (key * 7 % 100).alias("x"), (key * 3 % 80).alias("y"))
    targets = points.select("line").distinct().select("line", F.explode(F.array(*map(F.lit, (-1.0, 0.25, 0.5, 2.0)))).alias("share"))
    found = plane.points_at(points, targets.withColumn("mark", F.col("share")), "line", "ord", "mark")
    plus = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return found.select("line", F.col("mark").alias("share"), plus("x"), plus("y"))


@query("SELECT o_custkey % 7 AS board, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey * 3 % 90, o_custkey % 50, o_orderkey) AS place FROM orders")
def reading_order(spark, d):
    """Elements of a board from top to bottom, then from left to right."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    elements = t(spark, d, "orders").select((who % 7).alias("board"), key.alias("id"), (key * 3 % 90).alias("y"), (who % 50).alias("x"))
    return sequences.places(sequences.dealt(elements, ["board", "y", "x", "id"]), "board", "place").select("board", "id", "place")


@query("""WITH e AS (SELECT o_custkey % 20 AS board, o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderpriority || ' ' || o_custkey % 30 END AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'd"' || o_orderkey END AS detail, o_orderkey * 7 % 1000 AS x, o_orderkey % 50 AS y FROM orders),
b AS (SELECT * FROM e WHERE title <> '' OR detail <> '' QUALIFY row_number() OVER (PARTITION BY board, coalesce(nullif(title, ''), detail) ORDER BY detail = '', x, y, id) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY x, y, id) AS place FROM b),
l AS (SELECT c_custkey % 15 AS board, c_custkey AS ord, c_custkey * 13 % 900 + 20 AS lx, '20' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS text FROM customer),
n AS (SELECT p.*, text FROM p LEFT JOIN l USING (board) QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY abs(lx - x - 40), ord) = 1)
SELECT board, 'timeline' || chr(10) || '  title 时间轴' || string_agg(chr(10) || '  ' || coalesce(text, '阶段 ' || place) || ' : ' || CASE WHEN title = '' THEN '事件 ' || place ELSE title END || CASE WHEN detail = '' THEN '' ELSE chr(10) || '    : ' || replace(detail, '"', chr(92) || '"') END, '' ORDER BY place) AS mermaid
FROM n GROUP BY board""")
def board_timelines(spark, d):
    key, who, mark = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    title = F.when(key % 17 == 0, "").otherwise(F.concat("o_orderpriority", F.lit(" "), (who % 30).cast("string")))
    detail = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit('d"'), key.cast("string")))
    events = t(spark, d, "orders").select((who % 20).alias("board"), key.alias("id"), title.alias("title"), detail.alias("detail"), (key * 7 % 1000).alias("x"), (key % 50).alias("y"), F.lit(80).alias("width"))
    labels = t(spark, d, "customer").select((mark % 15).alias("board"), mark.alias("ord"), (mark * 13 % 900 + 20).alias("x"), F.concat(F.lit("20"), F.lpad((mark % 100).cast("string"), 2, "0")).alias("text"))
    return flow.timelines(events, labels, "board", "id")
