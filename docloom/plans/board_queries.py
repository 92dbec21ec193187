"""Board, record, card and workbook queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import boards, cards, records
from docloom.sources import workbook

from .catalog_queries import t
from .content_queries import _CELLS, _cells

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PAINT = 'fill="none" stroke="#333" stroke-width="1"'
_ELEMENTS = f"""e AS (SELECT p_brand AS board, p_partkey AS id, p_size AS z, CAST(p_partkey % 100 * 10 AS BIGINT) AS x, CAST(p_size * 10 AS BIGINT) AS y FROM part),
m AS (SELECT *, '<g>' || CASE id % 4
  WHEN 0 THEN '<rect x="' || x || '" y="' || y || '" width="80" height="40" rx="2" {_PAINT}/>'
  WHEN 1 THEN '<polygon points="' || (x + 40) || ',' || y || ' ' || (x + 80) || ',' || (y + 20) || ' ' || (x + 40) || ',' || (y + 40) || ' ' || x || ',' || (y + 20) || '" {_PAINT}/>'
  WHEN 2 THEN '<rect x="' || x || '" y="' || y || '" width="80" height="40" rx="20" {_PAINT}/>'
  ELSE '<ellipse cx="' || (x + 40) || '" cy="' || (y + 20) || '" rx="40" ry="20" {_PAINT}/>' END || '</g>' AS markup FROM e)"""


def _elements(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("rect", "decision", "start-end", "ellipse")])
    return t(spark, d, "part").select(
        F.col("p_brand").alias("board"), F.col("p_partkey").alias("id"), F.col("p_size").alias("z"), (F.col("p_partkey") % 100 * 10).alias("x"), (F.col("p_size") * 10).alias("y"),
        F.lit(80).alias("width"), F.lit(40).alias("height"), kinds[(F.col("p_partkey") % 4).cast("int")].alias("shape"),
        F.lit(None).cast("string").alias("fill"), F.lit(None).cast("string").alias("stroke"), F.lit(None).cast("double").alias("stroke_width"),
    )


@query(f"WITH {_ELEMENTS} SELECT board, id, markup FROM m")
def board_shapes(spark, d):
    return _elements(spark, d).select("board", "id", boards.element(F.col("shape"), boards.Box.of()).alias("markup"))


@query(f"""WITH {_ELEMENTS}, b AS (SELECT board, min(x) - 72 AS x, min(y) - 72 AS y, max(x) + 80 - min(x) + 144 AS w, max(y) + 40 - min(y) + 144 AS h, string_agg(markup, chr(10) ORDER BY z, id) AS body FROM m GROUP BY board)
SELECT board, w AS width, h AS height, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="' || x || ' ' || y || ' ' || w || ' ' || h || '" width="' || w || '" height="' || h || '" style="{boards.STYLE.replace("'", "''")}">' || chr(10)
  || '<rect x="' || x || '" y="' || y || '" width="' || w || '" height="' || h || '" fill="#fff"/>' || chr(10) || body || chr(10) || '</svg>' AS svg FROM b""")
def board_svg(spark, d):
    box = boards.Box.of()
    return boards.drawings(_elements(spark, d), "board", ["z", "id"], box, boards.element(F.col("shape"), box))


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS number, p_size || '%' AS progress, repeat('★', CAST(p_size % 6 AS BIGINT)) || ' (' || (p_size % 6) || ')' AS rate,
CASE WHEN p_size % 2 = 1 THEN '[x]' ELSE '[ ]' END AS box, CASE WHEN p_size % 2 = 1 THEN '✓' ELSE '' END AS tick, p_brand || ', ' || p_type AS choices FROM part""")
def record_values(spark, d):
    size, odd = F.col("p_size").cast("string"), (F.col("p_size") % 2).cast("string")
    six = (F.col("p_size") % 6).cast("string")
    both = F.to_json(F.array("p_brand", "p_type"))
    md = lambda kind, value: records.markdown_value(F.lit(kind), value)
    return t(spark, d, "part").select("p_partkey", md("number", F.concat(size, F.lit(".00"))).alias("number"), md("progress", size).alias("progress"), md("rate", six).alias("rate"), md("checkbox", odd).alias("box"), records.sheet_value(F.lit("checkbox"), odd).alias("tick"), md("multiSelect", both).alias("choices"))


@query("SELECT s_nationkey AS grid, string_agg('### ' || s_name || chr(10) || '- Key: ' || s_suppkey, chr(10) || chr(10) ORDER BY s_suppkey) AS text FROM supplier GROUP BY s_nationkey")
def card_view(spark, d):
    cell = lambda i, name, text: F.struct(F.lit(i).alias("ord"), F.lit(name).alias("name"), text.alias("text"))
    cells = t(spark, d, "supplier").select(F.col("s_nationkey").alias("grid"), "s_suppkey", F.col("s_name").alias("title"), F.lit(False).alias("cover"), F.explode(F.array(cell(0, "Name", F.col("s_name")), cell(1, "Key", F.col("s_suppkey").cast("string")))).alias("cell"))
    return records.cards(cells.select("*", "cell.*"), "grid", "s_suppkey", "ord", "title", "name", "text", "cover")


@query("SELECT p_brand, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY p_partkey) AS percents FROM part GROUP BY p_brand")
def progress_chart(spark, d):
    texts = t(spark, d, "part").select("p_brand", "p_partkey", F.concat(F.lit("done "), F.col("p_size").cast("string"), F.lit("%")).alias("text"))
    return records.progress_chart(texts, "p_brand", ["p_partkey"], "text").select("p_brand", F.array_join(F.col("percents").cast("array<string>"), ",").alias("percents"))


@query("""SELECT user_id, event_id, CASE event_type WHEN 'click' THEN '`' || event_type || '`' WHEN 'view' THEN '@' || event_type WHEN 'purchase' THEN chr(10) || '```sql' || chr(10) || event_type || chr(10) || '```' || chr(10) ELSE event_type END AS markdown FROM events""")
def card_markdown(spark, d):
    kind = F.col("event_type")
    name = F.when(kind == "click", "label").when(kind == "view", "mention").when(kind == "purchase", "codeblock").otherwise("unknown")
    payload = F.to_json(F.struct(F.when(kind != "view", kind).alias("text"), F.when(kind == "view", kind).alias("name"), F.lit("sql").alias("mode"), kind.alias("code")))
    return t(spark, d, "events").select("user_id", "event_id", cards.card(name, payload).alias("markdown"))


@query(f"WITH c AS ({_CELLS}) SELECT sheet, count(*) AS n FROM c GROUP BY sheet")
def sheet_workbook(spark, d):
    """Numbers in each sheet's workbook, counted in the markup that was written."""
    made = workbook.workbooks(_cells(spark, d), "sheet")
    return made.select("sheet", F.regexp_count(workbook.sheet_markup(F.col("content")), F.lit("<v>")).cast("long").alias("n"))
