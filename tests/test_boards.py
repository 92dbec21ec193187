"""Boards, records, cards, packed sheets and workbooks on small tables."""

import json
import zlib

from pyspark.sql import functions as F

from docloom.operators import boards, cards, records
from docloom.sources import packed, workbook


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_shapes(spark):
    rows = [(k, 10.0, 20.0, 100.0, 50.0) for k in ("decision", "hexagon", "finish", "weak-entity", "note", "database", None)] + [("rect", None, None, None, None)]
    df = spark.createDataFrame(rows, "shape string, x double, y double, width double, height double").withColumns({"fill": F.lit(None).cast("string"), "stroke": F.lit(""), "stroke_width": F.lit(2)})
    got = {r["shape"]: r["m"] for r in df.select("shape", boards.element(F.col("shape"), boards.Box.of()).alias("m")).collect()}
    paint = 'fill="none" stroke="#333" stroke-width="2"'
    assert got["decision"] == f'<g><polygon points="60,20 110,45 60,70 10,45" {paint}/></g>'
    assert got["hexagon"] == f'<g><polygon points="28,20 92,20 110,45 92,70 28,70 10,45" {paint}/></g>'
    assert got["finish"] == '<g><circle cx="60" cy="45" r="25" fill="#fff" stroke="#333" stroke-width="2"/><circle cx="60" cy="45" r="21" fill="#333" stroke="none"/></g>'
    assert got["weak-entity"] == f'<g><rect x="10" y="20" width="100" height="50" rx="1" {paint}/><rect x="14" y="24" width="92" height="42" rx="1" {paint}/></g>'
    assert got["note"].startswith('<g><path d="M10,20 H97.5 L110,32.5 V70 H10 Z" ')
    assert "<ellipse" in got["database"] and "NaN" not in got["database"]
    assert got[None] == f'<g><rect x="10" y="20" width="100" height="50" {paint}/></g>'
    assert got["rect"] == f'<g><rect x="0" y="0" width="0" height="0" rx="2" {paint}/></g>'
    assert boards.drawings(df.limit(0).withColumn("b", F.lit(1)), "b", ["x"], boards.Box.of(), F.lit("")).count() == 0


def test_cells(spark):
    md = lambda kind, value, **k: one(spark, records.markdown_value(F.lit(kind), F.lit(value).cast("string"), **k))
    options = F.create_map(F.lit("a"), F.lit("Open"), F.lit("b"), F.lit("Done"))
    assert md("select", '"a"', options=options) == "Open"
    assert md("multiSelect", '["a","b","z"]', options=options) == "Open, Done, z"
    assert md("date", '{"time":"2024-01-02T03:04:05Z"}') == "2024-01-02T03:04:05Z"
    assert [md("checkbox", v) for v in ("true", "false", None)] == ["[x]", "[ ]", ""]
    assert md("user", '[{"id":"u1","name":"Ann"},"u2"]') == "Ann, u2"
    assert md("url", '{"title":"T","url":"http://x"}') == "[T](http://x)"
    assert md("image", '["http://i",{"src":"http://j","name":"n"}]') == "![](http://i)<br>![n](http://j)"
    assert md("file", '{"url":"http://f"}') == "[http://f](http://f)"
    assert [md("number", "1.500"), md("number", '"3.00"'), md("progress", "12.0")] == ["1.5", "3", "12%"]
    assert [md("rate", "3"), md("rate", '"bad"')] == ["★★★ (3)", "bad"]
    assert md("input", '[{"text":"p"},{"name":"q"},""]') == "p, q"
    assert md("createdAt", None, record_time=F.lit("2024-01-02T03:04:05Z")) == "2024-01-02 03:04"
    sheet = lambda kind, value: one(spark, records.sheet_value(F.lit(kind), F.lit(value).cast("string")))
    assert [sheet("date", '{"time":"2024-01-02T03"}'), sheet("checkbox", "true"), sheet("progress", "49.5"), sheet("progress", '"x"'), sheet("mention", '{"login":"l"}')] == ["2024-01-02", "✓", "50%", "", "l"]


def test_cards(spark):
    md = lambda name, data: one(spark, cards.card(F.lit(name), F.lit(json.dumps(data))))
    assert md("hr", {}) == "\n---\n"
    assert md("codeblock", {"mode": "js", "code": "a"}) == "\n```js\na\n```\n"
    assert md("bookmarklink", {"src": "http://a", "detail": {"title": "T"}}) == "[T](http://a)"
    assert md("localdoc", {"src": "http://a"}) == "[附件](http://a)"
    assert md("imageGallery", {"imageList": [{"src": "http://a"}, {"title": "no"}, {"src": "http://b", "title": "t"}]}) == "![](http://a)\n![t](http://b)"
    assert md("dateCard", {"date": 1700000000000}) == "\n2023-11-14 22:13\n"
    assert md("mention", {"login": "l"}) == "@l" and md("label", {}) == "" and md("checkIn", {"src": "x"}) == ""
    assert md("flowchart2", {"code": "a-->b"}) == "\n\n```mermaid\na-->b\n```\n\n\n"
    assert md("other", {"url": "http://u"}) == "[链接](http://u)" and md("other", {"search": "<b>x</b>"}) == "x"
    assert one(spark, cards.card(F.lit("mention"), F.lit(None).cast("string"))) == ""


def test_progress_chart(spark):
    df = spark.createDataFrame([(1, 2, "b 30%"), (1, 1, "a 70%"), (1, 3, "x 999%"), (1, 4, None), (2, 1, "none")], "board int, y int, text string")
    got = records.progress_chart(df, "board", ["y"], "text").collect()
    option = json.loads(got[0]["text"].removeprefix("option = ").removesuffix(";"))
    assert len(got) == 1 and option["series"][0]["data"] == [70, 30] and option["yAxis"]["data"] == ["项目1", "项目2"]


def test_packed_sheets(spark):
    text = json.dumps([{"name": "Ü", "rows": 3}])
    rows = spark.createDataFrame([(zlib.compress(text.encode()).decode("latin-1"),), ("broken",), ("",), (None,)], "p string")
    assert [r[0] for r in rows.select(packed.inflate("p")).collect()] == [text, None, None, None]


def test_workbook(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a<b"), (1, 1, 27, "3.5"), (1, 2, 702, "007"), (1, 2, 1, None)], "k int, r int, c int, v string")
    merges = spark.createDataFrame([(1, 0, 0, 9, 2), (1, 5, 0, 1, 1)], "k int, row int, col int, row_count int, col_count int")
    got = workbook.workbooks(cells, "k", merges)
    markup = got.select(workbook.sheet_markup("content")).first()[0]
    assert '<c r="A1" t="inlineStr"><is><t xml:space="preserve">a&lt;b</t></is></c>' in markup
    assert '<c r="AB2"><v>3.5</v></c>' in markup and '<c r="AAA3" t="inlineStr">' in markup
    assert '<mergeCells><mergeCell ref="A1:B3"/></mergeCells>' in markup
    assert workbook.workbooks(cells.limit(0), "k").count() == 0
