"""Tables of contents, cards and attributes out of pages; data tables by their view, against rules written out in Python."""

import json
from urllib.parse import quote

from pyspark.sql import functions as F

from docloom.operators import extract, views


def toc(*uuids):
    return {"book": {"toc": [{"uuid": u, "parent_uuid": "", "type": "DOC", "title": f"t {u}+%", "doc_id": k} for k, u in enumerate(uuids)]}}


def payload(value) -> str:
    return f'decodeURIComponent("{quote(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))}")'


def test_toc_of_pages(spark):
    state = 'window.__INITIAL_STATE__ = {"repository":{"toc":[{"uuid":"s"}]}} ;'
    pages = [
        payload(toc("a", "é")), 'decodeURIComponent("%zz") ' + payload("no json") + payload({"book": {"toc": "x"}}) + payload(toc("b")) + payload(toc("c")), state, payload({"book": 1}) + state,
        'window.__INITIAL_STATE__={"book":{"toc":[{"uuid":"k"},{"title":"no uuid"}]}};', "window.__INITIAL_STATE__={broken};", "", None, payload({"book": {"toc": []}}) + state,
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "page int, html string")
    found = extract.toc_rows(df, "page", "html").collect()
    assert sorted((r.page, r.ord, r.uuid) for r in found) == [(0, 0, "a"), (0, 1, "é"), (1, 0, "b"), (2, 0, "s"), (3, 0, "s"), (4, 0, "k")]
    assert {r.title for r in found if r.page == 0} == {"t a+%", "t é+%"} and all(r.parent_uuid is None for r in found)


def test_attributes_and_cards(spark):
    html = '<!doctype lake><META name="x"><p><card name="\\&quot;math\\&quot;" value="&quot;a&amp;b&quot;"></card><CARD type=x name=\'single\' value=" v "/>text<card></p>'
    rows = extract.cards(spark.createDataFrame([(1, html), (2, ""), (3, None)], "doc int, html string"), "doc", "html", ["name", "value"]).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "math", "a&b"), (1, 1, "", "v")]
    plain = spark.createDataFrame([(html,)], "html string").select(extract.repaired(F.col("html"))).first()[0]
    assert plain.startswith('<p><card name="math"')


def markdown(spark, contents, **more):
    df = spark.createDataFrame([(k, c if c is None or isinstance(c, str) else json.dumps(c, ensure_ascii=False), f"t{k}" if k % 2 else None) for k, c in enumerate(contents)], "doc int, content string, name string")
    return {r.doc: r.markdown for r in views.table_texts(df, "doc", F.col("content"), F.col("name"), **more).collect()}


def sheet(view=None, columns=("a", "b", "c"), records=(), **more):
    named = [{"id": c, "name": c.upper() if c != "c" else "", "type": "text"} for c in columns]
    return {"sheet": [{"activeView": "v", "columns": named, "views": {"v": view} if view else {}, **more}], "records": [{"uuid": f"u{k}", "data": d} for k, d in enumerate(records)]}


def test_grids_by_view(spark):
    data = [{"a": "1", "b": {"value": "x|y/z"}, "c": None}, json.dumps({"a": 2, "b": True}), "broken{", {"c": "3\n4"}]
    view = {"columns": [{"id": "b"}, {"id": "a", "hidden": True}, {"id": "gone"}], "rows": [{"id": "u3"}, {"id": "none"}, {"id": "u1"}], "name": "V"}
    own = {"sheet": [{"defaultView": "v", "columns": [{"id": "a"}], "views": {"v": {"columns": []}}, "records": [{"uuid": "r", "data": {"a": "own"}}]}]}
    found = markdown(spark, [sheet(records=data), sheet(view, records=data), sheet({**view, "date": {"titleId": "a"}}, records=data), own, sheet(columns=()), "{}", None, "no json", sheet(view)])
    assert found[0].startswith("\n**数据表格**\n\n| A | B | c |\n| --- | --- | --- |\n| 1 | ") and found[0].count("\n| ") == 5
    assert found[1].startswith("\n**V（GRID）**\n\n| B |\n| --- |\n| true |\n| ") and found[1].count("\n| ") == 4
    assert found[2].startswith("\n**V（GRID）**\n\n| B | A |\n| --- | --- |\n| true | 2 |\n| ")
    assert found[3] == "\n**数据表格**\n\n| a |\n| --- |\n| own |\n\n"
    assert [found[k] for k in (4, 5, 6, 7)] == ["", "\n> 数据表格：t5\n", "", "\n> 数据表格：t7\n"]
    assert found[8] == "\n**V（GRID）**\n\n| B |\n| --- |\n\n"


def test_everything_is_exported_on_request(spark):
    view = {"columns": [{"id": "b"}, {"id": "a", "hidden": True}]}
    found = markdown(spark, [sheet(view, records=[{"a": "1", "b": "2", "c": "3"}])], export_all=F.lit(True))
    assert found[0] == "\n**数据表格**\n\n| B | A | c |\n| --- | --- | --- |\n| 2 | 1 | 3 |\n\n"


def test_cards_and_kanban(spark):
    data = [{"a": "one", "b": "x", "c": "k"}, {"b": "y"}, {"a": "two", "b": "x"}]
    card = {"type": "CARD", "cover": {"id": "c", "titleId": "a"}}
    kanban = {"type": "KANBAN", "group": [{"id": "b"}], "columns": [{"id": "a"}]}
    found = markdown(spark, [sheet(card, records=data), sheet(kanban, records=data), sheet(kanban)])
    assert found[0] == "\n**数据表格**\n\n### one\n\nk\n- B: x\n\n### 未命名记录\n- B: y\n\n### two\n- B: x\n\n"
    assert found[1] == "\n**数据表格**\n\n### x\n- one\n- two\n\n### y\n- 未命名记录\n\n"
    assert found[2] == "\n**数据表格**\n\n\n\n"
