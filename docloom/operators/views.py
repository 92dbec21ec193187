"""Data tables kept as JSON: the active view, its columns and order of records, cells, and the grid, card and kanban texts.

A table's content has ``sheet[0]`` with ``columns`` and ``views``, and ``records`` (its own or the sheet's), whose ``data`` is an object or the
text of one. What is missing or no JSON counts as absent. Columns stay with their table as a list, records are rows of their own; a record's cells
are made in its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.checkpoints import written
from docloom.functions import text as tx
from docloom.operators import records

#: Texts and view types of the format. Fixed values.
UNNAMED, UNGROUPED, TABLE = "未命名记录", "未分组", "数据表格"
ALL_COLUMNS = ("CHART", "KANBAN")


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _list(value: Column, path: str) -> Column:
    return F.coalesce(_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _given(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def _dealt(rows: DataFrame) -> DataFrame:
    """For a join of rows that grow with the tables: like columns and views are small in a file and large in memory, so what
    a file's size says of them must not send them to the driver."""
    return rows.hint("merge")


def tables(rows: DataFrame, key: str, content: Column, export_all: Column | None = None) -> DataFrame:
    """``key``, ``sheet``, ``content``, the active ``view`` (null without one), its ``kind`` (GRID by default) and the ``columns`` shown, in the view's order.

    Hidden columns go unless the view needs them (its cover, dates, title, groups), shows all (charts, kanban), or everything is exported; then those
    that the view doesn't list follow. A view without columns shows the table's. Of columns of one id the last counts."""
    rows = rows.select(key, F.try_parse_json(content).alias("content"), (F.lit(False) if export_all is None else F.coalesce(export_all, F.lit(False))).alias("_all"))
    rows = rows.withColumn("sheet", _get(F.col("content"), "sheet[0]", "variant"))
    active = _given(_get(F.col("sheet"), "activeView"), _get(F.col("sheet"), "defaultView"))
    rows = rows.withColumn("view", _get(F.col("sheet"), "views", "map<string,variant>")[active])
    option = lambda o: F.struct(_get(o, "id").alias("id"), _get(o, "value").alias("value"))
    column = lambda c: F.struct(_get(c, "id").alias("id"), _get(c, "name").alias("name"), _get(c, "type").alias("type"), F.transform(_list(c, "options"), option).alias("options"))
    view = F.col("view")
    forced = F.concat(F.array(*[_get(view, p) for p in ("cover.id", "date.startId", "date.endId", "date.titleId")]), F.transform(_list(view, "group"), lambda g: _get(g, "id")))
    listed = F.transform(_list(view, "columns"), lambda c: F.struct(_get(c, "id").alias("id"), F.coalesce(_get(c, "hidden", "boolean"), F.lit(False)).alias("hidden")))
    rows = rows.select("*", F.coalesce(_given(_get(view, "type")), F.lit("GRID")).alias("kind"), F.transform(_list(F.col("sheet"), "columns"), column).alias("_own"), listed.alias("_listed"), F.filter(forced, lambda i: _given(i).isNotNull()).alias("_forced"))
    everything = F.col("_all") | F.col("kind").isin(*ALL_COLUMNS)
    wanted = F.filter("_listed", lambda c: everything | ~c["hidden"] | F.array_contains("_forced", c["id"]))
    found = F.filter(F.transform(wanted, lambda c: F.try_element_at(F.filter("_own", lambda o: o["id"] == c["id"]), F.lit(-1))), lambda o: o.isNotNull())
    rest = F.filter("_own", lambda o: ~F.exists(found, lambda f: f["id"] == o["id"]))
    shown = F.when(F.size("_listed") == 0, F.col("_own")).otherwise(F.concat(found, F.when(everything, rest).otherwise(F.slice("_own", 1, 0))))
    return rows.select(key, "content", "sheet", "view", "kind", shown.alias("columns"))


def table_records(found: DataFrame, key: str) -> DataFrame:
    """Records of :func:`tables`, with ``uuid``, ``data`` (values by column id, empty if it can't be read), ``created_at``, ``updated_at`` and
    ``seq``: first those that the view lists, in its order (of records of one id the last), then the others as they stand."""
    listed = F.coalesce(_get(F.col("content"), "records", "array<variant>"), _get(F.col("sheet"), "records", "array<variant>"))
    given = found.select(key, F.posexplode(listed).alias("_pos", "_r"))
    data = F.coalesce(F.try_variant_get(F.try_parse_json(_get(F.col("_r"), "data")), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    given = written(given.select(key, "_pos", _get(F.col("_r"), "uuid").alias("uuid"), data.alias("data"), *[_get(F.col("_r"), c).alias(c) for c in ("created_at", "updated_at")]))
    placed = found.select(key, F.posexplode(_list(F.col("view"), "rows")).alias("_place", "_row")).select(key, _get(F.col("_row"), "id").alias("uuid"), "_place")
    last = given.groupBy(key, "uuid").agg(F.max("_pos").alias("_pos"))
    first = placed.join(_dealt(last), [key, "uuid"])
    ahead = given.join(_dealt(first.select(key, "_pos", F.struct(F.lit(0).alias("after"), F.col("_place").alias("at")).alias("seq"))), [key, "_pos"])
    used = first.select(key, "uuid").distinct()
    others = given.join(_dealt(used), [key, "uuid"], "left_anti").withColumn("seq", F.struct(F.lit(1).alias("after"), F.col("_pos").alias("at")))
    return ahead.unionByName(others).drop("_pos")


def value_text(data: Column, column: Column, created: Column, updated: Column) -> Column:
    """A cell's text in Markdown: the value itself or its member ``value``, by the column's type."""
    raw = data[column["id"]]
    inner = F.try_variant_get(raw, "$.value", "variant")
    value = F.to_json(F.when(inner.isNotNull() & ~F.is_variant_null(inner), inner).otherwise(raw))
    options = F.map_from_entries(F.filter(column["options"], lambda o: o["id"].isNotNull()))
    stamp = F.when(column["type"] == "createdAt", created).otherwise(updated)
    return records.markdown_value(F.coalesce(column["type"], F.lit("")), value, options, None, stamp)


def record_texts(found: DataFrame, key: str) -> DataFrame:
    """Records with ``cells``, the texts of their table's columns in turn, and ``kind``, ``columns`` and ``view``."""
    rows = table_records(found, key).join(_dealt(found.select(key, "kind", "columns", "view")), key)
    return rows.withColumn("cells", F.transform("columns", lambda c: value_text(F.col("data"), c, F.col("created_at"), F.col("updated_at"))))


def _title(but: Column) -> Column:
    """Title of a record: the view's title column, if it is shown and isn't ``but``, or the first that is shown."""
    view, places = F.col("view"), F.filter(F.sequence(F.lit(1), F.greatest(F.size("columns"), F.lit(1))), lambda k: (k <= F.size("columns")) & ~F.coalesce(F.try_element_at("columns", k)["id"] == but, F.lit(False)))
    wanted = _given(_get(view, "date.titleId"), _get(view, "cover.titleId"))
    chosen = F.filter(places, lambda k: F.try_element_at("columns", k)["id"] == wanted)
    return F.coalesce(_given(F.try_element_at("cells", F.coalesce(F.try_element_at(chosen, F.lit(1)), F.try_element_at(places, F.lit(1)), F.lit(1)))), F.lit(UNNAMED))


def _joined(parts: Column, key: str, rows: DataFrame, between: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["text"]), between).alias("body"))


def grid_bodies(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``body``: the grid of a table, names first. Rows of blank cells only are left out; if the names are blank, the first row that isn't stands for them."""
    head = found.where("kind not in ('CARD', 'KANBAN')").select(key, F.struct(F.lit(-1).alias("after"), F.lit(0).alias("at")).alias("seq"), F.transform("columns", lambda c: F.coalesce(_given(c["name"], c["id"]), F.lit(""))).alias("cells"))
    lines = head.unionAll(rows.where("kind not in ('CARD', 'KANBAN')").select(key, "seq", "cells"))
    lines = lines.select(key, "seq", F.transform("cells", lambda c: tx.markdown_cell(c)).alias("cells")).where(F.exists("cells", lambda c: c != ""))
    line = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size("cells")), " | "), F.lit(" |"))
    whole = F.array_sort(F.collect_list(F.struct("seq", line.alias("text"))))
    return lines.groupBy(key).agg(F.first(rule).alias("_rule"), F.transform(whole, lambda p: p["text"]).alias("_t")).select(key, F.array_join(F.concat(F.slice("_t", 1, 1), F.array("_rule"), F.slice("_t", 2, 1 << 30)), "\n").alias("body"))


def card_bodies(rows: DataFrame, key: str) -> DataFrame:
    """``body``: a heading for each record, its cover and a bullet for each other value but the title."""
    cover = _get(F.col("view"), "cover.id")
    named = F.transform(F.sequence(F.lit(1), F.size("columns")), lambda k: F.struct(F.try_element_at("columns", k).alias("c"), F.try_element_at("cells", k).alias("v")))
    rows = rows.where("kind = 'CARD' and size(columns) > 0").select(key, "seq", _title(cover).alias("title"), cover.alias("cover"), named.alias("named"))
    image = F.array_join(F.transform(F.filter("named", lambda n: n["c"]["id"] == F.col("cover")), lambda n: F.when(n["v"] != "", F.concat(F.lit("\n\n"), n["v"]))), "")
    told = F.filter("named", lambda n: ~F.coalesce(n["c"]["id"] == F.col("cover"), F.lit(False)) & (n["v"] != "") & (n["v"] != F.col("title")))
    bullets = F.array_join(F.transform(told, lambda n: F.concat(F.lit("\n- "), F.coalesce(_given(n["c"]["name"], n["c"]["id"]), F.lit("")), F.lit(": "), n["v"])), "")
    return _joined(F.struct("seq", F.concat(F.lit("### "), "title", image, bullets).alias("text")), key, rows, "\n\n")


def kanban_bodies(rows: DataFrame, key: str) -> DataFrame:
    """``body``: a heading for each value of the view's group, in the order in which values first occur, and a bullet for each record's title."""
    group = _given(_get(F.element_at(_list(F.col("view"), "group"), 1), "id"))
    rows = rows.where("kind = 'KANBAN' and size(columns) > 0").where(F.size(_list(F.col("view"), "group")) > 0)
    at = F.filter(F.sequence(F.lit(1), F.size("columns")), lambda k: F.try_element_at("columns", k)["id"] == group)
    value = F.coalesce(_given(F.try_element_at("cells", F.try_element_at(at, F.lit(1)))), F.lit(UNGROUPED))
    rows = rows.select(key, "seq", value.alias("grp"), F.concat(F.lit("- "), _title(group)).alias("text"))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "\n")
    groups = rows.groupBy(key, "grp").agg(F.min("seq").alias("seq"), F.concat(F.lit("### "), F.first("grp"), F.lit("\n"), one).alias("text"))
    return _joined(F.struct("seq", "text"), key, groups, "\n\n")


def table_texts(rows: DataFrame, key: str, content: Column, name: Column, export_all: Column | None = None) -> DataFrame:
    """``key`` and ``markdown``: each table's text by its active view, under the view's name; of a table without columns a line with its ``name``, if it has one.

    Grids stand for views without a text of their own. A table's text is one value, gathered by table."""
    found = written(tables(rows, key, content, export_all))
    texts = written(record_texts(found, key))
    bodies = reduce(DataFrame.unionAll, [grid_bodies(texts, found, key), card_bodies(texts, key), kanban_bodies(texts, key)])
    title = F.coalesce(F.concat(F.lit("**"), _given(_get(F.col("view"), "name")), F.lit("（"), F.col("kind"), F.lit("）**")), F.lit(f"**{TABLE}**"))
    whole = F.concat(F.lit("\n"), title, F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n\n"))
    absent = F.coalesce(F.concat(F.lit(f"\n> {TABLE}："), _given(F.col("_name").cast("string")), F.lit("\n")), F.lit(""))
    names = rows.select(key, name.alias("_name"))
    return found.join(_dealt(bodies), key, "left").join(_dealt(names), key).select(key, F.when(F.size("columns") > 0, whole).otherwise(absent).alias("markdown"))
