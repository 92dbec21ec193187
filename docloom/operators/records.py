"""Cells of typed data tables as text, and the card view.

A cell is a row with its column's type and its value as JSON text. ``options`` and ``users`` are maps
from ids to labels; null maps know no labels. Null values give an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx


def scalar(value: Column) -> Column:
    """A JSON value as text: strings without quotes, objects and lists as they are written."""
    return F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]


def items(value: Column) -> Column:
    """Items of a JSON list; any other value is its own single item."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(scalar(value)))


def is_object(text: Column) -> Column:
    return text.startswith("{")


def field(text: Column, *names: str) -> Column:
    """The first of these fields of an object that is there and not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(text, f"$.{n}"), F.lit("")) for n in names])


def label_of(labels: Column | None, key: Column) -> Column:
    return key if labels is None else F.coalesce(F.nullif(labels[key], F.lit("")), key)


def _truth(value: Column) -> Column:
    return ~value.isin("false", "0", '""', "null")


def _object_text(text: Column) -> Column:
    """Text, titled link, name or bare link of an object; else the object itself."""
    title, url = field(text, "title"), field(text, "url")
    link = F.when(title.isNotNull() & url.isNotNull(), tx.markdown_link(title, url))
    return F.when(is_object(text), F.coalesce(field(text, "text"), link, field(text, "name"), tx.markdown_link(url, url), text)).otherwise(text)


def _joined(value: Column, each, sep: str = ", ") -> Column:
    return F.array_join(F.filter(F.transform(items(value), each), lambda s: F.coalesce(s, F.lit("")) != ""), sep)


def markdown_value(kind: Column, value: Column, options: Column | None = None, users: Column | None = None, record_time: Column | None = None) -> Column:
    """A cell's text in Markdown."""
    text = scalar(value)

    def user(item: Column) -> Column:
        key = F.when(is_object(item), field(item, "id")).otherwise(item)
        return F.coalesce(users[key] if users is not None else F.lit(None).cast("string"), F.when(is_object(item), field(item, "name", "login")), key)

    def image(item: Column) -> Column:
        return F.when(is_object(item), tx.markdown_image(F.coalesce(field(item, "name", "title"), F.lit("")), field(item, "src", "url"))).otherwise(tx.markdown_image(F.lit(""), item))

    def attachment(item: Column) -> Column:
        named = F.coalesce(field(item, "name", "title", "fileName", "url"), F.lit("附件"))
        return F.when(is_object(item), tx.markdown_link(named, field(item, "url", "src"))).otherwise(item)

    number = tx.trim_decimal(text)
    rating = text.try_cast("double")
    stars = F.greatest(F.floor(rating + 0.5), F.lit(0)).cast("int")
    link = F.when(is_object(text), tx.markdown_link(field(text, "title", "text", "name", "url", "src"), field(text, "url", "src"))).otherwise(text)
    stamped = tx.date_time_text(record_time) if record_time is not None else F.lit(None).cast("string")
    found = (
        F.when(value.isNull() | (value == "null"), F.when(kind.isin("createdAt", "updatedAt"), stamped))
        .when(kind.isin("select", "multiSelect"), F.array_join(F.transform(items(value), lambda i: label_of(options, i)), ", "))
        .when((kind == "date") & is_object(text), field(text, "text", "time"))
        .when(kind == "checkbox", F.when(_truth(value), "[x]").otherwise("[ ]"))
        .when(kind.isin("user", "member", "mention"), F.array_join(F.transform(items(value), user), ", "))
        .when(kind.isin("url", "link"), link)
        .when(kind == "image", _joined(value, image, "<br>"))
        .when(kind.isin("attachment", "file"), _joined(value, attachment))
        .when(kind == "number", number)
        .when(kind == "progress", F.concat(number, F.lit("%")))
        .when(kind == "rate", F.when(rating.isNotNull(), F.concat(F.repeat(F.lit("★"), stars), F.lit(" ("), number, F.lit(")"))).otherwise(text))
        .when(kind == "phone", text)
        .otherwise(_joined(value, _object_text))
    )
    return F.coalesce(found, F.lit(""))


def sheet_value(kind: Column, value: Column, options: Column | None = None) -> Column:
    """A cell's text in sheets: ticks, whole percents, days and plain names."""
    text = scalar(value)
    percent = F.floor(F.regexp_extract(text, r"^\s*([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double") + 0.5)
    found = (
        F.when(value.isNull() | (value == "null"), "")
        .when(kind.isin("select", "multiSelect"), F.array_join(F.transform(items(value), lambda i: label_of(options, i)), ", "))
        .when((kind == "date") & is_object(text), F.coalesce(field(text, "text"), F.substring_index(field(text, "time"), "T", 1), text))
        .when(kind == "checkbox", F.when(_truth(value), "✓").otherwise(""))
        .when(kind == "progress", F.concat(percent.cast("long").cast("string"), F.lit("%")))
        .when((kind == "mention") & is_object(text), field(text, "name", "login"))
        .otherwise(text)
    )
    return F.coalesce(found, F.lit(""))


def cards(cells: DataFrame, table: str, record: str, order: str, title: str, name: str, text: str, cover: str) -> DataFrame:
    """One text a table: a heading for each record, its cover and a bullet for each other value.

    Cells are gathered by record first, records by table after; a title that is empty is a placeholder.
    """
    headline = tx.missing_as(F.first(title), "未命名记录")
    ordered = F.array_sort(F.collect_list(F.struct(order, F.col(name).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(cover), F.lit(False)).alias("cover"))))
    gathered = cells.groupBy(table, record).agg(headline.alias("_title"), ordered.alias("_cells"))
    shown = F.filter("_cells", lambda c: c["cover"] & (c["text"] != ""))
    bullets = F.filter("_cells", lambda c: ~c["cover"] & (c["text"] != "") & (c["text"] != F.col("_title")))
    lines = F.concat(
        F.array(F.concat(F.lit("### "), "_title")),
        F.flatten(F.transform(shown, lambda c: F.array(F.lit(""), c["text"]))),
        F.transform(bullets, lambda c: F.concat(F.lit("- "), c["name"], F.lit(": "), c["text"])),
    )
    each = gathered.select(table, record, F.array_join(lines, "\n").alias("_text"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct(record, "_text"))), lambda r: r["_text"])
    return each.groupBy(table).agg(F.trim(F.array_join(whole, "\n\n")).alias("text"))


def progress_chart(texts: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """Chart option of each board's percentages from 0 to 100, in the order of their places."""
    percent = F.regexp_extract(text, r"(\d{1,3})%", 1).try_cast("int")
    found = texts.withColumn("_p", percent).where("_p between 0 and 100")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, "_p"))), lambda r: r["_p"])
    values = found.groupBy(key).agg(ordered.alias("percents"))
    names = F.transform("percents", lambda p, i: F.concat(F.lit("项目"), (i + 1).cast("string")))
    option = F.struct(
        F.struct(F.lit("{b}: {c}%").alias("formatter")).alias("tooltip"),
        F.struct(F.lit(90).alias("left"), F.lit(110).alias("right"), F.lit(24).alias("top"), F.lit(24).alias("bottom")).alias("grid"),
        F.struct(F.lit("value").alias("type"), F.lit(100).alias("max"), F.struct(F.lit("{value}%").alias("formatter")).alias("axisLabel")).alias("xAxis"),
        F.struct(F.lit("category").alias("type"), F.lit(True).alias("inverse"), names.alias("data")).alias("yAxis"),
        F.array(F.struct(
            F.lit("bar").alias("type"), F.col("percents").alias("data"), F.lit(22).alias("barWidth"),
            F.struct(F.lit(True).alias("show"), F.lit("right").alias("position"), F.lit("{c}%").alias("formatter")).alias("label"),
            F.struct(F.lit(6).alias("borderRadius")).alias("itemStyle"),
        )).alias("series"),
    )
    return values.select(key, F.concat(F.lit("option = "), F.to_json(option, {"pretty": "true"}), F.lit(";")).alias("text"), "percents")
