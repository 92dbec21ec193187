"""Cards embedded in documents, as Markdown: one expression over a card's name and its JSON payload.

Missing fields count as empty texts; a payload that is null or no object gives what its card gives
without fields. Boards and data tables inside cards have operators of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as tx


def _get(data: Column, *paths: str) -> Column:
    """The first field that is there and not empty; else an empty text."""
    return F.coalesce(*[F.nullif(F.get_json_object(data, f"$.{p}"), F.lit("")) for p in paths], F.lit(""))


def _or(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def _block(text: Column) -> Column:
    """A text on lines of its own; nothing for nothing."""
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("\n"), text, F.lit("\n")))


def fence(language: Column, code: Column) -> Column:
    return F.concat(F.lit("\n```"), language, F.lit("\n"), code, F.lit("\n```\n"))


def diagram(name: Column, data: Column) -> Column:
    """The source in a fence of its language, then its picture."""
    code, kind = _get(data, "code"), F.lower(_or(_get(data, "type"), _get(data, "mode"), _get(data, "name"), name))
    language = F.when(kind == "plantuml", kind).when((name == "flowchart2") | kind.isin("mermaid", "flowchart2"), F.lit("mermaid")).otherwise(kind)
    source = F.when(code == "", F.lit("")).otherwise(fence(language, code))
    whole = F.array_join(F.filter(F.array(source, tx.markdown_image(F.lit("图表"), _get(data, "url", "src"))), lambda p: p != ""), "\n\n")
    return F.when(whole == "", F.lit("")).otherwise(F.concat(F.lit("\n"), whole, F.lit("\n\n")))


def gallery(data: Column) -> Column:
    images = F.from_json(F.get_json_object(data, "$.imageList"), "array<struct<src:string,title:string>>")
    shown = F.filter(F.transform(images, lambda i: tx.markdown_image(i["title"], i["src"])), lambda m: m != "")
    return F.coalesce(F.array_join(shown, "\n"), F.lit(""))


def card(name: Column, data: Column, display: Column | None = None) -> Column:
    """Markdown of a card; ``display`` tells formulas that stand alone."""
    src = _get(data, "src")
    minutes = F.coalesce(F.date_format(F.timestamp_millis(_get(data, "date").try_cast("long")), "yyyy-MM-dd HH:mm"), F.lit(""))
    mention, label = _get(data, "name", "login"), _get(data, "text", "label")
    other = (
        F.when(_get(data, "src", "url") != "", tx.markdown_link(_or(_get(data, "name", "title"), F.lit("链接")), _get(data, "src", "url")))
        .when(_get(data, "text") != "", _get(data, "text"))
        .otherwise(tx.html_to_text(_get(data, "search")))
    )
    return (
        F.when(name == "hr", F.lit("\n---\n"))
        .when(name == "image", tx.markdown_image(_get(data, "name", "title"), src))
        .when(name == "codeblock", fence(_get(data, "mode"), _get(data, "code")))
        .when(name == "markdown", _block(_get(data, "markdown")))
        .when(name == "math", tx.markdown_math(_get(data, "code"), display if display is not None else F.lit(False)))
        # names of cards: fixed values of the format
        .when(name.isin("bookmarklink", "bookmarkInline"), tx.markdown_link(_or(_get(data, "detail.title", "text"), src), src))
        .when(name == "yuqueinline", tx.markdown_link(_or(_get(data, "detail.title", "name"), src), src))
        .when(name == "localdoc", tx.markdown_link(_or(_get(data, "name"), F.lit("附件")), src))
        .when(name.isin("diagram", "flowchart2"), diagram(name, data))
        .when(name == "table", _block(_get(data, "html")))
        .when(name == "dateCard", _block(minutes))
        .when(name == "imageGallery", gallery(data))
        .when(name == "mention", F.when(mention == "", F.lit("")).otherwise(F.concat(F.lit("@"), mention)))
        .when(name == "label", F.when(label == "", F.lit("")).otherwise(F.concat(F.lit("`"), label, F.lit("`"))))
        .when(name.isin("checkIn", "board", "dataTable"), F.lit(""))
        .otherwise(other)
    )
