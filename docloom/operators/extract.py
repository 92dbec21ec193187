"""What pages carry besides their text: a table of contents in encoded payloads, and cards with their attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx

#: A payload in a page, a page's state, a doubly escaped attribute, marks of the format. Fixed values.
PAYLOAD = r'decodeURIComponent\("([^"]+)"\)'
STATE = r"window\.__INITIAL_STATE__\s*=\s*(\{[\s\S]*?\})\s*;"
ESCAPED = r'="\\&quot;([^"]*?)\\&quot;"'
DOCTYPE, META = r"(?i)<!doctype lake>", r"(?i)<meta[^>]*>"
CARD = r"(?i)<card\s+([^>]*)>"


def decoded(component: Column) -> Column:
    """A percent-encoded text, null if it can't be decoded; a plus sign is itself."""
    return F.try_url_decode(F.replace(component, F.lit("+"), F.lit("%2B")))


def toc(html: Column) -> Column:
    """The table of contents of a page, a list of VARIANT: that of the first payload that has ``book.toc`` as a list, else that of the page's state
    (``book.toc``, or ``repository.toc`` where the book has none); null without one. Payloads that can't be decoded or parsed are passed over."""
    parsed = F.transform(F.regexp_extract_all(html, F.lit(PAYLOAD), F.lit(1)), lambda p: F.try_variant_get(F.try_parse_json(decoded(p)), "$.book.toc", "array<variant>"))
    first = F.try_element_at(F.filter(parsed, lambda p: p.isNotNull()), F.lit(1))
    state = F.try_parse_json(F.nullif(F.regexp_extract(html, STATE, 1), F.lit("")))
    return F.coalesce(first, *[F.try_variant_get(state, f"$.{owner}.toc", "array<variant>") for owner in ("book", "repository")])


def toc_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, ``ord``, ``uuid``, ``parent_uuid`` (null where empty), ``type``, ``title`` and ``doc_id`` of the entries of each page's table of contents,
    as :func:`docloom.operators.listing.toc_paths` takes them. Entries without a uuid are left out."""
    rows = pages.select(key, F.posexplode(toc(F.col(html))).alias("ord", "_e"))
    text = lambda name: F.nullif(F.try_variant_get("_e", f"$.{name}", "string"), F.lit("")).alias(name)
    found = rows.select(key, F.col("ord").cast("long").alias("ord"), *map(text, ("uuid", "parent_uuid", "type", "title")), F.try_variant_get("_e", "$.doc_id", "long").alias("doc_id"))
    return found.where("uuid is not null")


def repaired(html: Column) -> Column:
    """A document without its type and meta marks; attributes that were escaped twice are as they were meant."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DOCTYPE, ""), META, ""), ESCAPED, '="$1"')


def attribute(attributes: Column, name: str) -> Column:
    """The value of an attribute in double quotes, empty without it: entities decoded, trimmed, escaped quotes plain, outer quotes off."""
    value = F.trim(tx.decode_entities(F.regexp_extract(F.coalesce(attributes, F.lit("")), rf'{name}="([^"]*)"', 1)))
    return F.regexp_replace(F.replace(value, F.lit('\\"'), F.lit('"')), r'^"|"$', "")


def cards(docs: DataFrame, key: str, html: str, names: list[str]) -> DataFrame:
    """``key``, ``ord`` and the attributes ``names`` of every card of a document, closed by itself or by a tag."""
    found = F.regexp_extract_all(repaired(F.col(html)), F.lit(CARD), F.lit(1))
    return docs.select(key, F.posexplode(found).alias("ord", "_a")).select(key, "ord", *[attribute(F.col("_a"), n).alias(n) for n in names])
