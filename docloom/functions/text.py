"""Text functions over columns: escaping, HTML to text, path segments, dates and numbers."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that Windows reserves for devices. Fixed values.
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
MAX_SEGMENT = 120


def missing_as(column: Column, default: str) -> Column:
    """``default`` where a text is null or empty."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


def sanitize_ascii(column: Column) -> Column:
    """A path segment of a text without compatibility characters: built-in functions only."""
    steps = [
        (r"[\x00-\x1f\x7f​-‍﻿]", ""), (r'[\\/<>:"|?*]', "_"), (r"(?U)\s+", "_"), (r"_+", "_"),
        (r"[. ]+$", ""), (r"^\s+|\s+$", ""), (r"^\.+|\.+$", ""),
    ]
    out = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, column)
    out = F.when(out.rlike(RESERVED), F.concat(F.lit("_"), out)).otherwise(out)
    return F.regexp_replace(F.substring(out, 1, MAX_SEGMENT), r"[. ]+$", "")


#: White space that becomes an underscore, and what is dropped. Fixed values.
BLANKS = "[\\t\\n\\v\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
DROPPED = "[\\x00-\\x1f\\x7f\u200b-\u200d\ufeff]"


def _segment(name: str) -> str:
    """A path segment: compatibility forms are unified first, the length counts UTF-16 units."""
    out = re.sub(DROPPED, "", unicodedata.normalize("NFKC", name))
    out = re.sub("_+", "_", re.sub(BLANKS, "_", re.sub(r'[\\/<>:"|?*]', "_", out)))
    out = out.rstrip(". ").strip().strip(".")
    out = "_" + out if re.match(RESERVED, out) else out
    if len(out.encode("utf-16-le")) > 2 * MAX_SEGMENT:
        out = out.encode("utf-16-le")[: 2 * MAX_SEGMENT].decode("utf-16-le", "ignore").rstrip(". ")
    return out


@F.pandas_udf(T.StringType())
def sanitize_segment(names: pd.Series) -> pd.Series:
    """A path segment of any text."""
    return names.map(lambda name: None if name is None else _segment(name))


@F.pandas_udf(T.StringType())
def _sanitize_path(paths: pd.Series) -> pd.Series:
    return paths.map(lambda path: None if path is None else "/".join(filter(None, map(_segment, re.split(r"[\\/]+", path)))))


def segment(name: Column) -> Column:
    """A path segment of any text; only texts that aren't ASCII leave the JVM."""
    other = name.rlike(r"[^\x00-\x7F]")
    return F.when(other, sanitize_segment(F.when(other, name))).otherwise(sanitize_ascii(name))


def sanitize_segments(path: Column) -> Column:
    """Every segment of a path made safe, empty ones dropped; only paths that aren't ASCII leave the JVM."""
    other = path.rlike(r"[^\x00-\x7F]")
    plain = F.concat_ws("/", F.filter(F.transform(F.split(path, r"[\\/]+"), sanitize_ascii), lambda s: s != ""))
    return F.when(other, _sanitize_path(F.when(other, path))).otherwise(plain)


def escape_xml(column: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(column, F.lit("")))


#: Entities in the order in which they are decoded: the ampersand before the angle brackets. Fixed values.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def decode_entities(column: Column) -> Column:
    """The named entities above, then decimal and hexadecimal references."""
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ENTITIES, column)
    found = F.array_distinct(F.regexp_extract_all(out, F.lit(r"(&#(?:[0-9]{1,7}|x[0-9a-fA-F]{1,6});)"), F.lit(1)))

    def char(ref: Column) -> Column:
        number = F.regexp_extract(ref, r"&#x?([0-9a-fA-F]+);", 1)
        code = F.when(ref.contains("x"), F.conv(number, 16, 10)).otherwise(number)
        # UTF-32 bytes of the code point
        return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")

    return F.aggregate(found, out, lambda text, ref: F.replace(text, ref, char(ref)))


def html_to_text(column: Column) -> Column:
    """Line ends for breaks and block ends, no tags, decoded entities, no blanks at line ends."""
    out = F.regexp_replace(column, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|h[1-6]|tr)>", "\n")
    out = F.replace(F.regexp_replace(out, r"<[^>]*>", ""), F.lit("​"), F.lit(""))
    out = F.regexp_replace(decode_entities(out), r"[ \t]+\n", "\n")
    return F.regexp_replace(out, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def markdown_cell(column: Column) -> Column:
    """Text of a table cell: escaped bars, breaks for line ends."""
    return F.regexp_replace(F.replace(F.coalesce(column, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>")


def markdown_link(label: Column, url: Column) -> Column:
    """A link; the label alone where there is no url."""
    safe = F.replace(F.replace(F.replace(url, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")), F.lit(" "), F.lit("%20"))
    return F.when(F.coalesce(url, F.lit("")) == "", label).otherwise(F.concat(F.lit("["), F.replace(label, F.lit("]"), F.lit("\\]")), F.lit("]("), safe, F.lit(")")))


def markdown_image(alt: Column, url: Column) -> Column:
    safe = F.regexp_replace(F.replace(F.coalesce(alt, F.lit("")), F.lit("]"), F.lit("\\]")), r"\r?\n", " ")
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("!["), safe, F.lit("]("), url, F.lit(")")))


def markdown_math(tex: Column, block: Column) -> Column:
    inline = F.concat(F.lit("$"), F.regexp_replace(F.replace(tex, F.lit("$"), F.lit("\\$")), r"\s*\r?\n\s*", " "), F.lit("$"))
    return F.when(block, F.concat(F.lit("\n$$\n"), tex, F.lit("\n$$\n"))).otherwise(inline)


def cleanup_markdown(column: Column) -> Column:
    """Brackets unescaped unless a link follows, at most one blank line, no outer blanks."""
    out = F.regexp_replace(column, r"\\\[([^\[\]]*?)\\\](?!\()", "[$1]")
    out = F.regexp_replace(out, r"</details>\s*(?=\S)", "</details>\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def decode_payload(value: Column) -> Column:
    """JSON text of a ``data:`` value in percent encoding; a plus sign stays one; failures give ``{}``."""
    raw = F.regexp_replace(value, "^data:", "")
    text = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNotNull() & (text != "null"), text).otherwise(F.lit("{}"))


def number_text(column: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
    return F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))


def trim_decimal(column: Column) -> Column:
    """Decimal text without trailing zeros of its fraction."""
    return F.when(column.contains("."), F.regexp_replace(F.regexp_replace(column, "0+$", ""), r"\.$", "")).otherwise(column)


def round_half_up(column: Column, digits: int = 0) -> Column:
    """Halves go towards positive infinity."""
    return F.floor(column * 10**digits + 0.5) / 10**digits


def date_time_text(column: Column) -> Column:
    """Minutes of an ISO instant in the session's time zone; what is no instant stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(column), "yyyy-MM-dd HH:mm"), column)


def image_extension(url: Column) -> Column:
    """The first extension before a query or the end, if it is one of images; else png."""
    ext = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:\?|$)", 1))
    return F.when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "svg", "bmp"), ext).otherwise(F.lit("png"))


def strip_tags(column: Column) -> Column:
    """Text of a shape's HTML: no tags, four named entities decoded, other decimal references and zero-width spaces dropped."""
    out = F.regexp_replace(column, r"<[^>]+>", "")
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ENTITIES[:4], out)
    return F.regexp_replace(out, r"&#x200B;|&#\d+;|\x{200B}", "")


def accepted_types(message: Column) -> Column:
    """Formats that a refusal lists between its two fixed phrases; an empty array where it lists none."""
    listed = F.regexp_extract(F.coalesce(message, F.lit("")), r"要求是\s*(.+?)\s*其中", 1)
    return F.filter(F.transform(F.split(listed, r"[,，]\s*"), F.trim), lambda s: s != "")
