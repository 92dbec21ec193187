"""XLSX workbooks: Spark writes the sheets' markup, a small function zips it.

cells: sheet, r, c (from 0), v; a cell is a number where its text is one. One workbook a sheet.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx
from docloom.operators import sheets

#: Parts of a package besides its sheet, and their texts. Fixed values of the format.
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
}


def column_name(c: Column) -> Column:
    """Letters of a column counted from 0, up to three of them."""
    letter = lambda n: F.chr(n.cast("long") + 65)
    two, three = F.floor(c / 26) - 1, F.floor((F.floor(c / 26) - 1) / 26) - 1
    return F.concat(F.when(c >= 702, letter(three)).otherwise(""), F.when(c >= 26, letter(F.pmod(two, F.lit(26)))).otherwise(""), letter(c % 26))


def cell_markup(r: Column, c: Column, v: Column) -> Column:
    """Markup of one cell; empty cells have none."""
    ref = F.concat(column_name(c), (r + 1).cast("string"))
    number = F.concat(F.lit('<c r="'), ref, F.lit('"><v>'), v, F.lit("</v></c>"))
    words = F.concat(F.lit('<c r="'), ref, F.lit('" t="inlineStr"><is><t xml:space="preserve">'), tx.escape_xml(F.regexp_replace(v, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")), F.lit("</t></is></c>"))
    return F.when(F.coalesce(v, F.lit("")) == "", F.lit("")).when(v.rlike(r"^-?(0|[1-9][0-9]{0,14})(\.[0-9]{1,15})?$"), number).otherwise(words)


def workbooks(cells: DataFrame, key: str, merges: DataFrame | None = None) -> DataFrame:
    """``content``: the bytes of each sheet's workbook.

    merges: key, row, col, row_count, col_count; ranges are cut off at the sheet's bounds and those
    that begin below it are left out."""
    rows = sheets.row_texts(cells, key, "r", "c", cell_markup(F.col("r"), F.col("c"), F.col("v")), "")
    rows = rows.withColumn("line", F.concat(F.lit('<row r="'), (F.col("r") + 1).cast("string"), F.lit('">'), "line", F.lit("</row>")))
    made = sheets.sheet_text(rows, key, "r", "").withColumn("ranges", F.lit(""))
    if merges is not None:
        bounds = cells.groupBy(key).agg(F.max("r").alias("_r"), F.max("c").alias("_c"))
        inside = merges.join(bounds, key).where(F.col("row") <= F.col("_r"))
        last = lambda at, n, most: F.least(F.col(at) + F.col(n) - 1, F.col(most))
        span = F.concat(column_name(F.col("col")), (F.col("row") + 1).cast("string"), F.lit(":"), column_name(last("col", "col_count", "_c")), (last("row", "row_count", "_r") + 1).cast("string"))
        listed = inside.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row", "col", span.alias("s")))).alias("_m"))
        tags = F.array_join(F.transform("_m", lambda m: F.concat(F.lit('<mergeCell ref="'), m["s"], F.lit('"/>'))), "")
        made = made.drop("ranges").join(listed, key, "left").withColumn("ranges", F.coalesce(F.concat(F.lit("<mergeCells>"), tags, F.lit("</mergeCells>")), F.lit("")))
    return made.select(key, zipped(F.concat(F.lit("<sheetData>"), "text", F.lit("</sheetData>"), "ranges")).alias("content"))


@F.pandas_udf(T.BinaryType())
def zipped(bodies: pd.Series) -> pd.Series:
    """The package around a sheet's markup. Times are fixed, so equal sheets give equal bytes."""

    def package(body: str | None) -> bytes | None:
        if body is None:
            return None
        out = io.BytesIO()
        parts = _PARTS | {"xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}">{body}</worksheet>'}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in parts.items():
                entry = zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
                entry.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(entry, _HEAD + text)
        return out.getvalue()

    return bodies.map(package)


@F.pandas_udf(T.StringType())
def sheet_markup(contents: pd.Series) -> pd.Series:
    """The markup of a workbook's first sheet, read from its bytes; null for null."""
    name = "xl/worksheets/sheet1.xml"
    return contents.map(lambda b: None if b is None else zipfile.ZipFile(io.BytesIO(b)).read(name).decode())
