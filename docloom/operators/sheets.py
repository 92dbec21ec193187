"""Sparse sheets: dense grids, merged ranges and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense_grid(cells: DataFrame, key: str, row: str, col: str, value: str) -> DataFrame:
    """Every cell within a sheet's bounds, empty where none is given. One array a sheet row carries
    the columns, so no cell is joined with another."""
    bounds = cells.groupBy(key).agg(F.max(row).alias("_r"), F.max(col).alias("_c"))
    grid = bounds.select(key, F.explode(F.sequence(F.lit(0), F.col("_r").cast("int"))).alias(row), "_c").select(key, row, F.explode(F.sequence(F.lit(0), F.col("_c").cast("int"))).alias(col))
    return grid.join(cells, [key, row, col], "left").withColumn(value, F.coalesce(value, F.lit("")))


def row_texts(grid: DataFrame, key: str, row: str, col: str, value: Column, sep: str) -> DataFrame:
    """The rows of a grid, their cells joined in order."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(col), value.alias("v"))))
    return grid.groupBy(key, row).agg(F.array_join(F.transform(cells, lambda c: c["v"]), sep).alias("line"))


def sheet_text(lines: DataFrame, key: str, row: str, sep: str = "\n") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(row), F.col("line"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), sep).alias("text"))


def csv_cell(value: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line feed."""
    return F.when(value.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def markdown_cell(value: Column) -> Column:
    """Bars escaped, line feeds as spaces."""
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_lines(grid: DataFrame, key: str, row: str, col: str, value: str) -> DataFrame:
    """The rows of a grid as lines of a Markdown table; the line of row 0 carries the separator below it."""
    lines = row_texts(grid, key, row, col, markdown_cell(F.col(value)), " | ").withColumn("line", F.concat(F.lit("| "), "line", F.lit(" |")))
    columns = grid.groupBy(key).agg((F.max(col) + 1).cast("int").alias("_columns"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("_columns")), " | "), F.lit(" |"))
    return lines.join(columns, key).withColumn("line", F.concat("line", F.when(F.col(row) == 0, rule).otherwise(""))).drop("_columns")


def joined_sheets(texts: DataFrame, doc: str, name: Column, order: str, before: str, after: str) -> DataFrame:
    """The sheets of a document under their names, blank lines between; a single sheet stands without its name."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), name.alias("name"), F.col("text"))))
    named = F.array_join(F.transform(parts, lambda p: F.concat(F.lit(before), p["name"], F.lit(after), p["text"])), "\n\n")
    return texts.groupBy(doc).agg(F.when(F.count("*") == 1, F.first("text")).otherwise(named).alias("text"))


def covered_cells(cells: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """Cells outside merged ranges, or at their anchor, which gets the spans.

    merges: key, row, col, row_count, col_count. A range is spread over its cells, which are as many
    as it covers, and met by equality."""
    spread = merges.select(key, F.col("row").alias("_ar"), F.col("col").alias("_ac"), "row_count", "col_count", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_count") - 1)).alias("r"))
    spread = spread.select("*", F.explode(F.sequence(F.col("_ac"), F.col("_ac") + F.col("col_count") - 1)).alias("c"))
    out = cells.join(spread, [key, "r", "c"], "left")
    anchor = (F.col("r") == F.col("_ar")) & (F.col("c") == F.col("_ac"))
    return out.where(F.col("_ar").isNull() | anchor).withColumns({"row_span": F.coalesce("row_count", F.lit(1)), "col_span": F.coalesce("col_count", F.lit(1))}).drop("_ar", "_ac", "row_count", "col_count")
