"""Diagram texts from tables: rule cascades, flowcharts, sequences, timelines, mind maps and radars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """Name of the first rule that holds."""
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(default))


def lines(rows: DataFrame, keys: list[str], order: list[str], line: Column, name: str = "body") -> DataFrame:
    """Lines of each key, joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], line.alias("_line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["_line"]), "\n").alias(name))


def flow_edges(events: DataFrame, key: str, node: str, order: list[str]) -> DataFrame:
    """Transitions between successive nodes of a key, counted, with their line of a flowchart; none from a node to itself."""
    after = F.lead(node).over(Window.partitionBy(key).orderBy(*order))
    counts = events.select(F.col(node).alias("source"), after.alias("target")).where("target <> source").groupBy("source", "target").agg(F.count("*").alias("n"))
    return counts.withColumn("line", F.concat("source", F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), "target"))


def flowchart(edges: DataFrame) -> DataFrame:
    body = lines(edges, [], ["source", "target"], F.concat(F.lit("  "), "line"))
    return body.select(F.concat(F.lit("flowchart TD\n"), "body").alias("text"))


def sequence(messages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A sequence diagram of each key's messages (source, target, message)."""
    body = lines(messages, [key], order, F.concat(F.lit("  "), "source", F.lit("->>"), "target", F.lit(": "), "message"))
    return body.select(key, F.concat(F.lit("sequenceDiagram\n"), "body").alias("text"))


def timeline(rows: DataFrame) -> DataFrame:
    body = lines(rows, ["section"], ["item"], F.col("item"))
    return body.select("section", F.concat(F.lit("section "), "section", F.lit("\n"), "body").alias("text"))


def mindmap(rows: DataFrame) -> DataFrame:
    body = lines(rows, ["root"], ["item"], F.concat(F.lit("    "), "item"))
    return body.select("root", F.concat(F.lit("mindmap\n  "), "root", F.lit("\n"), "body").alias("text"))


def radar(rows: DataFrame, key: str, axis: str, value: str) -> DataFrame:
    """Each key's values on its axes, in fiftieths of its largest."""
    most = rows.groupBy(key).agg(F.max(value).alias("_most"))
    scaled = rows.join(most, key).withColumn("_v", F.floor(F.col(value) * 50.0 / F.col("_most") + 0.5).cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct(axis, "_v")))
    return scaled.groupBy(key).agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda r: r["_v"]), ","), F.lit("]")).alias("radar"))
