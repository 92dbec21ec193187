"""Cases that queries over the driver's tables don't reach: order numbers of many rows, deep trees, cycles, reports, logs."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import files, jobs, listing, sheets, tables


@pytest.mark.parametrize("partitions,adaptive", [(4, "true"), (64, "true"), (64, "false")])
def test_ordinals_number_every_row_once(spark, partitions, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 400_000
        rows = spark.range(n).withColumn("key", F.xxhash64("id")).withColumn("wide", F.repeat(F.sha2(F.col("id").cast("string"), 256), 6))
        got = tables.ordinals(rows, [F.desc("key"), F.col("id")], "pos").agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.sum(F.length("wide"))).first()
        assert tuple(got) == (n, n, 1, n, n * 384)
        small = tables.ordinals(rows.where("id < 3000"), [F.desc("key"), F.col("id")], "pos").orderBy("pos").select("key").collect()
        assert [r["key"] for r in small] == sorted((r["key"] for r in small), reverse=True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_deep_trees_and_cycles(spark):
    depth = 300
    rows = [(f"n{k}", f"n{k - 1}" if k else None, "TITLE", f"t{k}", k, None) for k in range(depth)]
    rows += [("a", "b", "TITLE", "A", 1, None), ("b", "a", "TITLE", "B", 2, None), ("c", "a", "DOC", "C", 3, 30)]
    rows += [("x", "gone", "TITLE", "X", 4, None), ("y", "x", "TITLE", "a/b: c", 5, None), ("z", "y", "OTHER", "no folder", 6, None), ("d", "z", "DOC", "D", 7, 7), ("e", "e0", "DOC", "E", 8, 7), ("e0", None, "TITLE", "...", 9, None)]
    toc = spark.createDataFrame(rows, "uuid string, parent_uuid string, type string, title string, ord long, doc_id long")
    paths = listing.toc_paths(toc)
    got = {r["uuid"]: r["path"] for r in paths.collect()}
    assert all(got[f"n{k}"] == "/".join(f"t{i}" for i in range(k)) for k in range(depth))
    assert [got[u] for u in ("a", "b", "c", "x", "y", "z", "d", "e")] == ["", "", "", "", "X", "X/a_b_c", "X/a_b_c", ""]
    assert {tuple(r) for r in listing.doc_paths(toc, paths).collect()} == {(30, ""), (7, "")}


def test_reports_are_held_against_the_last_one_sent(spark):
    rows = spark.createDataFrame([("k", t, "v") for t in (0, 400, 800, 900, 1300)] + [("k", 1350, "w"), ("k", 1400, "v"), ("j", 10, "v"), ("j", 509, "v"), ("j", 510, "v")], "key string, ms long, value string")
    got = jobs.throttled(rows, "key", F.col("ms"), "value", ["ms"]).collect()
    assert sorted((r["key"], r["ms"]) for r in got) == [("j", 10), ("j", 510), ("k", 0), ("k", 800), ("k", 1300), ("k", 1350), ("k", 1400)]


def test_log_lines(spark):
    lines = ["导出成功 Error", "失败", "跳过", "plain", "[1] 文档类型: x", " 使用本地 y", "  ", "[1] 官方导出失败，自动切换"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string")
    got = rows.orderBy("k").select(jobs.log_level(F.col("x")), jobs.shown_log(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("success", True), ("error", True), ("warn", True), ("", True), ("", False), ("", False), ("", False), ("error", False)]


def test_sheet_texts(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a|b"), (1, 0, 1, "c\nd"), (1, 1, 1, "e")], "s int, r int, c int, v string")
    grid = sheets.dense_grid(cells, "s", "r", "c", "v")
    text = sheets.sheet_text(sheets.markdown_lines(grid, "s", "r", "c", "v"), "s", "r").first()["text"]
    assert text == "| a\\|b | c d |\n| --- | --- |\n|  | e |"
    assert spark.range(1).select(sheets.csv_cell(F.lit("a\rb")), sheets.csv_cell(F.lit('a"\n'))).first()[:] == ("a\rb", '"a""\n"')


def test_small_texts(spark):
    texts = spark.createDataFrame([(None,), (0,), (999,), (1125,), (1005,), (159315,)], "ms long").select(files.duration_text(F.col("ms"))).collect()
    assert [r[0] for r in texts] == ["-", "-", "999 ms", "1.13 s", "1.00 s", "159.31 s"]
    ids = spark.createDataFrame([(None,), ("",), ("--a b--",), ("é",), ("x" * 90,)], "v string").select(files.svg_id(F.col("v"))).collect()
    assert [r[0] for r in ids] == ["x", "x", "a-b", "x", "x" * 80]
