"""Edge cases of the operators on small tables."""

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import catalog, html, listing, sheets


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_paths_skip_blank_titles_and_survive_cycles(spark):
    toc = spark.createDataFrame(
        [("a", None, "TITLE", "A", 0), ("b", "a", "TITLE", " ", 1), ("c", "b", "DOC", "C", 2), ("d", "gone", "DOC", "D", 3), ("x", "y", "TITLE", "X", 4), ("y", "x", "TITLE", "Y", 5), ("z", "c", "DOC", "Z", 6)],
        "uuid string, parent_uuid string, type string, title string, ord int",
    )
    assert {r["uuid"]: r["path"] for r in listing.toc_paths(toc).collect()} == {"a": "", "b": "A", "c": "A/_", "d": "", "x": "", "y": "", "z": "A/_/C"}


def test_first_wins_takes_the_first_source(spark):
    a = spark.createDataFrame([(1, "p")], "id int, name string")
    b = spark.createDataFrame([(1, "q", 5), (2, "r", 6)], "id int, name string, extra int")
    got = catalog.first_wins(catalog.union_sources([a, b]), ["id"], [F.col("source_rank"), F.col("name")])
    assert sorted((r["id"], r["name"]) for r in got.collect()) == [(1, "p"), (2, "r")]


def test_text_functions(spark):
    assert one(spark, tx.sanitize_ascii(F.lit("a/b: c?x.. "))) == "a_b_c_x.._"
    assert one(spark, tx.sanitize_ascii(F.lit("con.txt"))) == "_con.txt"
    assert one(spark, tx.decode_entities(F.lit("&amp;lt; &#65;&#x42;"))) == "< AB"
    assert one(spark, tx.decode_payload(F.lit("data:%7B%22a%22%3A%22b+c%22%7D"))) == '{"a":"b+c"}'
    assert one(spark, tx.decode_payload(F.lit("data:nope"))) == "{}"
    assert one(spark, tx.number_text(F.lit(100.0))) == "100"
    assert one(spark, tx.trim_decimal(F.lit("1.500"))) == "1.5"
    assert one(spark, tx.cleanup_markdown(F.lit("\\[x\\] y\n\n\n\nz"))) == "[x] y\n\nz"
    assert one(spark, tx.sanitize_segment(F.lit("Ｃ：x"))) == "C_x"


def test_markdown():
    assert html.markdown("<h1>T</h1><p>a <b>b</b></p><ul><li>x<li>y</ul>") == "# T\n\na **b**\n\n- x\n- y"
    assert html.markdown("<table><tr><th>a</th></tr><tr><td>1|2</td></tr></table>") == "| a |\n| --- |\n| 1\\|2 |"
    assert html.markdown(None) == ""


def test_merged_cells(spark):
    cells = spark.createDataFrame([(1, r, c, f"{r}{c}") for r in range(3) for c in range(3)], "k int, r int, c int, v string")
    merges = spark.createDataFrame([(1, 0, 0, 2, 2)], "k int, row int, col int, row_count int, col_count int")
    got = {(x["r"], x["c"]): (x["row_span"], x["col_span"]) for x in sheets.covered_cells(cells, merges, "k").collect()}
    assert got[0, 0] == (2, 2) and (1, 1) not in got and got[2, 2] == (1, 1)


def test_segments_of_any_text(spark):
    """Compatibility forms are unified before anything else, for folders, files and paths alike."""
    cases = {"问：答？（一）": "问_答_(一)", "Ｃｏｎ．txt": "_Con.txt", "a\u200bb\u0085c": "ab\u0085c", "　x　": "_x_", "．．é": "é", "①②": "12", "ﬁn": "fin", "字" * 130: "字" * 120, "😀" * 61: "😀" * 60, "": "", "plain: x": "plain_x"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", tx.segment(F.col("t")).alias("s")).collect()} == cases
    assert one(spark, tx.sanitize_segments(F.lit("卷：1//附／录/\\ＡＢ"))) == "卷_1/附_录/AB"
    assert one(spark, tx.segment(F.lit(None).cast("string"))) is None
