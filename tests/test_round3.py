"""What the third review found: times to the microsecond, crowded planes, large boards and tables, many small files."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from docloom.operators import flow, geometry, plane, trees, views
from docloom.plans import content_queries


def test_arc_lengths_count_microseconds(spark, tmp_path):
    """Truncation to milliseconds added up to the other side of a half."""
    start = dt.datetime(2024, 1, 1, 0, 0, 0, 999)
    rows = [(k, start + dt.timedelta(microseconds=us), 7) for k, us in enumerate((0, 499_001, 999_001, 1_499_900))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in content_queries.arc_length(spark, str(tmp_path)).collect()] == [(7, 1)]


def _crowd(spark, n):
    """n rows on 40 spots of one cell, n on 40 others: to try all pairs would be n * n."""
    spot = lambda seed: F.array(*[F.struct(F.lit(float(random.Random(seed * 99 + k).randrange(100))).alias("x"), F.lit(float(random.Random(seed * 77 + k).randrange(100))).alias("y")) for k in range(40)])
    make = lambda seed, name: spark.range(n).select(F.col("id").alias(name), spot(seed)[(F.col("id") % 40).cast("int")].alias("s"), F.lit(1).alias("board")).select("board", name, "s.*")
    return make(1, "pid"), make(2, "nid")


def _brute(points, nodes, k, metric):
    """By spots, each node spot with its k least ids."""
    ps, ns = ({(r.x, r.y): r.ids for r in df.groupBy("x", "y").agg(F.array_sort(F.collect_set(c)).alias("ids")).collect()} for df, c in ((points, "pid"), (nodes, "nid")))
    near = {p: sorted((metric(abs(p[0] - q[0]), abs(p[1] - q[1])), i) for q, ids in ns.items() for i in ids[:k])[:k] for p in ps}
    return {(pid, i, d) for p, ids in ps.items() for pid in ids for d, i in near[p]}


def test_nearest_on_crowded_spots(spark):
    points, nodes = _crowd(spark, 60_000)
    found = plane.nearest_within(points, nodes, ["board"], "pid", "nid", (240.0, 260.0), lambda dx, dy: 1.4 * dx + dy, "nid")
    assert {(r.pid, r.nid, round(r.distance, 6)) for r in found.collect()} == {(p, n, round(d, 6)) for p, n, d in _brute(points, nodes, 1, lambda dx, dy: 1.4 * dx + dy)}


def test_topk_nearby_on_crowded_spots(spark):
    points, nodes = _crowd(spark, 60_000)
    found = geometry.nearest(points, nodes, "pid", "nid", 220, k=4).collect()
    assert len(found) == 240_000 and {(r.pid, r.nid, r.d2) for r in found} == _brute(points, nodes, 4, lambda dx, dy: dx * dx + dy * dy)
    assert {r["rank"] for r in found} == {1, 2, 3, 4}


def test_nearest_node_on_crowded_spots(spark):
    points, nodes = _crowd(spark, 60_000)
    found = geometry.nearest(points, nodes, "pid", "nid", 160).collect()
    assert {(r.pid, r.nid, r.d2) for r in found} == _brute(points, nodes, 1, lambda dx, dy: dx * dx + dy * dy)


def _board(spark):
    line = {"id": "l", "type": "line", "source": {"id": "b"}, "target": {"id": "a"}}
    body = [{"id": "g", "type": "group", "zIndex": 2, "children": [{"id": "a", "type": "geometry", "html": "A"}, {"id": "b", "type": "geometry", "html": "B", "contain": [{"id": "c", "text": "C"}]}, line]}, {"id": "t", "type": "text", "html": "T"}]
    return spark.createDataFrame([(1, json.dumps(body)), (None, json.dumps(body))], "board long, body string")


def test_elements_are_kept_once_and_numbered_by_one_sort(spark, monkeypatch):
    """The lists below an element were kept beside it, and numbers came of walks joined over and over."""
    kept, keep = [], trees.written
    monkeypatch.setattr(trees, "written", lambda df: kept.append(df.columns) or keep(df))
    monkeypatch.setattr(trees, "toured", None)
    found = trees.nested(_board(spark), "board", F.col("body"))
    assert kept and not any("lists" in columns for columns in kept)
    numbers = {(r.board, r.path): r.number for r in trees.numbered(found, "board").collect()}
    paths = ["/0", "/0/children/0", "/0/children/1", "/0/children/1/contain/0", "/0/children/2", "/1"]
    assert numbers == {(b, p): k for b in (1, None) for k, p in enumerate(paths)}
    items = [(r.number, r.depth, r.text) for r in trees.text_items(found.where("board = 1"), "board").orderBy("number").collect()]
    assert items == [(0, 0, "T"), (2, 1, "A"), (3, 1, "B"), (4, 2, "C")]
    charts = [r.mermaid for r in flow.flowcharts(found.where("board = 1"), "board").collect()]
    assert len(charts) == 1 and charts[0].startswith("flowchart LR") and "-->" in charts[0]


def test_nodes_that_have_arrived_climb_no_more(spark, monkeypatch):
    sizes, keep = [], trees.written

    def counted(df):
        sizes.append((out := keep(df)).count())
        return out

    monkeypatch.setattr(trees, "written", counted)
    nodes = spark.range(1000).select(F.lit(1).alias("key"), F.col("id").alias("node"), F.when(F.col("id") > 0, 0).cast("long").alias("parent"))
    fit = trees.nearest_fit(nodes, "key", "node", "parent", (F.col("node") == 0) | (F.col("node") % 2 == 1)).collect()
    assert {r.node: r.fit for r in fit} == {k: k if k % 2 else 0 for k in range(1000)} and sizes == [1000, 499]


def test_tables_are_not_sent_to_the_driver(spark):
    rows = spark.range(50).select(F.col("id").alias("doc"), F.lit('{"sheet":[{"columns":[{"id":"k"}]}],"records":[{"uuid":"r","data":{"k":"v"}}]}').alias("content"))
    found = views.table_texts(rows, "doc", F.col("content"), F.lit("t"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert found.where("markdown like '%| v |%'").count() == 50
