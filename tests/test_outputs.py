"""Files written and read back: reruns, failures, collisions, refused paths; collated and natural orders."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import collated
from docloom.sources import filetree


def tree(folder) -> set[str]:
    return {os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")}


def test_round_trip_rerun_and_append(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"文/{k % 7}/a {k}.md", f"é {k}" * (k % 50) if k % 9 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "path string, content string").repartition(6)
    for _ in range(2):  # a job that runs again leaves one copy
        filetree.write_files(df, folder)
        found = filetree.read_files(spark, folder).collect()
        assert sorted((r.path, bytes(r.content).decode()) for r in found) == sorted((p, c or "") for p, c in rows)
        assert all(r.n_bytes == len(r.content) for r in found)
    assert len([p for p in tree(folder) if not p.startswith("_")]) == 300
    more = spark.createDataFrame([("b.bin", b"\x00\xff")], "path string, content binary")
    filetree.write_files(more, folder, append=True)
    assert filetree.read_files(spark, folder, content=False).count() == 301
    filetree.write_files(more, folder)
    assert [tuple(r)[:2] for r in filetree.read_files(spark, folder, content=False).collect()] == [("b.bin", 2)]
    filetree.write_files(more.limit(0), folder)
    assert filetree.read_files(spark, folder).collect() == []


def test_a_task_that_runs_twice(tmp_path):
    """Two attempts of one task: files are there once, and only the attempt that the driver commits is listed."""
    folder = str(tmp_path)
    writer = filetree.TreeWriter({"path": folder}, ["path", "content"], True)
    rows = [("x/1.md", "one"), ("x/2.md", "two")]
    lost, kept = writer.write(iter(rows[:1])), writer.write(iter(rows))
    writer.commit([kept, None])
    reader = filetree.TreeReader({"path": folder}, ["path", "n_bytes", "content"])
    assert sorted(r for p in reader.partitions() for r in reader.read(p)) == [("x/1.md", 3, b"one"), ("x/2.md", 3, b"two")]
    assert {p for p in tree(folder) if not p.startswith("_")} == {"x/1.md", "x/2.md"} and lost.part != kept.part


def test_a_failed_job_leaves_the_manifest(spark, tmp_path):
    folder = str(tmp_path / "out")
    good = spark.createDataFrame([("a.md", "a")], "path string, content string")
    filetree.write_files(good, folder)
    for path in ("../up.md", "/abs.md", "a//b", "", None, "_manifest/current.json", "a\\b"):
        with pytest.raises(Exception, match="not a relative path"):
            filetree.write_files(spark.createDataFrame([("new.md", "n"), (path, "x")], "path string, content string").coalesce(1), folder)
    assert [r.path for r in filetree.read_files(spark, folder).collect()] == ["a.md"]
    assert filetree.read_files(spark, str(tmp_path / "none")).collect() == []


def test_unique_paths(spark):
    rows = [(k, p) for k, p in enumerate(["a.md", "a.md", "a (1).md", "a.md", "d.x/a", "d.x/a", "", "a (1).md", "z.tar.gz", "z.tar.gz"])] + [(100 + k, "hot") for k in range(500)]
    found = {r.id: r.path for r in filetree.with_unique_paths(spark.createDataFrame(rows, "id long, path string").repartition(5), "id").collect()}
    assert len(set(found.values())) == len(rows)
    assert (found[0], found[2], found[4], found[5], found[9]) == ("a.md", "a (1).md", "d.x/a", "d.x/a (1)", "z.tar (1).gz")
    assert found[100] == "hot" and {found[101], found[599]} == {"hot (1)", "hot (499)"}


def test_natural_order(spark):
    titles = ["图10", "图9", "图9.0", "图9.10", "图9.2", "b", "a", "B", "阿", "张", "图", "", None, "x 0", "图1e5", "9" * 400]
    rows = [("k", k, t) for k, t in enumerate(titles)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, id int, title string")
    found = collated.ranked(df, "key", [*collated.natural(F.col("title")), F.col("id")]).orderBy("place")
    assert [r.title for r in found.collect()] == ["", None, "阿", "图", "张", "a", "b", "B", "x 0", "图1e5", "图9", "图9.0", "图9.2", "图9.10", "图10", "9" * 400]


def test_file_tree(spark):
    rows = [(1, "b", "z"), (2, "b", "a"), (3, "b/文", "x"), (4, None, "m"), (5, "", "阿"), (6, "a//c", "q"), (7, "a/c", "q"), (8, "m", None)]
    found = collated.file_tree(spark.createDataFrame(rows, "id long, path string, title string"), "id", "path", "title").orderBy("number").collect()
    assert [(r.depth, r.name, r.id, r.n_files) for r in found] == [
        (0, "a", None, 2), (1, "c", None, 2), (2, "q", 6, 1), (2, "q", 7, 1), (0, "b", None, 3), (1, "文", None, 1), (2, "x", 3, 1), (1, "a", 2, 1), (1, "z", 1, 1),
        (0, "m", None, 1), (1, "", 8, 1), (0, "阿", 5, 1), (0, "m", 4, 1),
    ]
