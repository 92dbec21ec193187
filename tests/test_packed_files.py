"""Very many small files: packed they take no block each, and read back as files of their own do."""

import os
import zipfile

import pytest
from docloom.sources import filetree


def on_disk(folder) -> list[str]:
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")]


def test_packed_files(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    rows = [(f"文/{k % 7}/a {k}.md", f"é {k}" if k % 9 else None) for k in range(1200)]
    df = spark.createDataFrame(rows, "path string, content string").repartition(3)
    for _ in range(2):  # a job that runs again leaves one copy
        filetree.write_files(df, folder, packed=True)
        found = filetree.read_files(spark, folder).collect()
        assert sorted((r.path, bytes(r.content).decode()) for r in found) == sorted((p, c or "") for p, c in rows)
    single = str(tmp_path / "single")
    filetree.write_files(df, single)
    columns = ["path", "n_bytes", "sha256"]
    one, other = (sorted(map(tuple, filetree.read_files(spark, f, content=False).select(*columns).collect())) for f in (folder, single))
    assert one == other
    files = on_disk(folder)
    assert len(files) <= 16 and sum(os.stat(f).st_blocks * 512 for f in files) < 1200 * 512
    names = [n for f in files if f.endswith(".zip") for n in zipfile.ZipFile(f).namelist()]
    assert {*names} == {p for p, _ in rows}
    filetree.write_files(spark.createDataFrame([("b.bin", b"\x00\xff")], "path string, content binary"), folder, append=True)
    assert filetree.read_files(spark, folder, content=False).count() == 1201
    with pytest.raises(Exception, match="not a relative path"):
        filetree.write_files(spark.createDataFrame([("_packs/x.zip", "x")], "path string, content string"), folder, packed=True)


def test_packs_are_closed_when_full(tmp_path, monkeypatch):
    monkeypatch.setattr(filetree, "PACK", (10, 500))
    writer = filetree.TreeWriter({"path": str(tmp_path), "packed": "true"}, ["path", "content"], True)
    rows = [(f"{k}.md", "x" * (600 if k == 30 else 2)) for k in range(35)]
    writer.commit([writer.write(iter(rows)), writer.write(iter([]))])
    reader = filetree.TreeReader({"path": str(tmp_path)}, ["path", "n_bytes", "content"])
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(p, len(c), c.encode()) for p, c in rows]
    assert len([f for f in on_disk(tmp_path) if f.endswith(".zip")]) >= 5
