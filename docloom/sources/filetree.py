"""A sink of one file a row at the path that the row names, with a manifest; and the source that reads it back.

    filetree.write_files(rows, folder)       # columns path and content (string or binary)
    filetree.write_files(rows, folder, packed=True)  # the same files in ZIP archives of many
    filetree.read_files(spark, folder)       # path, n_bytes, sha256 and content

Tasks write each file beside its place and put it there in one step, so a file is whole or not there, and a task that runs again puts the
same files in the same places. What a task wrote it lists in a part of the manifest of its own; the driver, once all tasks are done, names
the parts that count in one step and touches no file itself. A failed job leaves the manifest as it was. Readers see what the manifest
lists and nothing else; a later write into the folder replaces the manifest, or adds to it in append mode.

A file of its own takes a block of the disk and an entry of its folder, however small it is. For very many small files ``packed`` puts them, each
under its path, into archives of up to ``PACK`` files or bytes; the manifest then lists archives, whose own directories name the files.

Paths are relative, with ``/`` between segments; empty segments, ``.``, ``..`` and absolute paths are refused. A null content is an empty file. Paths must
be unique: :func:`with_unique_paths` numbers what collides.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from docloom.checkpoints import written
from docloom.operators import sequences

#: The folder of the manifest and the file that names its parts.
MANIFEST, CURRENT, PARTIAL = "_manifest", "current.json", "_partial"
#: The folder of archives; the files and the bytes at which one is closed.
PACKS, PACK = "_packs", (20_000, 8_000_000)


def checked(path: str | None) -> str:
    """The path, if it stays below the folder and out of the manifest."""
    parts = (path or "").split("/")
    if any(p in ("", ".", "..") or "\x00" in p or "\\" in p for p in parts) or parts[0] in (MANIFEST, PARTIAL, PACKS):
        raise ValueError(f"not a relative path of a file: {path!r}")
    return "/".join(parts)


def _put(fs: pafs.FileSystem, root: str, path: str, data: bytes) -> None:
    """Writes beside the place, then moves there: a whole file or none."""
    draft = f"{root}/{PARTIAL}/{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as out:
        out.write(data)
    folder = f"{root}/{path}".rsplit("/", 1)[0]
    fs.create_dir(folder, recursive=True)
    fs.move(draft, f"{root}/{path}")


class Packs:
    """Archives of many files, each put in its place when it is full; ``listed`` takes a line for each."""

    def __init__(self, fs: pafs.FileSystem, root: str, listed):
        self.fs, self.root, self.listed = fs, root, listed
        self._start()

    def _start(self) -> None:
        self.raw, self.count = io.BytesIO(), 0
        self.zip = zipfile.ZipFile(self.raw, "w")

    def add(self, path: str, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(path), data)
        self.count += 1
        if self.count >= PACK[0] or self.raw.tell() >= PACK[1]:
            self.close()

    def close(self) -> None:
        self.zip.close()
        if self.count:
            place = f"{PACKS}/{uuid.uuid4().hex}.zip"
            _put(self.fs, self.root, place, self.raw.getvalue())
            self.listed.write(json.dumps({"archive": place}).encode() + b"\n")
        self._start()


def _unpacked(raw: bytes, names: list[str]) -> Iterator[dict]:
    """The files of an archive; contents are read only where they or their digests are asked for."""
    with zipfile.ZipFile(io.BytesIO(raw)) as found:
        for info in found.infolist():
            data = found.read(info) if {"content", "sha256"} & {*names} else b""
            yield {"path": info.filename, "n_bytes": info.file_size, "content": data, "sha256": hashlib.sha256(data).hexdigest() if "sha256" in names else None}


@dataclass
class Wrote(WriterCommitMessage):
    part: str
    n_files: int


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], names, overwrite
        self.packed = str(options.get("packed", "false")).lower() == "true"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/{PARTIAL}", recursive=True)
        fs.create_dir(f"{root}/{MANIFEST}", recursive=True)
        part, count = f"part-{uuid.uuid4().hex}.jsonl", 0
        with fs.open_output_stream(f"{root}/{MANIFEST}/{part}", compression=None) as listed:
            packs = Packs(fs, root, listed) if self.packed else None
            for row in rows:
                values = dict(zip(self.names, row))
                path, content = checked(values["path"]), values["content"]
                data = content.encode() if isinstance(content, str) else bytes(content or b"")
                count += 1
                if packs:
                    packs.add(path, data)
                    continue
                _put(fs, root, path, data)
                listed.write(json.dumps({"path": path, "n_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}, ensure_ascii=False).encode() + b"\n")
            if packs:
                packs.close()
        return Wrote(part, count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        parts = [m.part for m in messages if m and m.n_files]  # a name for each task
        before = [] if self.overwrite else _parts(fs, root)
        fs.create_dir(f"{root}/{PARTIAL}", recursive=True)
        _put(fs, root, f"{MANIFEST}/{CURRENT}", json.dumps({"parts": before + parts}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """The manifest stays as it was; files that no manifest lists are not read."""


def _parts(fs: pafs.FileSystem, root: str) -> list[str]:
    place = f"{root}/{MANIFEST}/{CURRENT}"
    if fs.get_file_info(place).type != pafs.FileType.File:
        return []
    with fs.open_input_stream(place) as f:
        return json.loads(f.read())["parts"]


class Part(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class TreeReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"], names

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        return [Part(p) for p in _parts(fs, root)] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.name:
            return
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}/{partition.name}", buffer_size=1 << 16) as listed:
            rest = b""
            while block := listed.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    entry = json.loads(line)
                    if "archive" in entry:
                        with fs.open_input_stream(f"{root}/{entry['archive']}", compression=None) as f:
                            raw = f.read()
                        yield from (tuple(file[n] for n in self.names) for file in _unpacked(raw, self.names))
                        continue
                    if "content" in self.names:
                        with fs.open_input_stream(f"{root}/{entry['path']}", compression=None) as f:
                            entry["content"] = f.read()
                    yield tuple(entry[n] for n in self.names)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, n_bytes long, sha256 string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options, schema.names, overwrite)


def write_files(rows: DataFrame, folder: str, append: bool = False, packed: bool = False) -> None:
    """Writes a file for each row (path, content), ``packed`` into archives; the folder's manifest lists these, in ``append`` mode also those before."""
    rows.sparkSession.dataSource.register(FileTree)
    rows.select("path", "content").write.format("filetree").option("packed", str(packed).lower()).mode("append" if append else "overwrite").save(folder)


def read_files(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """The files that the manifest lists; without ``content`` no file of its own is opened."""
    spark.dataSource.register(FileTree)
    schema = "path string, n_bytes long, sha256 string" + ", content binary" * content
    return spark.read.format("filetree").schema(schema).load(folder)


def with_unique_paths(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with a ``path`` of their own: of equal ones the first in ``order`` (unique) keeps it, the k-th later one gets `` (k)`` before its extension.

    What a number makes may be another row's path, so rounds go on until nothing collides; a row that was there by its own name keeps it. A path
    that a third of all rows share is numbered over ranges."""
    rows = rows.withColumns({"_base": F.col("path"), "_k": F.lit(0).cast("long")})
    while True:
        placed = sequences.places(sequences.dealt(rows, ["path", "_k", order]), "path", "_place")
        rows = written(placed.drop("_part", "_id"))
        if rows.where("_place > 1").isEmpty():
            return rows.drop("_base", "_k", "_place")
        again = F.col("_place") > 1
        k = F.when(again, F.col("_k") + F.col("_place") - 1).otherwise(F.col("_k"))
        name, ext = F.regexp_extract("_base", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("_base", r"^(.*?)(\.[^./]*)?$", 2)
        made = F.when(again, F.concat(name, F.lit(" ("), k.cast("string"), F.lit(")"), ext)).otherwise(F.col("path"))
        rows = rows.select(*[c for c in rows.columns if c not in ("path", "_k", "_place")], made.alias("path"), k.alias("_k"))
