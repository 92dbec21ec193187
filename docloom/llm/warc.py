"""WARC archives as a PySpark data source (operator 5).

``spark.read.format("warc")`` plans one partition a file (the writer bounds a file's size), takes
predicates on the record type and other header fields, parses a record's headers first and skips
the payload of records that the predicates reject, or of all when the requested schema has no
``payload``. Compressed archives hold one gzip member a record, whose ``sl`` extra field gives the
member's length, so that a skipped record is not inflated beyond its headers.

Tasks of the writer fill temporary files that the driver moves into place when all have ended, so
a task may run again elsewhere. Paths are those of pyarrow's file systems (local, HDFS, S3, GCS).

Defined results: an empty archive folder has no records; null fields are left out of the headers; a
null payload is an empty one; line ends within header values become spaces.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from io import BufferedReader

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, content_type string, refers_to string, "
    "payload_digest string, payload_bytes long, headers map<string,string>, payload binary, file string, offset long"
)
#: Header of each column that a predicate can be pushed down on.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "content_type": "Content-Type", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1, from five hexadecimal digits (20 bits, 4 base32 digits) at a time."""
    hexes = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def member(record: bytes, level: int) -> bytes:
    """A gzip member with its own and the record's length in an ``sl`` extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """A WARC/1.1 record: a response with its HTTP message, or a revisit with the HTTP headers only."""
    payload = bytes(row.get("payload") or b"")
    size = row.get("payload_bytes")
    size = len(payload) if size is None else size
    revisit = row["record_type"] == "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    fields = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row.get("warc_date"), "WARC-Target-URI": row.get("target_uri"),
        "WARC-Payload-Digest": row.get("payload_digest"), "WARC-Refers-To": row.get("refers_to"), "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    fields |= {k: v for k, v in (row.get("headers") or {}).items() if k not in fields}
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class WarcFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], names, overwrite
        self.level, self.compress = int(options.get("level", 1)), options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("fileBytes", 128 << 20))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        files, out, size = [], None, 0
        try:
            for row in rows:
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.compress
                    files.append((f"{root}/_temporary/{name}", f"{root}/{name}"))
                    out, size = fs.open_output_stream(files[-1][0], compression=None), 0
                data = record_bytes(dict(zip(self.names, row)))
                data = member(data, self.level) if self.compress else data
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for f in _archives(fs, root):
                fs.delete_file(f)
        for message in messages:
            for source, target in message.files if message else ():
                fs.move(source, target)
        self.abort([])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary")


def _archives(fs: pafs.FileSystem, root: str) -> list[str]:
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [root]
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"], names
        self.wanted: list[tuple[str, tuple]] = []  # header and the values it may have; none: any value

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            header = HEADERS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if header and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.wanted.append((header, (f.value,)))
            elif header and isinstance(f, In):
                self.wanted.append((header, tuple(f.value)))
            elif header and isinstance(f, IsNotNull):
                self.wanted.append((header, ()))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        return [WarcFile(p) for p in _archives(fs, root)]

    def read(self, partition: WarcFile | None) -> Iterator[tuple]:
        if partition is None:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as f:
            file = BufferedReader(f, 1 << 20)
            for offset, headers, content in (_members if partition.path.endswith(".gz") else _plain)(file):
                if all((v := headers.get(h)) is not None and (not values or v in values) for h, values in self.wanted):
                    yield self._row(partition.path, offset, headers, content)
                # else the caller goes on to the next record; nothing of the payload was decoded

    def _row(self, path: str, offset: int, headers: dict[str, str], content: _Content) -> tuple:
        http = headers.get("Content-Type", "").startswith("application/http")
        size = int(headers.get("Content-Length", 0))
        payload = None
        if http:
            head = content.http_head()
            given = next((int(v) for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")) if k.lower() == "content-length"), None)
            size = given if given is not None else size - len(head)
        if "payload" in self.names:
            payload = content.rest() if headers.get("WARC-Type") != "revisit" else None
        known = {k: headers.get(h) for k, h in HEADERS.items()} | {"payload_bytes": size, "headers": headers, "payload": payload, "file": path, "offset": offset}
        return tuple(known.get(n) for n in self.names)


class _Content:
    """The content block of a record, read or inflated only as far as it is asked for."""

    def __init__(self, read, length: int):
        self.read, self.left, self.held = read, length, b""

    def http_head(self) -> bytes:
        while (at := self.held.find(b"\r\n\r\n")) < 0 and self.left:
            self._more(1024)
        head = self.held[: at + 4] if at >= 0 else self.held
        self.held = self.held[len(head) :]
        return head

    def rest(self) -> bytes:
        parts = [self.held]
        while self.left:
            self.held = b""
            self._more(self.left)
            parts.append(self.held)
        return b"".join(parts)

    def _more(self, n: int) -> None:
        data = self.read(min(n, self.left))
        if not data:
            raise ValueError("a WARC record ends before its Content-Length")
        self.left -= len(data)
        self.held += data


#: Headers that are looked up, by their name in lower case.
_NAMES = {name.lower(): name for name in (*HEADERS.values(), "Content-Length")}


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = ((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k)
    return {_NAMES.get(k.lower(), k): v for k, v in pairs}  # names of headers hold in any case


def _plain(file: BufferedReader) -> Iterator[tuple[int, dict[str, str], _Content]]:
    """Records of an uncompressed archive; what is left of a record is skipped by a seek."""
    while True:
        offset = file.tell()
        lines = []
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line.rstrip(b"\r\n"))
        if not lines:
            if not line:
                return
            continue
        headers, start = _parse(b"\r\n".join(lines)), file.tell()
        length = int(headers.get("Content-Length", 0))
        yield offset, headers, _Content(file.read, length)
        file.seek(start + length)


class _Inflater:
    """Inflates one gzip member, as far as it is read."""

    def __init__(self, file: BufferedReader):
        self.file, self.z, self.spare = file, zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        out = self.spare[:n]
        self.spare = self.spare[n:]
        while not out and not self.z.eof:
            data = self.z.unconsumed_tail or self.file.read(4096)
            if not data:
                raise ValueError("a gzip member ends early")
            out = self.z.decompress(data, n)
        return out

    def head(self) -> bytes:
        got = b""
        while (at := got.find(b"\r\n\r\n")) < 0:
            if not (more := self.read(4096)):
                raise ValueError("a WARC header ends early")
            got += more
        self.spare = got[at + 4 :] + self.spare
        return got[:at]


def _members(file: BufferedReader) -> Iterator[tuple[int, dict[str, str], _Content]]:
    """Records of an archive with a gzip member for each; members with lengths are skipped by a seek."""
    while True:
        offset = file.tell()
        start = file.read(24)
        if not start:
            return
        file.seek(offset)
        known = struct.unpack("<I", start[16:20])[0] if start[3:4] == b"\x04" and start[12:16] == b"sl\x08\0" else 0
        inflater = _Inflater(file)
        headers = _parse(inflater.head())
        yield offset, headers, _Content(inflater.read, int(headers.get("Content-Length", 0)))
        if known:
            file.seek(offset + known)
        else:
            while inflater.read(1 << 16) or not inflater.z.eof:
                pass
            file.seek(file.tell() - len(inflater.z.unused_data))


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark offer it predicates."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("warc")
    return (reader.schema(schema) if schema else reader).load(path)


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """Writes records (columns of SCHEMA, as many as there are) below ``path``."""
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(path)


def with_revisits(pages: DataFrame, id_col: str, payload: Column, least_bytes: int = 0) -> DataFrame:
    """Adds ``payload``, ``payload_bytes``, ``payload_digest`` and ``original``: of the pages with
    equal payloads of ``least_bytes`` or more, the largest id, null for that page itself.

    Only digests and ids are grouped (partial maxima first); the join on the digest may be split.
    """
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    rows = pages.withColumns({"payload": body, "payload_bytes": F.octet_length(body).cast("long"), "payload_digest": base32_sha1(body)})
    latest = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("_digest")).agg(F.max(id_col).alias("_latest"))
    joined = rows.join(latest, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= least_bytes), "left")
    return joined.withColumn("original", F.when(F.col("_latest") != F.col(id_col), F.col("_latest"))).drop("_digest", "_latest")
