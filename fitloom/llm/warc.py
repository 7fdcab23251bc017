"""WARC archives as a Spark data source, and pages archived with revisit records.

``read`` gives the records of a folder: it lists the committed archives, packs small files into partitions and splits
large ones. Filters on header columns are pushed into the reader: it parses a record's headers first and, where they
fail or the schema has no ``payload``, jumps to the next record without inflating the rest. (Spark 4.1 keeps the filters last pushed
into a loaded source for later queries that push none, and would lose rows; so ``read`` always pushes one that all records pass.)

Each record is a gzip member of its own whose extra field ``SL`` holds the member's size, so a reader can jump over a
member. Beside an archive stands an index of members' offsets, one for each ``indexbytes``; only there is a file split, as a payload
can hold anything, other archives too. Archives of other writers are read from their start, one partition each. Plain ``.warc``
files are read too, one partition each, skipping by Content-Length. A truncated record, or one with a header of over 1 MB,
raises ``ValueError`` with its place.

A write is committed by one listing of the files that its tasks finished, so files of lost or repeated tasks are never
read. Paths go to ``pyarrow.fs``, so they can be on any store that it knows; executors and driver must share them.

Defined results: null values leave their header out and come back null, but a type, written as resource and read as unknown where
there is none; a null payload is empty; a record needs no columns but ``warc_type``; extra columns are ignored; an empty table writes no archive and reads back as no rows.
Control characters in header values are percent-encoded.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

SCHEMA = (
    "warc_type string, record_id string, target_uri string, date string, content_type string, refers_to string, "
    "payload_digest string, payload_length bigint, payload binary"
)
#: Column, WARC header and what stands before the value in it.
HEADERS = {
    "warc_type": ("WARC-Type", ""),
    "record_id": ("WARC-Record-ID", ""),
    "target_uri": ("WARC-Target-URI", ""),
    "date": ("WARC-Date", ""),
    "content_type": ("WARC-Identified-Payload-Type", ""),
    "refers_to": ("WARC-Refers-To", ""),
    "payload_digest": ("WARC-Payload-Digest", "sha256:"),
    "payload_length": ("X-Payload-Length", ""),
}
EPOCH = "1970-01-01T00:00:00Z"
#: Start of a member: gzip, deflate, an extra field of 8 bytes, no time, the subfield SL of 4 bytes.
MARK = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x08\x00SL\x04\x00"
CHUNK = 1 << 20
#: Behind an archive's name, that of its index.
INDEX = ".offsets"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return MARK + struct.pack("<I", len(body) + 28) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _record(row: dict) -> bytes:
    kind, payload = row.get("warc_type") or "resource", row.get("payload") or b""
    lines = ["WARC/1.1"]
    for column, (header, prefix) in HEADERS.items():
        value = row.get(column)
        if column == "date" and value is None:
            value = EPOCH
        if value is not None:
            lines.append(f"{header}: {prefix}{_clean(str(value))}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    if kind in ("response", "revisit"):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: {_clean(row.get('content_type') or 'application/octet-stream')}\r\n"
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        lines.append("Content-Type: application/http;msgtype=response")
    else:
        block = payload
        lines.append("Content-Type: application/octet-stream")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcSource(ds.DataSource):
    """Options: path; ``splitbytes`` (64 MB) for partitions; when writing, ``level`` (1) of compression and ``indexbytes`` (8 MB)
    between the places where an archive can be split."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("splitbytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("level", 1)), int(self.options.get("indexbytes", 8 << 20)))


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, level: int, index_bytes: int, roll: int = 1 << 30):
        self.path, self.overwrite, self.level, self.index_bytes, self.roll = path, overwrite, level, index_bytes, roll

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _store(self.path)
        files, out, size, offsets = [], None, 0, [0]

        def close() -> None:
            out.close()
            with fs.open_output_stream(f"{root}/{files[-1]}{INDEX}", compression=None) as index:
                index.write(json.dumps(offsets).encode())

        for batch in iterator:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if out is None or size >= self.roll:
                        if out is not None:
                            close()
                        fs.create_dir(root, recursive=True)
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                        offsets = [0]
                    if size - offsets[-1] >= self.index_bytes:
                        offsets.append(size)
                    data = _member(_record(row), self.level)
                    out.write(data)
                    size += len(data)
        if out is not None:
            close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        files = [name for m in messages if m is not None for name in m.files]
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(root)):
                if info.base_name.removesuffix(INDEX) not in files and re.match(r"part-.*\.warc|_files-", info.base_name):
                    fs.delete_file(info.path)
        with fs.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, root = _store(self.path)
        for name in (name for m in messages if m is not None for name in m.files):
            for path in (f"{root}/{name}", f"{root}/{name}{INDEX}"):
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)


@dataclass
class Piece(ds.InputPartition):
    """Byte ranges (file, start, end) read by one task."""

    ranges: list[tuple[str, int, int]]


def _test(f: ds.Filter):
    """A function of a header column's value, for filters that headers can answer."""
    value = getattr(f, "value", None)
    known = {
        ds.EqualTo: lambda x: x is not None and x == value,
        ds.In: lambda x: x is not None and x in value,
        ds.IsNotNull: lambda x: x is not None,
        ds.IsNull: lambda x: x is None,
        ds.GreaterThan: lambda x: x is not None and x > value,
        ds.GreaterThanOrEqual: lambda x: x is not None and x >= value,
        ds.LessThan: lambda x: x is not None and x < value,
        ds.LessThanOrEqual: lambda x: x is not None and x <= value,
        ds.StringStartsWith: lambda x: x is not None and x.startswith(value),
        ds.StringEndsWith: lambda x: x is not None and x.endswith(value),
        ds.StringContains: lambda x: x is not None and value in x,
    }
    return known.get(type(f))


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.schema, self.split_bytes, self.filters = path, schema, split_bytes, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in HEADERS and _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Piece]:
        fs, root = _store(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root, recursive=False))
        listings = [i for i in infos if i.base_name.startswith("_files-")]
        listed = set()
        for info in listings:
            with fs.open_input_stream(info.path, compression=None) as f:
                listed |= set(json.loads(f.read()))
        there = {i.path for i in infos}
        files = sorted((i.path, i.size) for i in infos if (i.base_name in listed if listings else re.search(r"\.warc(\.gz)?$", i.base_name)))
        pieces, pack, room = [], [], self.split_bytes
        for path, size in files:
            if size > self.split_bytes:
                offsets, cuts = [0], [0]
                if path + INDEX in there:
                    with fs.open_input_stream(path + INDEX, compression=None) as f:
                        offsets = json.loads(f.read())
                for at in offsets:
                    if at - cuts[-1] >= self.split_bytes:
                        cuts.append(at)
                pieces += [Piece([(path, a, b)]) for a, b in zip(cuts, [*cuts[1:], size])]
                continue
            if pack and size > room:
                pieces, pack, room = [*pieces, Piece(pack)], [], self.split_bytes
            pack, room = [*pack, (path, 0, size)], room - size
        return [*pieces, *([Piece(pack)] if pack else [])]

    def read(self, partition: Piece) -> Iterator[tuple]:
        fs, _ = _store(self.path)
        names = [f.name for f in self.schema.fields]
        tests = [(f.attribute[0], _test(f)) for f in self.filters]
        for path, start, end in getattr(partition, "ranges", []):
            with fs.open_input_file(path) as f:
                yield from _read_file(f, start, end, names, tests, path.endswith(".gz"))


def _parse(head: bytes) -> dict:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def _columns(head: dict) -> dict:
    row = {}
    for column, (header, prefix) in HEADERS.items():
        value = head.get(header.lower())
        row[column] = value.removeprefix(prefix) if value is not None else None
    row["warc_type"] = row["warc_type"] or "unknown"
    row["payload_length"] = int(row["payload_length"]) if (row["payload_length"] or "").isdigit() else None
    return row


class _Window:
    """A file's bytes from an offset on, read in chunks. Skipping moves a mark and copies nothing; passed bytes go with the next read."""

    def __init__(self, f, at: int):
        self.f, self.at, self.buf, self.off, self.size = f, at, b"", 0, f.size()

    def must_hold(self, n: int) -> None:
        """Whether the next n bytes are read or not, they must be there."""
        if self.at + n > self.size:
            raise ValueError(f"truncated record at {self.at}")

    def fill(self, n: int) -> int:
        """Make n bytes available; how many there are."""
        if len(self.buf) - self.off < n:
            parts, size = [self.buf[self.off :]], len(self.buf) - self.off
            while size < n:
                self.f.seek(self.at + size)
                got = self.f.read(max(CHUNK, n - size))
                if not got:
                    break
                parts.append(got)
                size += len(got)
            self.buf, self.off = b"".join(parts), 0
        return len(self.buf) - self.off

    def bytes(self, start: int, end: int) -> bytes:
        """The bytes from start to end, or as many as there are."""
        self.fill(end)
        return self.buf[self.off + start : self.off + end]

    def find(self, what: bytes, most: int) -> int:
        self.fill(most)
        at = self.buf.find(what, self.off, self.off + most)
        return at - self.off if at >= 0 else -1

    def skip(self, n: int) -> None:
        self.off, self.at = self.off + n, self.at + n
        if self.off > len(self.buf):
            self.buf, self.off = b"", 0


def _read_file(f, start: int, end: int, names: list[str], tests: list, packed: bool) -> Iterator[tuple]:
    """Records from start, the place of one, up to end."""
    w = _Window(f, start)
    while w.at < end and w.fill(1):
        yield from (_packed if packed else _plain)(w, names, tests)


def _plain(w: _Window, names: list[str], tests: list) -> Iterator[tuple]:
    head_end = w.find(b"\r\n\r\n", CHUNK)
    if head_end < 0:
        if not w.bytes(0, CHUNK).strip():
            w.skip(w.fill(1))
            return
        raise ValueError(f"no end of a record's header within {CHUNK} bytes from {w.at}")
    head = _parse(w.bytes(0, head_end))
    size, block_at = int(head.get("content-length", 0)), head_end + 4
    row = _columns(head)
    w.must_hold(block_at + size)
    if all(test(row[c]) for c, test in tests):
        block = w.bytes(block_at, block_at + size) if "payload" in names else None
        yield _row(row, head, block, names)
    w.skip(block_at + size + 4)


def _packed(w: _Window, names: list[str], tests: list) -> Iterator[tuple]:
    ours = w.bytes(0, len(MARK)) == MARK
    length = struct.unpack("<I", w.bytes(len(MARK), len(MARK) + 4))[0] if ours and w.fill(len(MARK) + 4) >= len(MARK) + 4 else None
    inflater, text, fed = zlib.decompressobj(31), b"", 0

    def more(n: int, most: int) -> bytes:
        nonlocal fed
        got = b"" if inflater.unconsumed_tail else w.bytes(fed, fed + n)
        if not got and not inflater.unconsumed_tail:
            raise ValueError(f"truncated record at {w.at}")
        fed += len(got)
        return inflater.decompress(inflater.unconsumed_tail + got, most)

    while b"\r\n\r\n" not in text and not inflater.eof:
        if len(text) > CHUNK:
            raise ValueError(f"no end of a record's header within {CHUNK} bytes from {w.at}")
        text += more(8192, 4096)
    head_end = text.find(b"\r\n\r\n")
    if head_end < 0:
        raise ValueError(f"no record at {w.at}")
    head = _parse(text[:head_end])
    row = _columns(head)
    wanted = all(test(row[c]) for c, test in tests)
    if wanted and "payload" in names or not ours:
        parts, size, whole = [text], len(text), head_end + 4 + int(head.get("content-length", 0))
        while not inflater.eof:
            got = more(CHUNK, CHUNK)
            size += len(got)
            if wanted:
                parts.append(got)
        if size < whole:
            raise ValueError(f"truncated record at {w.at}")
        if size > whole + 4:
            raise ValueError(f"more than one record in the member at {w.at}")
        text = b"".join(parts)
        length = length or fed - len(inflater.unused_data)
    w.must_hold(length)
    if wanted:
        yield _row(row, head, text[head_end + 4 : head_end + 4 + int(head.get("content-length", 0))], names)
    w.skip(length)


def _row(row: dict, head: dict, block: bytes | None, names: list[str]) -> tuple:
    if "payload" in names:
        if block is not None and head.get("content-type", "").startswith("application/http"):
            block = block[block.find(b"\r\n\r\n") + 4 :]
        row = row | {"payload": block}
    return tuple(row.get(n) for n in names)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, for writing; read with ``read``."""
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, schema: str = SCHEMA, **options: object) -> DataFrame:
    """The records of the archives under ``path``, with the columns of ``schema``; filters on headers are pushed down."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    fields = StructType.fromDDL(schema)
    names = fields.fieldNames()
    if "warc_type" not in names:
        fields = fields.add("warc_type", "string")
    return spark.read.format("warc").schema(fields).options(**options).load(path).filter("warc_type IS NOT NULL").select(*names)


def page_records(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """WARC records of (page_id, url, html): of equal payloads of at least ``min_revisit`` bytes, that with the smallest
    page_id is a response and the others are revisits without a body. Rows that repeat the smallest id and the payload
    are all responses; a null id is never smallest, unless all are null.

    The payloads' digests are grouped with partial aggregation; html is shuffled once, by digest, and a hot digest is
    split by the adaptive skew join, as the other side has one row of it.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.length("payload").cast("long"))
    firsts = rows.filter(F.col("payload_length") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1 and first is not null").drop("n")
    rows = rows.join(firsts, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
