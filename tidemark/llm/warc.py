"""WARC archives as a Spark data source.

``spark.read.format("warc")`` plans one partition per group of files. In a partition each
record's headers are read first; predicates on them that Spark pushed down decide whether the
payload is read at all. Compressed archives hold one gzip member per record with the
skip-length field ``sl``, so an unwanted record is passed over by one seek after its first
few kilobytes; members without that field are inflated and thrown away.

Writing gives each task its own files, named in a manifest at the commit: files of failed or
repeated attempts are not in it and are never read.

Paths may name any file system that pyarrow opens (``file:``, ``hdfs:``, ``s3:``).

Defined cases: a null payload is an empty one; a null id or URL leaves its header out and reads
as null; control characters and blanks in URLs are percent-encoded; a response whose payload
differs from its digest is an error, unless ``verify`` is "false"; an empty table gives no file.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from tidemark.llm.staging import Stage, ship

LEAST_REVISIT = 100
FILE_BYTES, PARTITION_BYTES, READ_BYTES = 128 << 20, 64 << 20, 64 << 10
BATCH_BYTES, BATCH_ROWS = 16 << 20, 4096
MANIFEST = "_manifest.json"
SCHEMA = (
    "page_id long, record_type string, target_uri string, record_date string, refers_to long, "
    "payload_digest string, payload_bytes long, payload binary"
)
ARROW = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()),
     ("record_date", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
     ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
HEADER_COLUMNS = [name for name in ARROW.names if name not in ("payload_bytes", "payload")]


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path below it; ``file:/x`` and plain paths are local."""
    if match := re.fullmatch(r"file:/*(/.*)", path):
        return fs.LocalFileSystem(), match[1]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# -- one record -----------------------------------------------------------------------------


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _page(urn: str | None) -> int | None:
    match = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(match[1]) if match else None


def encode(row: dict, date: str) -> bytes:
    """A WARC record; a revisit has the HTTP headers of its payload only."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode("ascii")
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _urn(row["page_id"]),
        "WARC-Date": date,
        "WARC-Target-URI": quote(row["target_uri"], safe="!#$%&'()*+,/:;=?@[]~") if row["target_uri"] else None,
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Refers-To": _urn(row["refers_to"]) if revisit else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = [f"{name}: {value}\r\n" for name, value in headers.items() if value is not None]
    return b"WARC/1.1\r\n" + "".join(lines).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def compress(record: bytes) -> bytes:
    """A gzip member with its own lengths in the extra field ``sl``."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(record) + packer.flush()
    length = 10 + 2 + 12 + len(body) + 8
    if max(length, len(record)) >= 1 << 32:
        head = b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff"
    else:
        extra = b"sl" + struct.pack("<HII", 8, length, len(record))
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def skip_length(head: bytes) -> int | None:
    """Length of the gzip member that starts with ``head``, if it says so."""
    if len(head) >= 24 and head[3] & 4 and head[12:16] == b"sl\x08\x00":
        return struct.unpack("<I", head[16:20])[0]
    return None


def parse_headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"Not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        if name:
            out[name.strip().lower()] = value.strip()
    return out


def header_row(headers: dict[str, str]) -> dict:
    return {
        "page_id": _page(headers.get("warc-record-id")),
        "record_type": headers.get("warc-type"),
        "target_uri": headers.get("warc-target-uri"),
        "record_date": headers.get("warc-date"),
        "refers_to": _page(headers.get("warc-refers-to")),
        "payload_digest": headers.get("warc-payload-digest", "").rpartition(":")[2] or None,
    }


class Records:
    """Records of one open archive: headers first, the block only if it is wanted."""

    def __init__(self, file: pa.NativeFile, compressed: bool):
        self.file, self.compressed, self.size = file, compressed, file.size()

    def __iter__(self) -> Iterator[tuple[dict, "Block"]]:
        at = 0
        while at < self.size:
            block = (Member if self.compressed else Block)(self.file, at)
            yield parse_headers(block.head()), block
            at = block.end()


class Block:
    """A record of a plain archive, read as far as asked for."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.start, self.data, self.body = file, start, bytearray(), 0

    def more(self) -> bool:
        chunk = self.file.read_at(READ_BYTES, self.start + len(self.data))
        self.data += chunk
        return bool(chunk)

    def head(self) -> bytes:
        while (end := self.data.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("An archive ends within a record's headers.")
        self.body = end + 4
        return bytes(self.data[:end])

    def length(self) -> int:
        return int(parse_headers(bytes(self.data[: self.body]))["content-length"])

    def read(self) -> bytes:
        end = self.body + self.length()
        while len(self.data) < end:
            if not self.more():
                raise ValueError("An archive ends within a record.")
        return bytes(self.data[self.body : end])

    def end(self) -> int:
        return self.start + self.body + self.length() + 4


class Member(Block):
    """A record of a compressed archive: one gzip member."""

    def __init__(self, file: pa.NativeFile, start: int):
        super().__init__(file, start)
        self.fed, self.unpack, self.first = 0, zlib.decompressobj(zlib.MAX_WBITS | 16), b""

    def more(self) -> bool:
        if self.unpack.eof:
            return False
        chunk = self.unpack.unconsumed_tail
        if not chunk:
            chunk = self.file.read_at(4096 if not self.fed else READ_BYTES, self.start + self.fed)
            self.first = self.first or chunk[:24]
            self.fed += len(chunk)
        self.data += self.unpack.decompress(chunk, READ_BYTES)
        return bool(chunk)

    def end(self) -> int:
        length = skip_length(self.first)
        if length is not None:
            return self.start + length
        while self.more():
            del self.data[self.body :]
        return self.start + self.fed - len(self.unpack.unused_data)


# -- reading --------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class WarcReader(DataSourceReader):
    path: str
    with_payload: bool
    verify: bool
    tests: list[Filter] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for test in filters:
            if isinstance(test, (EqualTo, In, IsNull, IsNotNull)) and test.attribute[0] in HEADER_COLUMNS:
                self.tests.append(test)
            else:
                yield test

    def wanted(self, row: dict) -> bool:
        for test in self.tests:
            value = row[test.attribute[0]]
            if isinstance(test, IsNull):
                fits = value is None
            elif isinstance(test, IsNotNull):
                fits = value is not None
            elif isinstance(test, In):
                fits = value in test.value
            else:
                fits = value == test.value
            if not fits:
                return False
        return True

    def files(self) -> list[tuple[str, int]]:
        system, root = open_folder(self.path)
        manifest = f"{root}/{MANIFEST}"
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_file(manifest) as file:
                names = json.loads(file.read())
            infos = system.get_file_info([f"{root}/{n}" for n in names]) if names else []
        else:
            infos = system.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((i.path, i.size) for i in infos if i.path.endswith((".warc", ".warc.gz")))

    def partitions(self) -> list[Files]:
        out, size = [], PARTITION_BYTES
        for path, length in self.files():
            if size + length > PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += length
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for headers, block in Records(file, path.endswith(".gz")):
                    row = header_row(headers)
                    if not self.wanted(row):
                        continue
                    rows.append(row | self.payload(row, block))
                    size += len(rows[-1]["payload"] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def payload(self, row: dict, block: Block) -> dict:
        if not self.with_payload:
            return {"payload_bytes": None, "payload": None}
        http, _, body = block.read().partition(b"\r\n\r\n")
        if row["record_type"] == "revisit":
            length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
            return {"payload_bytes": int(length[1]) if length else None, "payload": None}
        if self.verify and row["payload_digest"] not in (None, hashlib.sha256(body).hexdigest()):
            raise ValueError(f"Payload of page {row['page_id']} differs from its digest.")
        return {"payload_bytes": len(body), "payload": body}


# -- writing --------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


@dataclass
class WarcWriter(DataSourceArrowWriter):
    path: str
    overwrite: bool
    packed: bool
    date: str

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        names, out = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or out.tell() >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                    out = system.open_output_stream(f"{root}/{names[-1]}", compression=None)
                record = encode(row, self.date)
                out.write(compress(record) if self.packed else record)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        manifest, names = f"{root}/{MANIFEST}", []
        if not self.overwrite and system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_file(manifest) as file:
                names = json.loads(file.read())
        names += [name for m in messages if m for name in m.names]
        with system.open_output_stream(f"{manifest}.new") as file:
            file.write(json.dumps(names).encode())
        system.move(f"{manifest}.new", manifest)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = open_folder(self.path)
        for name in (name for m in messages if m for name in m.names):
            system.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Options: path; payload ("true"), verify ("true"); for writing compression ("gzip", "none"), date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        options = self.options
        return WarcReader(
            options["path"], options.get("payload", "true") == "true", options.get("verify", "true") == "true"
        )

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        options = self.options
        packed = options.get("compression", "gzip") == "gzip"
        return WarcWriter(options["path"], overwrite, packed, options.get("date", now))


def register(spark: SparkSession) -> None:
    """Make the format "warc" known to the session, with filters pushed down to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -- pages ----------------------------------------------------------------------------------


def to_records(pages: DataFrame) -> DataFrame:
    """Rows to write, of (page_id, url, html).

    Of equal payloads of ``LEAST_REVISIT`` bytes or more, rows whose id is larger than the
    smallest revisit that one; a null id is always a response. Only payloads that occur more
    than once, by digest, are on the joined side, and Spark may split a digest's rows.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("target_uri"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    shared = (
        rows.where(F.octet_length("payload") >= LEAST_REVISIT)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first < last")
        .select("payload_digest", "first")
    )
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return rows.join(shared, "payload_digest", "left").select(
        "page_id",
        F.when(refers.isNotNull(), "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        refers.alias("refers_to"),
        "payload_digest",
        "payload",
    )


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and return the records read back."""
    spark = pages.sparkSession
    register(spark)
    path = Stage(spark, "warc").path("archive")
    to_records(pages).write.format("warc").option("path", path).mode("append").save()
    return spark.read.format("warc").load(path)
