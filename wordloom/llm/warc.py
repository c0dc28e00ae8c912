"""WARC archives: writing, and the normaliser for archives that are one gzip stream.

Some tools compress a whole archive as one gzip stream, in which no record can be
reached without inflating all before it.  The normaliser inflates such a stream once,
writes every record as a gzip member of its own, and beside it a sidecar index of
(offset, length, record id, type, target) by which any record is read alone.

Files are written in a folder that all executors share, each under a temporary name that
is then renamed, so that a task that runs again replaces its file by an equal one.
"""

from __future__ import annotations

import hashlib
import json

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import checkpointed, shared_folder

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: Bytes read or inflated at once, and of records in an archive.
BLOCK = 1 << 20
ARCHIVE_BYTES = 64 << 20
#: Revisits (some 60 bytes each) up to which all tasks get them.
SENT_ROWS = 500_000

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Folder:
    """A folder of a store: local paths and file:// by the system, others by Arrow's file systems."""

    def __init__(self, uri: str):
        self.uri = uri
        parts = urlsplit(uri)
        if parts.scheme in ("", "file"):
            self.fs, self.path = pa.fs.LocalFileSystem(), parts.path
        else:
            self.fs, self.path = pa.fs.FileSystem.from_uri(uri)

    def make(self) -> Folder:
        self.fs.create_dir(self.path, recursive=True)
        return self

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")

    def write(self, name: str) -> _Output:
        return _Output(self, name)


class _Output:
    """A file that has its name only once it is whole."""

    def __init__(self, folder: Folder, name: str):
        self.folder, self.name, self.part = folder, name, f"{name}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.file = self.folder.fs.open_output_stream(f"{self.folder.path}/{self.part}", compression=None)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind is None:
            self.folder.fs.move(f"{self.folder.path}/{self.part}", f"{self.folder.path}/{self.name}")
        else:
            self.folder.fs.delete_file(f"{self.folder.path}/{self.part}")


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    """A header value: no line ends or control characters."""
    return "".join(c for c in value if c >= " ")


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response or, with refers_to, a revisit record of a page."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url or "")), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        return record_bytes([*headers, ("WARC-Refers-To", name(refers_to)), ("WARC-Profile", _PROFILE), ("Content-Type", "application/http; msgtype=response")], http)
    return record_bytes([*headers, ("Content-Type", "application/http; msgtype=response")], http + payload)


def _archives(uri: str):
    """Writes records as archives that are one gzip stream each; gives their names."""

    def write(batches):
        folder, part = Folder(uri), TaskContext.get().partitionId()
        names: list[tuple[str, int]] = []

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)

        it, row = (x := rows()), next(x, None)
        while row is not None:
            name, written, records = f"{part:06d}-{len(names):04d}.warc.gz", 0, 0
            with folder.write(name) as out:
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                while row is not None and written < ARCHIVE_BYTES:
                    page_id, url, payload, digest, refers_to = row
                    data = page_record(page_id, url, payload or b"", digest, refers_to)
                    out.write(squeeze.compress(data))
                    written += len(data)
                    records += 1
                    row = next(it, None)
                out.write(squeeze.flush())
            names.append((name, records))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in names], pa.string()), pa.array([r for _, r in names], pa.int64())], names=["archive", "records"])

    return write


def inflated(file) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members; a member that does not end is an error."""
    unpack, begun = zlib.decompressobj(31), False
    while data := file.read(BLOCK):
        while data:
            begun = True
            out = unpack.decompress(data, BLOCK)
            if out:
                yield out
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack, begun = unpack.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("a gzip stream does not end")


class RecordReader:
    """Records of a stream of WARC bytes, one held at a time."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, bytearray()

    def _fill(self) -> bool:
        block = next(self.blocks, b"")
        self.held += block
        return bool(block)

    def __iter__(self) -> Iterator[tuple[dict[str, str], int, bytes]]:
        """(headers by lower-case name, where the block begins, the record's bytes)."""
        while True:
            at, seen = -1, 0
            while (at := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                seen = len(self.held)
                if not self._fill():
                    if bytes(self.held).strip():
                        raise ValueError("a record's headers do not end")
                    return
            headers = parse_headers(bytes(self.held[:at]))
            if not headers.get("content-length", "").isdigit():
                raise ValueError("a record has no Content-Length")
            size = at + 4 + int(headers["content-length"]) + 4
            while len(self.held) < size:
                if not self._fill():
                    raise ValueError("a record's block does not end")
            record = bytes(self.held[:size])
            del self.held[:size]
            yield headers, at + 4, record


def parse_headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def normalise(source: Folder, name: str, target: Folder) -> list[tuple[str, int, int, str, str, str]]:
    """Rewrites an archive with a gzip member for each record; (archive, offset, length, id, type, target) of each.

    The sidecar index of the same rows is written beside the archive, one JSON object a line.
    """
    index = []
    with source.open(name) as file, target.write(name) as out:
        at = 0
        for headers, _, record in RecordReader(inflated(file)):
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = squeeze.compress(record) + squeeze.flush()
            out.write(member)
            index.append((name, at, len(member), headers.get("warc-record-id", ""), headers.get("warc-type", ""), headers.get("warc-target-uri", "")))
            at += len(member)
    with target.write(f"{name}.idx") as side:
        for row in index:
            side.write((json.dumps(dict(zip(("archive", "offset", "length", "id", "type", "uri"), row, strict=True))) + "\n").encode())
    return index


def _normaliser(source: str, target: str):
    def run(batches):
        a, b = Folder(source), Folder(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = normalise(a, name, b)
                for k in range(0, len(rows), 50_000):
                    part = rows[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64() if i in (1, 2) else pa.string()) for i in range(6)], names=["archive", "offset", "length", "id", "type", "uri"])

    return run


def read_record(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at an offset of a normalised archive."""
    file.seek(offset)
    record = zlib.decompress(file.read(length), 31)
    at = record.index(b"\r\n\r\n")
    headers = parse_headers(record[:at])
    return headers, record[at + 4 : at + 4 + int(headers["content-length"])]


def _number(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value in ("", "null") else int(value)


def _reader(uri: str):
    """page_id, payload_bytes, payload_digest, record_type and refers_to of indexed records."""

    def read(batches):
        folder, name, file = Folder(uri), None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, folder.open(archive)
                headers, block = read_record(file, offset, length)
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                if headers["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"{archive} at {offset}: the payload is not what its headers say")
                out.append((_number(headers["warc-record-id"]), size, digest, headers["warc-type"], _number(headers.get("warc-refers-to", ""))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file is not None:
            file.close()

    return read


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to: the smallest page_id with an equal payload, null for that one itself.

    Null html is an empty payload.  Rows that share the smallest id are all responses.  A
    null page_id is greater than any other, and a group of such ids has responses only.
    Payloads are equal if their digests and sizes are; what is shuffled are digests.
    """
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    held = full.select("page_id", F.unhex("digest").alias("key"), F.length("payload").alias("size")).filter(F.col("size") >= least)
    first = held.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    refers = held.join(first, "key").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("id"), F.col("key"), "first").distinct()
    # Revisits are looked up where the payloads are, unless there are too many to send.
    refers = checkpointed(refers)
    refers = F.broadcast(refers) if refers.count() <= SENT_ROWS else refers
    joined = full.join(refers, full["page_id"].eqNullSafe(refers["id"]) & (F.unhex(full["digest"]) == refers["key"]), "left")
    return joined.select("page_id", "url", "payload", "digest", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """(archive, records): the pages' records in archives of one gzip stream under uri."""
    Folder(uri).make()
    done = with_revisits(pages).mapInArrow(_archives(uri), "archive string, records long")
    return checkpointed(done)


def normalise_archives(archives: DataFrame, source: str, target: str) -> DataFrame:
    """(archive, offset, length, id, type, uri): the index of the archives rewritten under target."""
    Folder(target).make()
    spread = archives.filter("records > 0").select("archive").repartition(max(1, archives.count()), "archive")
    return checkpointed(spread.mapInArrow(_normaliser(source, target), "archive string, offset long, length long, id string, type string, uri string"))


def read_archives(index: DataFrame, uri: str) -> DataFrame:
    """Pages' records read back, one by one, by the index; payloads are checked against their digests."""
    return index.select("archive", "offset", "length").mapInArrow(_reader(uri), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Pages written to archives of one gzip stream each, normalised, and read back by the index.

    Nulls, repeats and ties: as with_revisits has them.  An empty table gives no rows.
    """
    folder = shared_folder(spark, "warc")
    whole, records = f"{folder}/whole", f"{folder}/records"
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), whole)
    index = normalise_archives(archives, whole, records)
    Folder(whole).fs.delete_dir(Folder(whole).path)
    return read_archives(index, records)
