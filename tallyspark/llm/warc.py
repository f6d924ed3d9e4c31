"""Seekable Zstandard bundles of WARC records.

Records are grouped into frames of about FRAME raw bytes that are compressed independently; frames follow each other in
a bundle, which ends with a seek table (a skippable frame, magic 0x184D2A5E, whose footer has the magic 0x8F92EAB1). A
bundle is a file of its own in a shared folder (*.warc.zst, which any Zstandard tool opens), written by the task that has
its records. The index, a table, maps each record identifier to its bundle, its frame and its offset within that frame, so
that one record is read by decompressing one frame (lookup()).

A bundle's name is a digest of its content, so a task that runs again after an executor was lost writes the same file, or
one that no index names. Very long payloads are one frame. Columns of pages but page_id, url and html are not read.

A null payload counts as empty, a null url as "about:blank". Rows with equal page_id are separate records of the same
identifier; a row whose page_id is that of the response is a response itself. Null page_ids are written as the
identifier "null" and are responses if no row with the same payload has an id.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME, BUNDLE = 1 << 20, 32 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("bundle", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("frame", "offset", "length")]])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(pairs: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header of its payload, with its length, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http + (payload if refers_to is None else b"")
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _headers(head) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class BundleWriter:
    """Collects records into frames; close() appends the seek table."""

    def __init__(self, level: int = 3, frame: int = FRAME):
        self.frame, self.out, self.sizes, self.index = frame, bytearray(), [], []
        self._open, self._zstd = bytearray(), zstandard.ZstdCompressor(level=level)

    def add(self, record_id: str, raw: bytes) -> None:
        if self._open and len(self._open) + len(raw) > self.frame:
            self._flush()
        self.index.append((record_id, len(self.sizes), len(self._open), len(raw)))
        self._open += raw

    def _flush(self) -> None:
        if self._open:
            packed = self._zstd.compress(bytes(self._open))
            self.sizes.append((len(packed), len(self._open)))
            self.out += packed
            self._open = bytearray()

    def __len__(self) -> int:
        return len(self.out) + len(self._open)

    def close(self) -> bytes:
        self._flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class BundleReader:
    """Random access to the records of an open file by frame and offset; the last frame that was read stays in memory."""

    def __init__(self, file):
        self.file = io.BytesIO(file) if isinstance(file, bytes) else file
        end = self.file.seek(0, io.SEEK_END) or self.file.tell()
        count, _, magic = struct.unpack("<IBI", self._bytes(end - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entries = struct.unpack(f"<{2 * count}I", self._bytes(end - 9 - 8 * count, 8 * count))
        self.places, at = [], 0
        for i in range(count):
            self.places.append((at, entries[2 * i], entries[2 * i + 1]))
            at += entries[2 * i]
        self._last, self._zstd = (-1, b""), zstandard.ZstdDecompressor()

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self._last[0] != frame:
            at, size, raw = self.places[frame]
            self._last = frame, self._zstd.decompress(self._bytes(at, size), max_output_size=raw)
        return self._last[1][offset : offset + length]


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with digest, n_bytes and refers_to: the smallest page_id of an equal payload of at least min_bytes, or null."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"sha": F.sha1("payload"), "n_bytes": F.length("payload")})
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first_id"))  # summed on the map side; copies are never gathered
    target = F.when((F.col("n_bytes") >= min_bytes) & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return rows.join(first, "sha").select("page_id", "url", F.when(target.isNull(), F.col("payload")).alias("payload"), "sha", "n_bytes", target.alias("refers_to"))


def write_file(folder: str, archive: bytes) -> str:
    """Writes a bundle below folder (a URI that all executors can reach) and returns its URI."""
    from pyarrow import fs

    uri = f"{folder}/{hashlib.sha1(archive).hexdigest()}.warc.zst"
    place, path = fs.FileSystem.from_uri(uri)
    place.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with place.open_output_stream(part) as f:
        f.write(archive)
    try:
        place.move(part, path)  # whole or not at all
    except OSError:
        if place.get_file_info(path).size != len(archive):  # not the same file from another try
            raise
        with contextlib.suppress(OSError):
            place.delete_file(part)
    return uri


def write_bundles(planned: DataFrame, folder: str) -> DataFrame:
    """INDEX rows of all records. When rows are read, tasks write bundles of at most about BUNDLE compressed bytes below
    folder: write them to a table and read that."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(INDEX)

    def emit(writer: BundleWriter) -> pa.RecordBatch:
        uri = write_file(folder, writer.close())
        ids, *places = zip(*writer.index)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, [uri] * len(ids), *places), arrow)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter()
        for batch in batches:
            for page_id, url, payload, sha, n_bytes, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                body = payload if refers_to is None else _Length(n_bytes)
                writer.add("null" if page_id is None else str(page_id), record(page_id, url, body, digest, refers_to))
                if len(writer) > BUNDLE:
                    yield emit(writer)
                    writer = BundleWriter()
        if writer.index:
            yield emit(writer)

    return planned.select("page_id", "url", "payload", "sha", "n_bytes", "refers_to").mapInArrow(run, INDEX)


class _Length:
    """Stands for a payload that is not written, of which the length is."""

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("bundle", T.StringType()),
        T.StructField("frame", T.LongType()),
        T.StructField("frame_offset", T.LongType()),
    ]
)


def _number(urn: str) -> int | None:
    found = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "null" else int(found)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """For each batch of INDEX rows (bundle, frame, offset, length): the parsed records, each with its place."""
    from pyarrow import fs

    with contextlib.ExitStack() as opened:
        name, reader = None, None
        for batch in batches:
            out = []
            for bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != name:
                    opened.close()
                    place, path = fs.FileSystem.from_uri(bundle)
                    name, reader = bundle, BundleReader(opened.enter_context(place.open_input_file(path)))
                out.append((*parse_record(reader.read(frame, offset, length)), bundle.rsplit("/", 1)[-1], frame, offset))
            if out:
                yield out


def read_bundles(index: DataFrame) -> DataFrame:
    """A row of READ for each record of an index, read from the files; a response's digest is computed from its payload again."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(READ)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _records(batches):
            rows = []
            for warc, http, payload, name, frame, offset in found:
                kind = warc["WARC-Type"]
                digest, size = warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"record {warc['WARC-Record-ID']} of bundle {name} is damaged")
                rows.append((_number(warc["WARC-Record-ID"]), size, digest, kind, _number(warc["WARC-Refers-To"]) if kind == "revisit" else None, name, frame, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return index.select("bundle", "frame", "offset", "length").mapInArrow(run, READ)


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload) of the records wanted (record_id): only their frames are read. A
    revisit's payload is null; identifiers that no record has give no row."""
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _records(batches):
            rows = [(_number(w["WARC-Record-ID"]), w["WARC-Target-URI"], w["WARC-Type"], _number(w["WARC-Refers-To"]) if "WARC-Refers-To" in w else None, payload if w["WARC-Type"] == "response" else None) for w, _, payload, *_ in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], names=schema.names)

    # records of a frame after each other, so that it is read once
    places = index.join(wanted.select("record_id"), "record_id", "left_semi").sortWithinPartitions("bundle", "frame", "offset")
    return places.select("bundle", "frame", "offset", "length").mapInArrow(run, schema)


#: What is read back, in DuckDB: a digest's base32 comes from its hexadecimal digits, five of which are four letters.
SQL = """
with d as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as sha from pages),
f as (select sha, min(page_id) as first_id, list_transform(range(8), lambda i: cast(concat('0x', substr(sha, 5 * i + 1, 5)) as integer)) as quads from d group by sha),
b as (select sha, first_id, array_to_string(list_transform(range(32), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((quads[cast(k // 4 + 1 as integer)] >> cast(15 - 5 * (k % 4) as integer)) & 31 as integer) + 1, 1)), '') as digest from f)
select page_id, cast(payload_bytes as bigint) as payload_bytes, digest as payload_digest,
  case when first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first_id then first_id end as refers_to
from d join b on d.sha = b.sha
"""
