"""Interleaved sequences of text and media.

parse_sequences() turns HTML into an ordered array of segments: texts, and references to media by digest with their
caption. resolve() joins the references to a media table on the digest, so that position and caption stay with the
payload's features. Payloads are 8-bit greyscale PNG images of 64 samples a row, written and read without loss.

Null HTML gives an empty sequence, and a document without segments keeps its row. References that no payload has keep
null features. Media rows with equal digests count once; a null digest matches nothing. A caption ends with its figure at
the latest; text after a caption that nothing ends is text of its own, so no text is lost. Repeated rows, and rows with
equal ids, give a row each; very long texts are stored whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import map_batches

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"

SEGMENT = T.StructType(
    [T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType())]
)


def pad(raw: bytes) -> bytes:
    """raw and zeros up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """Samples of 8 bits, WIDTH a row, no filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of an image of to_png(); checks every chunk."""
    if not stored.startswith(PNG):
        raise ValueError("not a PNG image")
    at, width, packed = len(PNG), 0, b""
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, _, depth, colour, *_ = struct.unpack(">IIBBBBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("8-bit greyscale only")
        elif kind == b"IDAT":
            packed += data
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """A histogram of 16 levels, each as a share of 255, the mean and the mean step between neighbours, as hex."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    step = int(np.abs(np.diff(x.astype(np.int16))).mean())
    return bytes([*share.tolist(), int(x.mean()), min(255, step)]).hex()


class _Segments(HTMLParser):
    """Texts and media references in document order; figcaption and alt become the caption of their media."""

    SKIP = {"script", "style", "template"}
    #: Elements that break a line of text at their begin and end.
    BLOCK = set(
        "address article aside blockquote body br caption center dd details dialog div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
        "ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
    )

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.out.append({"pos": len(self.out), "kind": "text", "text": text, "digest": None, "caption": None})
        self.text = []

    def end_caption(self) -> None:
        if self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for x in self.out[self.figure or 0 :] if self.figure is not None else self.out[-1:]:
                if x["kind"] == "media":
                    x["caption"] = text
            self.caption = None

    def close(self) -> None:
        super().close()
        if self.caption is not None:  # nothing ended it: what it has may be the rest of the document
            self.text, self.caption = [*self.text, *self.caption], None
        self.flush()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figure = len(self.out)
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in ("img", "audio", "video") and (a.get("src") or a.get("data-digest")):
            self.flush()
            src = a.get("data-digest") or a["src"]
            self.out.append({"pos": len(self.out), "kind": "media", "text": None, "digest": src.removeprefix("media:"), "caption": a.get("alt")})
        elif tag in self.BLOCK:
            self.end_line()

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figure = None
        elif tag in self.BLOCK:
            self.end_line()

    def end_line(self) -> None:
        if self.caption is None:
            self.flush()
        else:
            self.caption.append(" ")

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def segments(html: str | None) -> list[dict]:
    parser = _Segments()
    parser.feed(html or "")
    parser.close()
    return parser.out


def parse_sequences(pages: DataFrame, id_column: str, html_column: str = "html") -> DataFrame:
    """(id, segments) of every row."""
    schema = T.StructType([pages.schema[id_column], T.StructField("segments", T.ArrayType(SEGMENT))])

    def run(batch: pa.RecordBatch) -> dict:
        return {id_column: batch.column(0), "segments": [segments(x) for x in batch.column(1).to_pylist()]}

    return map_batches(pages.select(id_column, html_column), run, schema)


def store_media(payloads: DataFrame) -> DataFrame:
    """(digest, stored) of payloads (payload binary of whole rows); the digest is the payload's SHA-256.

    Equal payloads within a batch are stored once; those of different batches meet in read_media().
    """
    schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("stored", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> dict:
        own = {hashlib.sha256(x).hexdigest(): x for x in batch.column(0).to_pylist() if x is not None}
        return {"digest": list(own), "stored": [to_png(x) for x in own.values()]}

    return map_batches(payloads.select("payload"), run, schema)


FEATURES = T.StructType(
    [
        T.StructField("digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def read_media(stored: DataFrame) -> DataFrame:
    """A row of FEATURES for each digest, computed from the stored bytes."""

    def run(batch: pa.RecordBatch) -> dict:
        out = {f.name: [] for f in FEATURES}
        for digest, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            payload = from_png(raw)
            row = (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(payload))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    rows = map_batches(stored.select("digest", "stored"), run, FEATURES)
    return rows.groupBy("digest").agg(*[F.first(f.name).alias(f.name) for f in FEATURES[1:]])


def resolve(sequences: DataFrame, id_column: str, features: DataFrame) -> DataFrame:
    """A row for each segment (id, pos, kind, text, digest, caption) with its media's features; null for texts."""
    flat = sequences.select(id_column, F.explode_outer("segments").alias("s")).select(id_column, "s.*")
    return flat.join(features, "digest", "left")


def media_report(docs: DataFrame, stage) -> DataFrame:
    """Every text as a media payload: stored, referenced from a page, resolved by digest and read back.

    stage writes a table to the shared folder and reads it again.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.length(raw)
    padded = F.greatest(F.ceil(size / F.lit(WIDTH)), F.lit(1)) * WIDTH
    rows = docs.select("doc_id", size.cast("long").alias("n_bytes"), F.rpad(raw, padded.cast("int"), F.lit(b"\0")).alias("payload"))
    # a table of its own, so that the join below deals references by digest anew and can split a common one
    features = stage(read_media(stage(store_media(rows.select("payload")))))
    page = F.concat(F.lit('<article><p>Document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit('</p><figure><img src="media:'), F.sha2("payload", 256), F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    sequences = parse_sequences(rows.select(F.struct("doc_id", "n_bytes").alias("id"), page.alias("html")), "id")
    found = resolve(sequences, "id", features).where("kind = 'media'")
    return found.select("id.doc_id", "id.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
