"""Best-fit packing of documents into sequences of at most SIZE tokens, by sums of squares.

Documents become token ids with a public tokenizer, then the id 0. Only those longer than SIZE are cut: pieces of SIZE
tokens at their end, before them one with the rest. A piece of SIZE tokens is a sequence of its own; the others are
dealt by a hash into shards of about SHARD pieces, and each shard is packed, longest first, in one task: a piece goes
into the open bin, by residual gap g of which N(g) bins are open, where the sum of N(g) squared becomes smallest, a
perfect fit before all; a new bin is opened only when no open one has room, as the aim is few sequences. A shard leaves a
bin or two that are not full, which is the only loss against packing all pieces at once, and its memory does not grow with
the input.

Null texts count as empty: the id 0 alone. Repeated rows, and rows with equal ids, are packed as often as they occur.
Null ids stay null. Very long texts are encoded whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import cache, to_batch

SIZE, SHARD, END = 2048, 8192, 0
#: Words of which a worker remembers the ids, about 200 bytes each.
REMEMBERED = 600_000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("copy", T.LongType()),
    ]
)
PACKED = T.StructType([*PIECES.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

#: A blank between two characters that are no white space: no token of the tokenizer spans it but at its start.
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: ASCII white space as blanks, to look for two in a row; the white space beyond ASCII, and what Python adds to it.
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RARE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def parts(text: str) -> list[str]:
    """A text cut at each BOUNDARY, without the blanks."""
    flat = text.encode().translate(_BLANKS)
    if b"  " in flat or flat[:1] == b" " or flat[-1:] == b" " or any(c in text for c in _RARE):
        return BOUNDARY.split(text)
    return text.split(" ")


#: Characters outside which the two libraries' tables of letters might differ; such words go to tokenizers.
USUAL = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u017f\u2010-\u2027\u20ac]*")


class Encoder:
    """Ids of whole texts with a tokenizers file of the byte-level kind, word by word and remembered.

    The split before tokens are merged never joins what is before and after a single blank that has other characters
    on both sides (the blank begins the next token), so a text's ids are those of its parts at such blanks. New words
    of usual characters are merged by tiktoken with the file's own vocabulary, which is several times faster and gives
    the same ids; all other words by tokenizers.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # byte-level vocabularies write bytes that are not printable Latin-1 as the characters from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memory: dict[str, bytes] = {}  # by part, with the blank before it

    def _ids(self, part: str) -> bytes:
        if part.isascii() or USUAL.fullmatch(part):
            return array("I", self.fast.encode_ordinary(part)).tobytes()
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """A text's ids as unsigned 32-bit integers of this machine."""
        head, *tail = parts(text)
        known = self.memory
        ids = list(map(known.get, tail))
        if None in ids:
            if len(known) > REMEMBERED:
                known.clear()
            for i, x in enumerate(ids):
                if x is None:
                    w = tail[i]
                    ids[i] = known.get(w)
                    if ids[i] is None:
                        ids[i] = known[w] = self._ids(" " + w)
        return self._ids(head) + b"".join(ids)


_encoders: dict[str, Encoder] = cache()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first has the rest, all others `size`."""
    head = n % size or min(n, size)
    return [(0, head), *((a, size) for a in range(head, n, size))]


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """PIECES of every row of docs (doc_id, text); copy tells repeated rows apart by their place in the input."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(PIECES)
    end = array("I", [END]).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for doc_id, text, copy in zip(ids, batch.column(1).to_pylist(), copies):
                raw = np.frombuffer(own.encode(text or "") + end, np.uint32).astype("<u4", copy=False)
                for k, (start, length) in enumerate(cut(len(raw), size)):
                    rows.append((doc_id, k, start, length, zlib.crc32(raw[start : start + length]), copy))
            if rows:
                yield to_batch(dict(zip(arrow.names, zip(*rows))), arrow)

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("copy")).mapInArrow(run, PIECES)


def place(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces, given longest first, by sums of squares."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by gap
    count = np.zeros(size + 1, np.int64)
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        if count[n]:
            gap = n
        else:
            # change of the sum of squares if a bin of gap h gets n: it leaves N(h) and joins N(h - n)
            change = np.where(count[n + 1 :] > 0, count[1 : size + 1 - n] - count[n + 1 :], np.iinfo(np.int64).max)
            best = int(change.argmin()) if len(change) else -1
            gap = n + 1 + best if best >= 0 and count[n + 1 + best] else 0
        if gap:
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            b, gap, used = used, size, used + 1
        bins[i], offsets[i] = b, size - gap
        if gap > n:
            open_bins[gap - n].append(b)
            count[gap - n] += 1
    return bins, offsets


def pack(rows: DataFrame, shards: int, size: int = SIZE) -> DataFrame:
    """PACKED of rows (PIECES): whole pieces at once, others by shard. Sequence numbers have the shard in their high bits."""
    whole = rows.where(F.col("length") == size)
    part = rows.where(F.col("length") < size).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(shards)).cast("int"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "copy"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = place(frame["length"].to_numpy(), size)
        frame["sequence_id"] = (int(frame["shard"].iloc[0]) + 1 << 32) + bins
        frame["offset"] = offsets
        return frame[PACKED.names]

    packed = part.groupBy("shard").applyInPandas(run, PACKED)
    # a piece that fills its sequence: numbers below 0, one for each row
    alone = whole.select(*PIECES.names[:-1], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def packing_report(docs: DataFrame, path: str, stage, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """Every document's pieces with their sequence and place; stage writes a table to the shared folder and reads it."""
    rows = stage(pieces(docs, path, size))
    n = rows.where(F.col("length") < size).count()
    return pack(rows, max(1, -(-n // shard)), size)
