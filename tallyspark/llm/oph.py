"""Document fingerprints by one-permutation MinHash.

Each text's shingles (5 words) are hashed once; the hash's top bits choose one of BINS bins, of which each keeps the
smallest hash. Empty bins are filled by optimal densification: bin i tries the bins that a hash of (i, attempt) names
until one was filled by a shingle. Of each bin's value the low BITS bits are stored, packed. The likeness of two
fingerprints is the share of equal values, less the share expected by chance (bias correction).

Null texts count as empty. A text without words has the fingerprint "" ; it is like another such text (1.0) and unlike
all else (0.0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import runs, shuffle_partitions
from tallyspark.llm.shingles import mix, shingle_hashes

BINS, BITS, WORDS = 512, 4, 5
#: Texts of one step; its matrix of minima takes BINS * 8 bytes a text.
STEP = 512


def minima(texts: list[bytes], k: int = WORDS, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Densified bin minima of each text (rows), and which texts have words."""
    hashes, at = shingle_hashes(texts, k)
    low = np.full(len(texts) * bins, np.iinfo(np.uint64).max, np.uint64)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    cell = np.repeat(np.arange(len(texts)) * bins, np.diff(at)) + (hashes >> shift).astype(np.int64)
    np.minimum.at(low, cell, hashes)
    low = low.reshape(len(texts), bins)
    full = low != np.iinfo(np.uint64).max
    some = full.any(axis=1)
    row, col = np.nonzero(~full & some[:, None])
    attempt = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(row):
            attempt += np.uint64(1)
            probe = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempt * np.uint64(0xD1B54A32D192ED03)) >> shift).astype(np.int64)
            source = probe[col]
            hit = full[row, source]
            low[row[hit], col[hit]] = low[row[hit], source[hit]]
            row, col = row[~hit], col[~hit]
    return low, some


def codes(texts: list[bytes], k: int = WORDS, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of the minima, one byte each, and which texts have words."""
    out, some = np.zeros((len(texts), bins), np.uint8), np.zeros(len(texts), bool)
    for a, b in runs((len(t) + (1 << 20) // STEP for t in texts), 1 << 20):
        low, some[a:b] = minima(texts[a:b], k, bins)
        out[a:b] = (low & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return out, some


def pack(code: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Fingerprints as lower-case hex of the packed bits."""
    wide = np.unpackbits(code[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(code), -1)
    return [row.tobytes().hex() if s else "" for row, s in zip(np.packbits(wide, axis=1), some, strict=True)]


def unpack(fingerprints: list[str], bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    out, some = np.zeros((len(fingerprints), bins), np.uint8), np.array([bool(f) for f in fingerprints], bool)
    for i, f in enumerate(fingerprints):
        if f:
            flat = np.unpackbits(np.frombuffer(bytes.fromhex(f), np.uint8)).reshape(bins, bits)
            out[i] = np.packbits(np.pad(flat, ((0, 0), (8 - bits, 0))), axis=1)[:, 0]
    return out, some


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity, row by row, from 0 to 1."""
    chance = 2.0**-bits
    found = ((a == b).mean(axis=1) - chance) / (1 - chance)
    return np.where(some_a & some_b, np.clip(found, 0.0, 1.0), (some_a == some_b).astype(float))


def fingerprints(docs: DataFrame, k: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack(*codes(texts, k, bins, bits), bits), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.StringType())]))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, row, doc_id, text, halo): docs dealt by ranges of descending doc_id, so that each row's next one is in its part.

    The first row of each range is sent to the range before it too (halo), that of the first to the last. The ranges
    come from a sketch of doc_id whose size is the number of ranges; no window runs over all rows and each text is
    shuffled once. Null ids come last; rows with equal ids are ordered by a digest of their text (th), and an id of more rows
    than a range has is cut by that digest, too.
    """
    spark = docs.sparkSession
    parts = parts or 4 * shuffle_partitions(spark)
    lowest = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    # range i has the rows from cut i - 1 down to cut i: (c, None) ends the rows of the id c; an id that the sketch names m times
    # is cut m - 1 times more, at even digests
    cuts = [(c, t) for c, m in sorted(Counter(cuts or []).items(), reverse=True) for t in [*(-(2**63) + (j << 64) // m for j in range(1, m)), None]]
    ladder = F.lit(0)
    if cuts:
        ids, digests = (F.lit(list(x)).cast("array<bigint>") for x in zip(*cuts))
        ladder = F.size(F.filter(ids, lambda c, i: (c > F.col("k")) | ((c == F.col("k")) & (F.col("th") >= F.get(digests, i)))))
    ranged = rows.withColumn("part", ladder.cast("int"))
    first = ranged.groupBy("part").agg(F.max_by(F.struct("k", "th"), F.struct("k", -F.col("th").cast("decimal(20,0)"))).alias("h"))
    heads = {r["part"]: (r["h"]["k"], r["h"]["th"]) for r in first.collect()}  # a row for each range
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first range's head closes the last range
    if not order:
        return ranged.select(F.lit(0).alias("part"), "k", "th", "doc_id", "text", F.lit(False).alias("halo"))
    by_part = lambda found: F.element_at(F.lit([found.get(p, lowest) for p in range(len(cuts) + 1)]), F.col("part") + 1)
    is_head = (F.col("k") == by_part({p: h[0] for p, h in heads.items()})) & (F.col("th") == by_part({p: h[1] for p, h in heads.items()}))
    own = F.struct("part", F.lit(False).alias("halo"))
    copies = F.when(is_head, F.array(own, F.struct(by_part(before).cast("int").alias("part"), F.lit(True).alias("halo")))).otherwise(F.array(own))
    return ranged.select("k", "th", "doc_id", "text", F.explode(copies).alias("c")).select(F.col("c.part").alias("part"), "k", "th", "doc_id", "text", F.col("c.halo").alias("halo"))


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The edited text has the last half of the code points replaced by as many first ones of the next document, by
    descending doc_id; after the last comes the first. Repeated ids are ordered by a digest of their text, null ids come
    last. Very long texts are read whole; other columns, whatever their names, are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(RESULT)

    def emit(ids: list, texts: list[str]):
        """Rows of texts[:-1]; the last one is only the next of the one before."""
        raw = [t.encode() for t in texts]
        code, some = codes(raw)
        edited = [(t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode() for t, after in zip(texts, texts[1:])]
        ecode, esome = codes(edited)
        n = len(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:n], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array(pack(code[:n], some[:n]), pa.string()),
                pa.array(pack(ecode, esome), pa.string()),
                pa.array(likeness(code[:n], some[:n], ecode, esome)),
                pa.array(likeness(code[:n], some[:n], code[1:], some[1:])),
            ],
            schema=arrow,
        )

    def run(batches):
        ids, texts, part, halo_of = [], [], None, {}
        size = 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for p, doc_id, text, halo in zip(*cols, strict=True):
                if p != part:
                    if texts:
                        yield emit([*ids, None], [*texts, halo_of[part]])
                    ids, texts, size, part = [], [], 0, p
                if halo:  # sorted before the other rows of its part; several are equal
                    halo_of.setdefault(p, text)
                    continue
                if size > 1 << 21:
                    yield emit([*ids, None], [*texts, text])
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield emit([*ids, None], [*texts, halo_of[part]])

    rows = with_next(docs)
    dealt = rows.repartition(shuffle_partitions(docs.sparkSession), "part").sortWithinPartitions("part", F.desc("halo"), F.desc("k"), "th")
    return dealt.select("part", "doc_id", "text", "halo").mapInArrow(run, RESULT)
