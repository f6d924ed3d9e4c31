"""Language identification by compression.

Each language has a zstandard dictionary of raw content, its training texts. A text is compressed with each
dictionary, in blocks of BLOCK bytes up to its end, and the language whose blocks are smallest together is chosen. The
score is the share of that language if each byte less counts as TRUST bits of evidence; a text whose runner-up needs
less than MARGIN more bytes (relative) than the choice is rejected.

Letters are compared in lower case. A null text, and one without letters, is "und" with score 0 and rejected. Ties go
to the first language by name. Without training texts every text is "und". Repeated rows give a row each; very long texts
are compressed block by block to their end; columns but doc_id, text and lang are not read.

Training is bounded by documented parameters: of each language at most SAMPLE rows of SHORT to LONG characters, those with
the smallest hash of their id. The texts of these rows are taken whole, and the dictionary holds all of them, equal texts
once: at most SAMPLE * LONG characters.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import cache, map_batches

SAMPLE, SHORT, LONG, BLOCK, LEVEL = 100, 20, 2000, 2048, 5
MARGIN, TRUST = 0.005, 0.5
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


class Identifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(n for n, d in dictionaries.items() if len(d) >= 8)
        self.packers = []
        for n in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode()
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(pack(b)) for b in blocks) for pack in self.packers]

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the score, and whether the text is rejected."""
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        size = np.array(self.sizes(text), float)
        best = int(size.argmin())
        share = 2.0 ** (-TRUST * np.minimum(size - size[best], 2000))
        second = np.delete(size, best).min(initial=np.inf)
        return self.names[best], float(1 / share.sum()), bool(second < (1 + MARGIN) * size[best])


def dictionaries(docs: DataFrame, allowed=None, sample: int = SAMPLE) -> dict[str, bytes]:
    """Each language's dictionary, from at most sample rows of it (a bound that doesn't grow with docs)."""
    rows = docs.where(F.col("lang").isNotNull() & F.length("text").between(SHORT, LONG))
    if allowed is not None:
        rows = rows.where(allowed)
    # the limit of each language is applied within tasks before rows are shuffled (WindowGroupLimit)
    few = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), "text").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).where(F.col("k") <= sample)
    parts: dict[str, list[str]] = {}
    for r in few.orderBy("lang", F.desc("k")).collect():
        parts.setdefault(r["lang"], []).append(r["text"].lower())
    return {lang: "\n".join(dict.fromkeys(texts)).encode() for lang, texts in parts.items()}


_identifiers: dict[str, Identifier] = cache()


def identify(docs: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)  # at most SAMPLE * LONG characters a language
    key = uuid.uuid4().hex
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batch: pa.RecordBatch) -> dict:
        own = identifier(key, sent)
        found = [own.identify(x) for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "rejected": [x[2] for x in found]}

    return map_batches(docs.select("doc_id", "text"), run, schema)


def identifier(key, sent) -> Identifier:
    """One worker's identifier of a broadcast, made once."""
    if key not in _identifiers:
        _identifiers.clear()
        _identifiers[key] = Identifier(sent.value)
    return _identifiers[key]


def held_out(doc_id):
    """Rows that languages are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2
