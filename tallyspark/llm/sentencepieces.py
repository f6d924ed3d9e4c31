"""SentencePiece encoding and decoding with the pieces of a model file.

An Aho-Corasick automaton over the pieces reads a text once; each match that its output links name, a piece that ends
at this position, relaxes the position's best score (Viterbi over the sum of the pieces' log-probabilities). The best path
is the encoding. The scores of a unigram model's file are log-probabilities. Those of a merge model are the ranks of its
merges, the earlier the more frequent; their log-probabilities are those of Zipf's law over ranks (ZIPF), so nothing is
trained, and ids may differ from those of merging in rank order. A position that no piece reaches takes the character before it as unknown, which becomes byte pieces if the
model has them.

No piece but runs of blanks has a blank (U+2581) after another character, which load_model() checks; so a best path
never crosses the start of a run of blanks and the texts between are encoded one by one and remembered. Among equally
good paths, the one whose last piece is longest counts, as it does position by position.

Null texts count as empty; an empty text has no pieces. Texts in the model's own normal form ("identity") only. Repeated
rows give a row each; very long texts are encoded whole; columns but doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspark.llm.common import cache, map_batches

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: A piece of rank r has a probability in proportion to 1 / (r + ZIPF) (Mandelbrot's form of the law).
ZIPF, MERGES = 2.7, 2
#: Remembered words of a worker, about 150 bytes each.
REMEMBERED = 800_000


def _fields(raw: bytes):
    """(number, value) of a protobuf message; value is an int, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    charsmap: bytes = b""
    memory: dict[str, bytes] = field(default_factory=dict)
    rare: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        import ahocorasick

        # what each piece decodes to, one after another
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(BLANK, " ").encode() for p, _, kind in self.pieces]
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes_at = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        usable = [(p, s, i) for i, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)]
        low = min((s for _, s, i in usable if self.pieces[i][2] == NORMAL), default=0.0)
        high = max((s for _, s, i in usable if self.pieces[i][2] == NORMAL), default=0.0)
        self.singles = {p for p, _, _ in usable if len(p) == 1}
        self.unknown_score = low - UNKNOWN_PENALTY
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p, _, _ in usable):
            raise ValueError("pieces with a blank after another character are not supported")
        if self.charsmap:
            raise ValueError("models that rewrite characters are not supported")
        self.automaton = ahocorasick.Automaton()
        for p, s, i in usable:
            # a user's own piece beats any sequence of others, as in the library
            self.automaton.add_word(p, (len(p), s if self.pieces[i][2] == NORMAL else len(p) * high - 0.1, i))
        self.automaton.make_automaton()

    def viterbi(self, text: str) -> bytes:
        """The best path over one text, without normalisation or memory, as unsigned 32-bit ids."""
        n, low = len(text), float("-inf")
        score, step = [0.0] + [low] * n, [(0, 0)] * (n + 1)
        settled = 0
        known = self.singles.issuperset(text)
        for end, (size, s, i) in self.automaton.iter(text):  # by end, longest first: a shorter piece must be better
            end += 1
            if not known and settled < end - 1:
                self._unknown(text, score, step, settled, end - 1)
                settled = end - 1
            total = score[end - size] + s
            if total > score[end]:
                score[end], step[end] = total, (size, i)
        if not known:
            self._unknown(text, score, step, settled, n)
        out, at = [], n
        while at:
            size, i = step[at]
            at -= size
            if i >= 0:
                out.append(i)
            elif self.bytes_at:
                out.extend(self.bytes_at[b] for b in reversed(text[at : at + 1].encode()))
            elif not (out and out[-1] == self.unknown):  # unknown neighbours are one piece
                out.append(self.unknown)
        return array("I", out[::-1]).tobytes()

    def _unknown(self, text: str, score: list, step: list, a: int, b: int) -> None:
        """Offers the unknown character as the last step to each of the positions a + 1 to b."""
        for end in range(a + 1, b + 1):
            if text[end - 1] not in self.singles and (total := score[end - 1] + self.unknown_score) > score[end]:
                score[end], step[end] = total, (1, -1)

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", BLANK) if self.escape else text

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit integers."""
        plain = self.dummy_prefix and self.escape and not self.squeeze
        if plain and text and text[0] != " " and "  " not in text and BLANK not in text:
            # each word has one blank before it: the added one, or its own
            words, before = text.split(" "), BLANK
        else:
            words, before = re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", self.normal(text)), ""
        known = self.memory if before else self.rare
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32)
        except KeyError:
            pass
        if len(known) >= REMEMBERED:
            known.clear()
        more = {w: self.viterbi(before + w) for w in set(words) if w not in known}
        known.update((w, ids) for w, ids in more.items() if len(w) <= 64)
        return np.frombuffer(b"".join(more[w] if w in more else known[w] for w in words), np.uint32)

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, runs of byte pieces as UTF-8, blanks back, without the added first one."""
        ids = np.asarray(ids, np.int64)
        size = self.sizes[ids]
        if not len(ids):
            return ""
        ends = np.cumsum(size)
        place = np.repeat(self.starts[ids] - ends + size, size) + np.arange(ends[-1])
        text = self.blob[place].tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def by_rank(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """The pieces of a merge model with log-probabilities for ranks, in steps of 2 ** -20: sums of such numbers are exact, so
    paths with the same pieces in another order tie wherever a text is cut."""
    ranks = [-s for _, s, kind in pieces if kind == NORMAL]
    total = math.log(sum(1 / (r + ZIPF) for r in ranks)) if ranks else 0.0
    step = lambda x: round(x * 2**20) / 2**20
    return [(p, step(-math.log(-s + ZIPF) - total) if kind == NORMAL else s, kind) for p, s, kind in pieces]


def parse_model(raw: bytes) -> Model:
    """A model from the bytes of its file."""
    pieces, settings, merges = [], {}, False
    for number, value in _fields(raw):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            merges = dict(_fields(value)).get(3) == MERGES
        elif number == 3:
            settings = dict(_fields(value))
    return Model(by_rank(pieces) if merges else pieces, bool(settings.get(3, 1)), bool(settings.get(4, 1)), bool(settings.get(5, 1)), settings.get(2, b""))


_loaded: dict[str, Model] = cache()


def load_model(path: str) -> Model:
    """The model of a file that every executor has, read once by each worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = parse_model(f.read())
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch) -> dict:
        model = load_model(path)
        return {"doc_id": batch.column(0), "ids": [model.encode(x or "").astype(np.int32) for x in batch.column(1).to_pylist()]}

    return map_batches(docs.select("doc_id", "text"), run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of encoded (doc_id, ids); null ids count as none."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batch: pa.RecordBatch) -> dict:
        model = load_model(path)
        return {"doc_id": batch.column(0), "text": [model.decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), run, schema)


def piece_report(docs: DataFrame, path: str) -> DataFrame:
    """Per row: n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), n_byte_pieces, and whether decoding gives the text back."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_pieces", "ids_crc32", "n_byte_pieces")], T.StructField("round_trip", T.BooleanType())])

    def run(batch: pa.RecordBatch) -> dict:
        model = load_model(path)
        is_byte = np.array([kind == BYTE for _, _, kind in model.pieces])
        out = {f.name: [] for f in schema}
        out["doc_id"] = batch.column(0)
        for text in batch.column(1).to_pylist():
            ids = model.encode(text or "")
            out["n_pieces"].append(len(ids))
            out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
            out["n_byte_pieces"].append(int(is_byte[ids].sum()))
            out["round_trip"].append(model.decode(ids) == (text or ""))
        return out

    return map_batches(docs.select("doc_id", "text"), run, schema)
