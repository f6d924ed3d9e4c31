"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with word marks) and itself, hashed to BUCKETS rows of an embedding
table; a window of WINDOW words is the mean of its subwords' vectors, and a linear softmax over it gives the
probability of the label 1. Misspelt words share most n-grams with the words they come from.

A few toxic words in a long text must not be averaged away: a text is read in windows that overlap by half, all of it,
and its score is that of its worst window. In training, a text of label 1 counts by its then worst window, one of label
0 by its worst window and some others.

Null texts count as empty; texts without words score 0. Repeated rows give a row each; very long texts are scored whole;
columns but doc_id and text are not read. With rows of one label only, all scores are 0.

Training is bounded by documented parameters: at most SAMPLE labelled ids, half of them for either label, those with the
smallest hash, and of them the texts of at most LONG characters, whole, one for each id; equal texts count once. So the
driver takes at most SAMPLE * LONG characters.
"""

from __future__ import annotations

import io
import re
import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import cache, give_back, map_batches, runs
from tallyspark.llm.shingles import mix

BUCKETS, DIM, WINDOW, SAMPLE, LONG = 1 << 16, 8, 4, 3000, 30_000
GRAMS = (3, 4, 5)
WORD = re.compile(r"\w+(?:['’*@$!0-9]+\w+)*")
#: Words whose score a worker remembers.
REMEMBERED = 800_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the n-grams of each word with marks, and of the word itself; where each word's rows begin."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in marked], np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    owner = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(ends, size) - np.arange(len(code))  # characters up to the word's end
    found, of = [], []
    with np.errstate(over="ignore"):
        power = np.full(int(size.max(initial=1)), np.uint64(0x9E3779B97F4A7C15))
        power[0] = 1
        within = np.arange(len(code)) - np.repeat(begins, size)
        found.append(np.add.reduceat(code * np.cumprod(power)[within], begins) if len(code) else code)
        of.append(np.arange(len(marked)))
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            found.append(sum(code[at + i] * _PLACE[i] for i in range(n)) + np.uint64(n))
            of.append(owner[at])
        rows = (mix(np.concatenate(found)) % np.uint64(BUCKETS)).astype(np.int32)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return rows[order], np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(marked)))))


def chunks(n: int, most: int = 20_000) -> list[tuple[int, int]]:
    return [(a, min(n, a + most)) for a in range(0, n, most)]


def subwords_of_many(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """subwords(), some words at a time."""
    parts = [subwords(words[a:b]) for a, b in chunks(len(words))]
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(begin) for _, begin in parts)])
    return np.concatenate([np.zeros(0, np.int32), *(rows for rows, _ in parts)]), np.concatenate(([0], np.cumsum(sizes)))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many each, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many words, one after another: begin, end and text of the windows of WINDOW words that overlap by half;
    a text's last one ends with it, and texts without words have none."""
    begin = np.cumsum(sizes) - sizes
    count = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // (WINDOW // 2)) + 1, (sizes > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = begin[owner] + np.minimum(k * (WINDOW // 2), np.maximum(sizes - WINDOW, 0)[owner])
    return first, first + np.minimum(sizes, WINDOW)[owner], owner


@dataclass
class Model:
    """Only the difference of the two classes' logits matters, so a subword has one number, table @ weights."""

    table: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM
    bias: float

    def __post_init__(self):
        self.logit = (self.table @ self.weights).astype(np.float64)
        self.forget()

    def forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.values = np.zeros((1024, 2))  # by word number: summed logit, subwords

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, table=self.table.astype(np.float32), weights=self.weights, bias=self.bias)
        return out.getvalue()

    @staticmethod
    def unpack(raw: bytes) -> Model:
        x = np.load(io.BytesIO(raw))
        return Model(x["table"], x["weights"], float(x["bias"]))

    def learn_words(self, words: list[str]) -> None:
        """Remembers the summed logit and the number of subwords of words that are new."""
        rows, begin = subwords(words)
        n, more = len(self.memory), len(words)
        if n + more > len(self.values):
            self.values = np.concatenate((self.values, np.zeros((n + 2 * more, 2))))
        self.values[n : n + more, 0] = np.add.reduceat(self.logit[rows], begin[:-1])
        self.values[n : n + more, 1] = np.diff(begin)
        self.memory.update(zip(words, range(n, n + more)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of the label 1 for each text."""
        out = np.zeros(len(texts))
        if not self.weights.any():
            return out
        for a, b in runs(map(len, texts), 1 << 20):
            out[a:b] = self._scores(texts[a:b])
        return out

    def _scores(self, texts: list[str]) -> np.ndarray:
        read = [words_of(t) for t in texts]
        stream = list(chain.from_iterable(read))
        if len(self.memory) >= REMEMBERED:
            self.forget()
        if new := [w for w in dict.fromkeys(stream) if w not in self.memory]:
            self.learn_words(new)
        values = self.values[np.fromiter(map(self.memory.__getitem__, stream), np.int64, len(stream))]
        sums = np.zeros((len(stream) + 1, 2))
        np.cumsum(values, axis=0, out=sums[1:])
        first, last, owner = windows(np.array([len(x) for x in read], np.int64))
        part = sums[last] - sums[first]
        out = np.zeros(len(texts))
        if len(owner):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            worst = np.maximum.reduceat(part[:, 0] / part[:, 1], starts) + self.bias
            out[owner[starts]] = 1 / (1 + np.exp(-np.clip(worst, -40, 40)))
        return out


def train(texts: list[str], labels: list[int], epochs: int = 12, least_steps: int = 600, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent on embeddings, weights and bias together, by batches of windows."""
    rng = np.random.default_rng(seed)
    table, weights, bias = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), np.zeros(DIM), 0.0
    if len(set(labels)) < 2:
        return Model(table, weights, bias)
    weights = rng.normal(0, 1, DIM)
    # words as numbers; a word's subwords are rows[begin[w] : begin[w + 1]]
    number: dict[str, int] = {}
    read = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    rows, begin = subwords_of_many(list(number))
    stream, at = np.concatenate(read), np.concatenate(([0], np.cumsum([len(x) for x in read])))
    if not len(stream):
        return Model(table, np.zeros(DIM), 0.0)
    first, last, owner = windows(np.diff(at))
    label = np.array(labels)
    size = np.diff(begin)
    length = np.concatenate(([0], np.cumsum(size[stream])))
    sizes = length[last] - length[first]
    del length
    positive, negative = np.flatnonzero(label[owner] == 1), np.flatnonzero(label[owner] == 0)
    if not len(positive) or not len(negative):
        return Model(table, np.zeros(DIM), 0.0)

    def margins(which: np.ndarray) -> np.ndarray:
        logit = table @ weights
        word = np.concatenate([np.add.reduceat(logit[rows[begin[a] : begin[b]]], begin[a:b] - begin[a]) for a, b in chunks(len(size))])
        sums = np.concatenate(([0.0], np.cumsum(word[stream])))
        return (sums[last[which]] - sums[first[which]]) / sizes[which] + bias

    # before the first epoch a window's margin is that of its most telling word: the log odds of texts that have it
    has = np.unique(np.repeat(np.arange(len(texts)), np.diff(at)) * len(number) + stream)
    seen = [np.bincount((has % len(number))[label[has // len(number)] == y], minlength=len(number)) for y in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (label.sum() + 1)) - np.log((seen[0] + 0.5) / (len(label) - label.sum() + 1))
    telling = np.maximum.reduceat(np.append(odds[stream], -np.inf), np.stack([first, last], axis=1).ravel())[::2]
    del has, seen, number, read

    def worst(which: np.ndarray) -> np.ndarray:
        """Of each text its window of the greatest margin."""
        m = margins(which)
        order = np.lexsort((which, -m, owner[which]))
        return which[order][np.concatenate(([True], np.diff(owner[which][order]) != 0))]

    texts_of_one = min(len(set(owner[positive])), len(set(owner[negative])))
    epochs = max(epochs, -(-least_steps * 32 // (4 * texts_of_one)))  # few texts are read more often
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        yes = worst(positive)
        if epoch < epochs // 3:  # all windows nearly as telling as their text's most telling one
            most = np.zeros(len(label))
            np.maximum.at(most, owner[positive], telling[positive])
            yes = positive[telling[positive] >= most[owner[positive]] - 0.5]
        no = np.unique(np.concatenate([worst(negative), rng.choice(negative, min(len(negative), 2 * len(yes)), replace=False)]))
        chosen = rng.permutation(np.concatenate([yes, no]))
        share = np.where(label[owner[chosen]] == 1, len(chosen) / (2 * len(yes)), len(chosen) / (2 * len(no)))
        for i in range(0, len(chosen), 32):
            which = chosen[i : i + 32]
            words = stream[ranges(first[which], last[which] - first[which])]
            own = rows[ranges(begin[words], size[words])]
            bag = np.repeat(np.arange(len(which)), sizes[which])
            mean = np.add.reduceat(table[own], np.cumsum(sizes[which]) - sizes[which]) / sizes[which][:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ weights + bias, -40, 40)))
            error = (p - label[owner[which]]) * share[i : i + 32]
            np.add.at(table, own, -step * (error / sizes[which])[bag][:, None] * weights * 4)
            weights -= step / len(which) * (error @ mean)
            bias -= step / len(which) * error.sum()
    del rows, stream, first, last, owner, sizes, telling
    give_back()
    return Model(table, weights, float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, allowed=None, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """At most sample labelled texts of at most LONG characters, half of it for either label, by the smallest hash of their id."""
    rows = labels.where("toxic is not null and doc_id is not null")
    if allowed is not None:
        rows = rows.where(allowed)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    # TakeOrdered: each task sends the driver at most sample / 2 ids
    picked = [rows.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(sample // 2) for y in (0, 1)]
    ids = {r["doc_id"]: r["toxic"] for part in picked for r in part.collect()}
    if not ids:
        return []
    # the ids are a filter of bounded size, so that labelled texts are read in one scan and no text is shuffled
    texts = docs.where(F.col("doc_id").isin(list(ids)) & (F.length("text") <= LONG)).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return sorted({(r["text"], ids[r["doc_id"]]) for r in texts})


_models: dict[str, Model] = cache()


def model_of(key: str, sent) -> Model:
    """One worker's model of a broadcast, made once."""
    if key not in _models:
        _models.clear()
        _models[key] = Model.unpack(sent.value)
    return _models[key]


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs (doc_id, text) with score and predicted. The model, of fixed size, is broadcast."""
    spark = docs.sparkSession
    sent, key = spark.sparkContext.broadcast(model.pack()), uuid.uuid4().hex
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batch: pa.RecordBatch) -> dict:
        found = model_of(key, sent).scores([x or "" for x in batch.column(1).to_pylist()])
        return {"doc_id": batch.column(0), "score": found, "predicted": [int(x >= threshold) for x in found]}

    return map_batches(docs.select("doc_id", "text"), run, schema)


def held_out(doc_id):
    """Rows that labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1
