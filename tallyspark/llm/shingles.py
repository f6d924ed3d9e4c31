"""Word shingles of many texts at once, hashed to 64 bits with numpy.

Words are runs of bytes other than blank and \\t..\\r, after A-Z became a-z; since those are all ASCII, working on
UTF-8 bytes equals working on code points. A word's hash is a polynomial over random byte values modulo 2**64, read
from one running sum per block of texts, then mixed.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] | np.uint64(1)
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        with np.errstate(over="ignore"):
            tables = []
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > 4 * BLOCK:  # a single huge text: do not keep its tables
            return tables
        _powers[:] = tables
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and where each text's words begin (len(texts) + 1 entries)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    gap = _IS_GAP[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
        words = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return words, np.concatenate(([0], np.searchsorted(begin, ends)))


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle of k words in order, repeats included, and where each text's shingles begin.

    A text of 1 to k-1 words has one shingle, all its words; one without words has none.
    """
    words, at = word_hashes(texts)
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    starts = np.concatenate(([0], np.cumsum(count)))
    with np.errstate(over="ignore"):
        padded = np.concatenate((words, np.zeros(k, np.uint64)))
        rolled = padded[: len(words)] * _PLACE[0]
        for i in range(1, k):
            rolled = rolled + padded[i : len(words) + i] * _PLACE[i]
        first = np.repeat(at[:-1] - starts[:-1], count) + np.arange(starts[-1])
        out = rolled[first]
        for d in np.flatnonzero((n > 0) & (n < k)):
            out[starts[d]] = (words[at[d] : at[d + 1]] * _PLACE[: n[d]]).sum(dtype=np.uint64) + np.uint64(n[d])
        return mix(out + np.uint64(k)), starts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    from tallyspark.llm.common import runs

    out = []
    for a, b in runs(map(len, texts), BLOCK):
        hashes, at = shingle_hashes(texts[a:b], k)
        for i in range(b - a):
            own = np.sort(hashes[at[i] : at[i + 1]])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return out
