"""Words and shingles of many texts at once, in numpy over Arrow's buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Words and shingles are
known by 64-bit hashes; texts are taken in slices of bounded size, so memory
follows the slice or the longest text, not the batch.
"""

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers, in place."""
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


@cache
def _trimmer() -> Callable:
    return getattr(ctypes.CDLL(None), "malloc_trim", None) or (lambda _: 0)


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


def lean(run):
    """``run`` over batches, after which the worker, which serves other tasks too, holds no more than it needs."""

    @wraps(run)
    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return leaner


def strings(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """As one string array with nulls made empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def buffers(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of the texts in them."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(texts) else raw[:0], at - at[0]


def slices(texts: pa.StringArray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``most`` bytes together, or one row that has more."""
    _, at = buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """``start`` and ``end`` byte of each word, its ``doc`` (row), and ``first``: n + 1 word offsets by row."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True  # texts do not run into each other
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        stop[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        total = int(length.sum())
        place = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        source = place + np.repeat(self.start, length)
        taken = self.data[source]
        powers = np.cumprod(np.full(int(length.max()), _BASE))
        value = ((LOWER[taken] if lower else taken).astype(np.uint64) + np.uint64(1)) * powers[place]
        return mixed(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64) * _MIX1)


def windows(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, first word) of each run of ``n`` words within a text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[: len(hashes) - n + 1] == words.doc[n - 1 :])
    keys = mixed(np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    total = np.full(len(at), np.uint64(n))
    for j in range(n):
        total += hashes[at + j] * keys[j]
    return mixed(total), words.doc[at], at


def shingles(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of each run of ``n`` words, repeats included; a text of fewer words is one shingle, one of none has none."""
    h, doc, _ = windows(words, hashes, n)
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        keys = mixed(np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
        for j in range(n - 1):
            has = words.count[short] > j
            own[has] += hashes[words.first[short[has]] + j] * keys[j]
        own = mixed(own + words.count[short].astype(np.uint64))
        h, doc = np.concatenate([h, own]), np.concatenate([doc, short])
    return h, doc
