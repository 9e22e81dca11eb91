"""Words of whole texts as numpy arrays, for work inside Spark tasks.

A batch of texts is one byte buffer with offsets.  Words are found by a table of bytes, which is
exact for UTF-8 as all separators are ASCII, and hashed to 64 bits eight bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import SparkSession

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACE
#: Words of letters and digits; every byte of a character outside ASCII counts as one.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[0x30:0x3A] = WORDLIKE[0x41:0x5B] = WORDLIKE[0x61:0x7B] = WORDLIKE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=U)
K1, K2, K3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * K3
    h = (h ^ (h >> U(29))) * K2
    return h ^ (h >> U(32))


class Texts:
    """Texts of one Arrow column as ``data`` and ``offsets``; nulls are empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not pa.types.is_large_binary(column.type):
            column = column.cast(pa.binary()).cast(pa.large_binary())
        if column.null_count:
            column = pc.fill_null(column, b"")
        _, offsets, data = column.buffers()
        self.n = len(column)
        ends = np.frombuffer(offsets, np.int64) if self.n else np.zeros(1, np.int64)
        ends = ends[column.offset : column.offset + self.n + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.offsets = ends - ends[0]
        self.data = whole[ends[0] : ends[-1]]
        if lower:
            self.data = LOWER[self.data]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words:
    """Words of ``texts``: byte positions ``start`` and ``end``, and ``first``, where each text's begin."""

    def __init__(self, texts: Texts, table: np.ndarray):
        self.texts = texts
        inside = table[texts.data] if len(texts.data) else np.zeros(0, bool)
        opens, closes = inside.copy(), inside.copy()
        if len(inside):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edges = texts.offsets[:-1][texts.offsets[:-1] < texts.offsets[1:]]
            opens[edges] = inside[edges]
            last = texts.offsets[1:][texts.offsets[:-1] < texts.offsets[1:]] - 1
            closes[last] = inside[last]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, texts.offsets)
        self.count = np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        data, at, left = self.texts.data, self.start.copy(), self.end - self.start
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        chunks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        h = (left.astype(U) + U(seed)) * K1
        live = np.arange(len(at))
        for _ in range(8):
            h[live] = mix(h[live] ^ (chunks[at[live]] & KEEP[np.minimum(left[live], 8)]))
            at[live] += 8
            left[live] -= 8
            live = live[left[live] > 0]
        for i in live.tolist():  # what is left of words of more than 64 bytes
            h[i] = long_hash(h[i], data[at[i] : self.end[i]])
        return h

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether they all stand in its text."""
        n = len(hashes)
        out = np.zeros(n, U)
        if n >= size:
            h = np.full(n - size + 1, size, U)
            for j in range(size):
                h = (h ^ hashes[j : n - size + 1 + j]) * K1
                h ^= h >> U(31)
            out[: n - size + 1] = mix(h)
        room = np.repeat(self.first[1:], self.count) - np.arange(n)
        return out, room >= size


def long_hash(h: np.uint64, rest: np.ndarray) -> np.uint64:
    """Goes on hashing one long word: its 8-byte pieces weighted by place, then mixed."""
    n = -(-len(rest) // 8)
    padded = np.zeros(8 * n, np.uint8)
    padded[: len(rest)] = rest
    pieces = mix(padded.view("<u8") + np.arange(1, n + 1, dtype=U) * K1)
    return mix(np.array([h ^ pieces.sum(dtype=U) ^ U(len(rest))], U))[0]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))] if len(values) else values


def batches(found: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``, or of one row."""
    for batch in found:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held + size > limit and i > begin:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def slices(array: pa.Array, limit: int = 2 << 20) -> Iterator[pa.Array]:
    """``array`` in pieces of at most ``limit`` bytes, or of one value."""
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held + size > limit and i > begin:
            yield array.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(array):
        yield array.slice(begin)


class Shared:
    """A broadcast value of one of this package's classes, readable where the package is not installed.

    A plain array of bytes is sent and read as it is, so that tasks hold it once.
    """

    def __init__(self, spark: SparkSession, value):
        self._plain = isinstance(value, np.ndarray) and value.dtype == np.uint8 and value.ndim == 1
        self._sent = spark.sparkContext.broadcast(value.tobytes() if self._plain else cloudpickle.dumps(value))
        self._own = None

    def __getstate__(self):
        return {"_plain": self._plain, "_sent": self._sent, "_own": None}

    @property
    def value(self):
        if self._own is None:
            sent = self._sent.value
            self._own = np.frombuffer(sent, np.uint8) if self._plain else cloudpickle.loads(sent)
        return self._own


def joined(words: Words, keep: np.ndarray) -> Iterator[bytes]:
    """The kept words of each text, joined by one space.  White-space words only."""
    data, size = words.texts.data, len(words.texts.data)
    edges = np.zeros(size + 2, np.int8)
    edges[words.start[keep]] += 1
    np.subtract.at(edges, np.minimum(words.end[keep] + 1, size + 1), 1)  # with the separator behind
    inside = np.cumsum(edges, dtype=np.int8)[:size] > 0
    offsets = words.texts.offsets
    kept = np.where(SPACE[data], np.uint8(0x20), data)
    # a word that ends its text has no separator of its own: the next byte is another text's
    last = words.end[keep][np.isin(words.end[keep], offsets[1:])]
    last = last[last < size]
    opens = np.zeros(size + 1, bool)
    opens[words.start[keep]] = True
    inside[last[~opens[last]]] = False
    for i in range(words.texts.n):
        a, b = offsets[i], offsets[i + 1]
        yield kept[a:b][inside[a:b]].tobytes().rstrip(b" ")
