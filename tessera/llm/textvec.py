"""Column-at-a-time text work on Arrow batches with numpy.

A batch of texts is one byte buffer with offsets; words are byte ranges in it and
their 64-bit hashes come from prefix sums, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` text bytes each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    at, total = 0, np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    return spread(pc.fill_null(array, "").cast(pa.large_string()))


def utf8_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of a binary column."""
    return spread(pc.fill_null(array, b"").cast(pa.large_binary()))


def spread(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, int(n).bit_length())
        table = np.ones(size, np.uint64)
        have = 1
        while have < size:
            table[have : 2 * have] = table[:have] * np.uint64(pow(base, have, 1 << 64))
            have *= 2
        if size <= 1 << 23:
            _powers[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any byte range of a buffer from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(pow(BASE, -1, 1 << 64), n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, length: int) -> np.ndarray:
        """Of every range of this length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """Lookup table that is True for the bytes in the given inclusive spans."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside`` bytes, and the first word of each row.

    A run never crosses a row. The third array has one more entry than rows.
    """
    n = len(buf)
    within = inside[buf]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    open_ = within.copy()
    open_[1:] &= ~within[:-1] | first[1:n]
    close = within.copy()
    close[:-1] &= ~within[1:] | first[1:n]
    starts, ends = np.flatnonzero(open_), np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(starts, offsets)
