"""Words of whole Arrow text columns as numpy arrays, without one Python object per word.

A word is a maximal run of characters other than space and U+0009..U+000D. Those are single bytes that never
occur inside a longer UTF-8 sequence, so all work is done on the bytes of a batch. Null texts count as empty.
Memory is bounded by ``SLICE`` bytes of text, or by the longest single text where that is longer.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once.
SLICE = 1 << 20
#: Bytes hashed at once.
PIECE = 1 << 17
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_random.integers(1, 2**62)) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _grown(which: int, base: int, n: int) -> np.ndarray:
    p = _powers[which]
    while len(p) < n:
        with np.errstate(over="ignore"):
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 2**64))])
    _powers[which] = p
    return p[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = SLICE):
    """Runs of rows with at most ``limit`` bytes (at least one row): first row, next run's first row, bytes, offsets."""
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (one entry more than rows)."""
    inside = ~SEPARATOR[data]
    full = offsets[1:] > offsets[:-1]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first], end[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run (in order, not overlapping), from running sums over pieces of the bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE)))
        base, s, e = int(starts[i]), starts[i:j] - starts[i], ends[i:j] - starts[i]
        n = int(e[-1])
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUE[data[base : base + n]] * _grown(0, _BASE, n), out=total[1:])
            out[i:j] = mix((total[e] - total[s]) * _grown(1, _INVERSE, n + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive values of ``h``; of all of them where there are fewer; none of none."""
    k = min(k, len(h))
    if not k:
        return h
    with np.errstate(over="ignore"):
        g = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            g = g * _MIX + h[j : len(h) - k + 1 + j]
        return mix(g + np.uint64(k))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values; faster than a hash table for the few values of one text."""
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def give_back() -> None:
    """Return freed memory to the system; workers live on between tasks and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
