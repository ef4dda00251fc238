"""Vectorised word and n-gram hashing over Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def row_slices(column: pa.Array, most: int = 1 << 20):
    """Spans (start, length) of rows with about `most` bytes of text, or one longer text, each."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.float64)))
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0.0
        end = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, end - at
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after another, and where each text starts (and the last ends); a null text is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word (run of anything but ASCII white space)."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[offsets <= len(data)]] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_made = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; made once for the longest slice."""
    if len(_made[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            found = np.full(n, base, np.uint64)
            found[0] = 1
            _made[k] = np.multiply.accumulate(found)
    return _made[0][:n], _made[1][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: differences of one running polynomial sum over the bytes."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64)
    power, down = _powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def features(column: pa.Array, buckets: int):
    """Bucket and document of every hashed word and pair of neighbouring words, for one slice of rows after another."""
    for at, length in row_slices(column):
        data, offsets = utf8(column.slice(at, length))
        starts, ends, doc = words(data, offsets)
        h = word_hashes(data, starts, ends)
        together = doc[1:] == doc[:-1]
        pairs = mix(h[:-1] * np.uint64(3) + h[1:] + np.uint64(1))[together]
        found = np.concatenate([h, pairs]) % np.uint64(buckets)
        yield found.astype(np.int64), np.concatenate([doc, doc[1:][together]]) + at
