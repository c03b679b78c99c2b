"""Vectorised word and shingle hashing over Arrow text columns.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Words are hashed by a
random polynomial over their bytes modulo 2**64 and mixed; shingles are hashed from the
words' hashes. All work is numpy over slices of a quarter MB, which fit caches, so that
memory stays bounded whatever the batch; one document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = (_RNG.integers(1, 1 << 60, 1, dtype=np.uint64) * np.uint64(8) + np.uint64(5))[0]
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and all other ASCII that is neither letter nor digit.
MARKS = SPACE.copy()
MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(max(n, 64) * 2, _BASE))])
    return _powers


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values for each seed."""
    h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of documents first..first+len(counts); word i has hash hashes[i]; starts and lengths are bytes."""

    first: int
    data: np.ndarray
    doc_ends: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes together, one document at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def words(column: pa.Array, lower: bool = True, most: int = SLICE_BYTES, between: np.ndarray = SPACE) -> Iterator[Words]:
    table = _LOWER if lower else _BYTE
    everything, offsets = buffers(column)
    for first, last in slices(offsets, most):
        data = everything[offsets[first] : offsets[last]]
        ends = offsets[first + 1 : last + 1] - offsets[first]
        inside = ~between[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = ends[:-1][ends[:-1] < len(data)]
        begins[cuts] = inside[cuts]
        starts = np.flatnonzero(begins)
        if not len(starts):
            empty = np.zeros(0, np.int64)
            yield Words(first, data, ends, np.zeros(last - first, np.int64), np.zeros(0, np.uint64), empty, empty)
            continue
        stops = np.flatnonzero(np.append(begins[1:] | ~inside[1:], True) & inside) + 1
        lengths = stops - starts
        rank = np.cumsum(lengths) - lengths
        place = np.arange(rank[-1] + lengths[-1], dtype=np.int32) - np.repeat(rank.astype(np.int32), lengths)
        hashes = np.add.reduceat(table[data[inside]] * powers(int(lengths.max()) + 1)[place], rank)
        counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
        yield Words(first, data, ends, counts, mix(hashes + lengths.astype(np.uint64)), starts, lengths)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents, one after another in text order, and how many each document has.

    A document with fewer than `size` words, but some, has its whole sequence as one shingle.
    """
    n, begins = len(w.hashes), w.offsets[:-1]
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        full += w.hashes[k : n - size + 1 + k] * _PLACE[k] if len(full) else 0
    counts = np.where(w.counts >= size, w.counts - size + 1, np.minimum(w.counts, 1))
    ends = np.cumsum(counts)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint64)
    at = np.arange(len(out)) + np.repeat(begins - (ends - counts), counts)
    long = np.repeat(w.counts >= size, counts)
    out[long] = full[at[long]]
    for k in range(1, size):
        some = np.flatnonzero(w.counts == k)
        out[ends[some] - 1] = sum(w.hashes[begins[some] + j] * _PLACE[j] for j in range(k)) + _PLACE[size + k]
    return mix(out), counts


def sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, sorted sets of distinct shingles one after another, their sizes), slice by slice."""
    for w in words(column):
        h, counts = shingles(w, size)
        ends = np.cumsum(counts)
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            h[a:b].sort()
        owner = np.repeat(np.arange(len(counts)), counts)
        keep = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
        yield w.first, h[keep], np.bincount(owner[keep], minlength=len(counts))


def run_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of neighbouring runs of values."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of values as binary rows."""
    offsets = np.concatenate([[0], np.cumsum(counts * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def shared(x, y) -> int:
    """How many values two sorted binary sets of 64-bit values have in common."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    i = np.searchsorted(y, x)
    i[i == len(y)] = 0
    return int((y[i] == x).sum()) if len(y) else 0
