"""Texts of an Arrow column as arrays: words, their hashes and characters, without Python strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_P = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longest word that is hashed in one go, and bytes of words that are.
_PART, _STEP = 1 << 14, 1 << 20
_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_PART - 1, _P & MASK, np.uint64))])


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts with a space before each and one at the end, and where each text's
    space stands (one more than texts). Nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string()))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return np.concatenate([data, np.array([32], np.uint8)]), offsets - offsets[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text its first word (one more than texts)."""
    space = _IS_SPACE[data]
    edge = np.diff(space.view(np.int8))
    starts, ends = np.nonzero(edge == -1)[0] + 1, np.nonzero(edge == 1)[0] + 1
    return starts, ends, np.searchsorted(starts, at)


def _polynomial(part: np.ndarray) -> int:
    return int(((part.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(part)]).sum())


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; memory is bounded whatever the words' lengths."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    sizes = ends - starts
    for i in np.flatnonzero(sizes > _PART):
        total, power = 0, 1
        for lo in range(int(starts[i]), int(ends[i]), _PART):
            total += power * _polynomial(data[lo : min(lo + _PART, int(ends[i]))])
            power = power * pow(_P & MASK, _PART, 1 << 64) & MASK
        out[i] = np.uint64((total + int(sizes[i])) & MASK)
    few = np.flatnonzero(sizes <= _PART)
    bytes_before = np.cumsum(sizes[few])
    edges = np.unique(np.concatenate([[0], np.searchsorted(bytes_before, np.arange(_STEP, int(bytes_before[-1]) if len(few) else 0, _STEP)), [len(few)]]))
    for a, b in zip(edges, edges[1:]):
        rows = few[a:b]
        s, size = starts[rows], sizes[rows]
        first = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(first, size)
        value = (data[np.repeat(s, size) + inside].astype(np.uint64) + np.uint64(1)) * _POWERS[inside]
        out[rows] = np.add.reduceat(value, first) + size.astype(np.uint64)
    return mix(out)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row, and each text's first (one more than texts). A text of fewer
    words has the one shingle of all its words; one of none has none."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    where = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1] - where[:-1], count) + np.arange(where[-1])
    limit = np.repeat(first[1:], count)
    out = np.zeros(int(where[-1]), np.uint64)
    for j in range(k):
        at = begin + j
        there = at < limit
        out = out * np.uint64(_P & MASK) + np.where(there, h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else 0, np.uint64(0))
    return mix(out), where
