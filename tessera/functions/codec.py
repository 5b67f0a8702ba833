"""Variable-length integers and gap coding: the sizes that an index would take in that form.

Parquet holds our postings; these serve the size statistic and whoever wants the bytes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = (1 << 32) - 1


def write_varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next place); (0, len(data)) where the number is cut off or too long."""
    value = 0
    for i in range(5):
        if at + i >= len(data):
            break
        value |= (data[at + i] & 0x7F) << (7 * i)
        if not data[at + i] & 0x80:
            return value & MOST, at + i + 1
    return 0, len(data)


def encode_sorted(values: Iterable[int]) -> bytes:
    out, last = bytearray(), 0
    for v in values:
        out += write_varint(v - last)
        last = v
    return bytes(out)


def decode_sorted(data: bytes, count: int, at: int = 0) -> tuple[list[int], int]:
    out, last = [], 0
    while len(out) < count and at < len(data):
        gap, at = read_varint(data, at)
        last = min(last + gap, MOST)
        out.append(last)
    return out, at


def encode_plain(values: Iterable[int]) -> bytes:
    return b"".join(map(write_varint, values))


def decode_plain(data: bytes, count: int, at: int = 0) -> tuple[list[int], int]:
    out = []
    while len(out) < count and at < len(data):
        v, at = read_varint(data, at)
        out.append(v)
    return out, at


def encode_block(postings: list[tuple[int, list[int]]]) -> bytes:
    """Documents, then frequencies, then each posting's positions."""
    head = encode_sorted(d for d, _ in postings) + encode_plain(len(p) for _, p in postings)
    return head + b"".join(encode_sorted(p) for _, p in postings)


def decode_block(data: bytes, count: int) -> list[tuple[int, list[int]]]:
    docs, at = decode_sorted(data, count)
    tfs, at = decode_plain(data, count, at)
    out = []
    for d, tf in zip(docs, tfs):
        positions, at = decode_sorted(data, tf, at)
        out.append((d, positions))
    return out


def varint_length(value: Column) -> Column:
    steps = [F.when(value >= 1 << (7 * i), 1).otherwise(0) for i in range(1, 5)]
    return F.lit(1) + steps[0] + steps[1] + steps[2] + steps[3]


def varint_lengths(values: np.ndarray) -> np.ndarray:
    return 1 + sum((values >= 1 << (7 * i)).astype(np.int64) for i in range(1, 5))


def positions_length(positions: Column) -> Column:
    """Bytes of an ascending array's gaps."""
    shifted = F.concat(F.array(F.lit(0)), F.slice(positions, 1, F.greatest(F.size(positions) - 1, F.lit(0))))
    return F.aggregate(F.zip_with(positions, shifted, lambda a, b: varint_length(a - b)), F.lit(0), lambda acc, x: acc + x)
