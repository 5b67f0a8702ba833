"""Elias-Fano sequences in flat arrays, searched many places at a time."""

from __future__ import annotations

import numpy as np

_L8, _H8 = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_55, _33, _0F = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
_1, _2, _3, _4, _6, _8, _56, _63, _64 = (np.uint64(x) for x in (1, 2, 3, 4, 6, 8, 56, 63, 64))
#: Place of the nth one of a byte, at 8 * byte + n.
_IN_BYTE = np.array([[*[i for i in range(8) if byte >> i & 1], *[0] * 8][:8] for byte in range(256)], np.uint8).ravel()


def select_in_word(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth (from 0) one in each 64-bit word: its byte by running counts of all eight at once, then a table."""
    nth = nth.astype(np.int64, copy=False).view(np.uint64)
    sums = word - ((word >> _1) & _55)
    sums = (sums & _33) + ((sums >> _2) & _33)
    sums = ((sums + (sums >> _4)) & _0F) * _L8
    # bytes whose running count is not above nth
    before = np.bitwise_count((((nth * _L8) | _H8) - sums) & _H8).astype(np.uint64) << _3
    left = nth - (((sums << _8) >> before) & np.uint64(0xFF))
    byte = (word >> before) & np.uint64(0xFF)
    return (before + _IN_BYTE[(byte << _3) | left]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence: ``low`` bits packed, the rest in unary in ``high``.

    ``ones`` and ``zeros``: those of ``high`` before each of its words, and in all; both are kept, so that
    a search costs nothing for what it doesn't look at.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones, self.zeros = n, bits, low, high, ones, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (max(top // max(n, 1), 1)).bit_length() - 1)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-((top >> bits) + n + 2) // 64) * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        kind = np.uint32 if len(flags) < 1 << 32 else np.uint64
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.uint64)]).astype(kind)
        zeros = (np.arange(len(ones), dtype=np.uint64) * np.uint64(64) - ones).astype(kind)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            rest = values & np.uint64((1 << bits) - 1)
            at = np.arange(n) * bits
            shift = (at % 64).astype(np.uint64)
            np.bitwise_or.at(low, at // 64, rest << shift)
            over = np.nonzero(at % 64 + bits > 64)[0]
            np.bitwise_or.at(low, at[over] // 64 + 1, rest[over] >> (np.uint64(64) - shift[over]))
        return cls(n, bits, low, high, ones, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones, self.zeros]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).view(np.uint64)
        out = self.low[word] >> shift
        # what the next word holds; shifted twice, so that nothing of it is taken where the shift is 0
        out |= (self.low[word + 1] << _1) << (shift ^ _63)
        out &= np.uint64((1 << self.bits) - 1)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        at = (word << 6) + select_in_word(self.high[word], i - self.ones[word].astype(np.int64))
        at -= i
        return (at.view(np.uint64) << np.uint64(self.bits)) | self.lows(i)

    def _bucket(self, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values with these upper parts begin and end."""
        k = np.maximum(upper - 1, 0)
        word = np.minimum(np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1, len(self.high) - 1)
        at = np.where(upper > 0, word * 64 + select_in_word(~self.high[word], k - self.zeros[word].astype(np.int64)) + 1, 0)
        lo = at - upper
        # the ones that follow the zero, up to the end of their word
        word = np.minimum(at >> 6, len(self.high) - 1)
        rest = ~self.high[word] >> (at & 63).astype(np.uint64)
        run = np.bitwise_count((rest & (~rest + _1)) - _1).astype(np.int64)
        over = np.flatnonzero(rest == 0)
        run[over] = 64 - (at[over] & 63)
        word = word[over]
        while len(over):  # and on through the words after it
            word = word + 1
            inside = word < len(self.high)
            over, word = over[inside], word[inside]
            flat = ~self.high[word]
            run[over] += np.bitwise_count((flat & (~flat + _1)) - _1).astype(np.int64)
            over, word = over[flat == 0], word[flat == 0]
        return np.minimum(lo, self.n), np.minimum(lo + run, self.n)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value not below each ``x`` (successor search); ``n`` if there is none."""
        return self._search(x)[0]

    def find_equal(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value equal to each ``x``; -1 if there is none."""
        at, end, low = self._search(x)
        inside = np.flatnonzero(at < end)
        out = np.full(len(at), -1)
        hit = inside[self.lows(at[inside]) == low[inside]]
        out[hit] = at[hit]
        return out

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.asarray(x).astype(np.uint64, copy=False)
        limit = len(self.high) * 64 - self.n - 1
        upper = (x >> np.uint64(self.bits)).astype(np.int64)
        lo, end = self._bucket(np.minimum(upper, limit))
        if (beyond := np.flatnonzero(upper > limit)).size:
            lo[beyond] = end[beyond] = self.n
        low = x & np.uint64((1 << self.bits) - 1)
        open_ = np.flatnonzero(lo < end)
        a, b, sought = lo[open_], end[open_], low[open_]
        while open_.size:
            mid = (a + b) >> 1
            small = self.lows(mid) < sought
            a, b = np.where(small, mid + 1, a), np.where(small, b, mid)
            more = a < b
            done = np.flatnonzero(~more)
            lo[open_[done]] = a[done]
            left = np.flatnonzero(more)
            open_, a, b, sought = open_[left], a[left], b[left], sought[left]
        return lo, end, low
