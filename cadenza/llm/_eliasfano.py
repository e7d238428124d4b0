"""Elias-Fano sequences over memory-mapped words, with vectorised access and search."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def _gather(out: np.ndarray, word: np.ndarray, bits: np.ndarray) -> None:
    """Sets bits in out[word]; words don't fall."""
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] |= np.bitwise_or.reduceat(bits, first)


class EliasFano:
    """A monotone sequence of integers below `universe`.

    The upper bits are written in unary, one bit set for each value; the lower bits lie
    side by side in fields of equal width. About 2 + log2(universe / n) bits a value."""

    def __init__(self, n: int, width: int, high: np.ndarray, low: np.ndarray):
        self.n, self.width, self.high, self.low = n, width, high, low
        counts = np.bitwise_count(high).astype(np.int64)
        #: Ones, and zeros, before each word.
        self.ones = np.concatenate([[0], np.cumsum(counts)])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    @staticmethod
    def width_for(n: int, universe: int) -> int:
        return max(0, (max(1, universe) // max(1, n)).bit_length() - 1)

    @classmethod
    def levels(cls, values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray]:
        """The width of the lower field, the words of the upper bits and those of the lower bits."""
        values = np.asarray(values, U64)
        n, width = len(values), cls.width_for(len(values), universe)
        upper = (values >> U64(width)).astype(np.int64)
        size = n + (int(upper[-1]) if n else 0) + 1
        bits = np.zeros((size + 63) // 64 * 64, np.uint8)
        bits[upper + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(U64)
        low = np.zeros((n * width + 63) // 64 + 1, U64)
        if width:
            part = values & U64((1 << width) - 1)
            bit = np.arange(n, dtype=np.int64) * width
            word, shift = bit >> 6, (bit & 63).astype(U64)
            over = (shift + U64(width)) > U64(64)
            _gather(low, word, part << shift)
            _gather(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        return width, high, low

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        return cls(len(values), *cls.levels(values, universe))

    def lower(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        bit = np.asarray(i, np.int64) * self.width
        word, shift = bit >> 6, (bit & 63).astype(U64)
        out = self.low[word] >> shift
        over = (shift + U64(self.width)) > U64(64)
        out[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return out & U64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """The position of the k-th bit (from 0) that is set, or clear with flip."""
        word = np.searchsorted(before, k, "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        left = k - before[word]
        bits = ~self.high[word] if flip else self.high[word].copy()
        at = word * 64
        for shift in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count(bits & U64((1 << shift) - 1)).astype(np.int64)
            go = left >= part
            left = np.where(go, left - part, left)
            bits = np.where(go, bits >> U64(shift), bits)
            at = np.where(go, at + shift, at)
        return at

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, self.ones, False) - i).astype(U64) << U64(self.width)) | self.lower(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the first position whose value is x or more; n if there is none."""
        x = np.asarray(x, U64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        upper = (x >> U64(self.width)).astype(np.int64)
        want = x & U64((1 << self.width) - 1)
        last = int(self.zeros[-1])
        out = np.full(len(x), self.n, np.int64)
        inside = np.flatnonzero(upper <= last)
        upper, want = upper[inside], want[inside]
        # Positions whose upper bits are smaller come before the upper-th zero, those with
        # the same upper bits up to the next one; among these the lower bits rise.
        start = np.where(upper > 0, self._select(np.maximum(upper - 1, 0), self.zeros, True) + 1 - upper, 0)
        start = np.minimum(start, self.n)
        end = np.minimum(self._select(upper, self.zeros, True) - upper, self.n)
        live = np.flatnonzero(start < end)
        while len(live):
            middle = (start[live] + end[live]) >> 1
            less = self.lower(middle) < want[live]
            start[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
            live = live[start[live] < end[live]]
        out[inside] = start
        return out
