"""Elias-Fano sequences in numpy: a rising sequence of n numbers below u in about
n * (2 + log2(u / n)) bits and a directory of a quarter bit per number, searched without unpacking it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GROUP = 8  # words of high bits per entry of the directory
AT_ONCE = 1 << 16  # numbers packed or looked up together


@dataclass
class EliasFano:
    """``low``: the low ``width`` bits of each value, packed; ``high``: per value a one after as many
    zeros as the high part has risen; ``ones``: how many ones stand before each group of high words."""

    n: int
    width: int
    rise: int  # zeros among the high bits
    low: np.ndarray  # uint64 words
    high: np.ndarray  # uint64 words, whole groups
    ones: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        """``values`` rising (equal neighbours allowed), all below ``bound``."""
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        width = max(0, int(bound // max(n, 1)).bit_length() - 1)
        lanes = np.arange(width, dtype=np.uint64)[None]
        packed = [
            np.packbits((values[at : at + AT_ONCE, None] >> lanes & np.uint64(1)).astype(np.uint8), bitorder="little")
            for at in range(0, n, AT_ONCE)
        ]
        size = sum(len(p) for p in packed)
        low = np.zeros(size // 8 + 2, dtype=np.uint64)
        if packed:
            low.view(np.uint8)[:size] = np.concatenate(packed)
        upper = (values >> np.uint64(width)).astype(np.int64)
        rise = (int(upper[-1]) if n else 0) + 1
        groups = -(-(n + rise) // (64 * GROUP))
        marks = np.zeros(groups * 64 * GROUP, dtype=np.uint8)
        marks[upper + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little").view("<u8")
        counts = np.bitwise_count(high).reshape(groups, GROUP).sum(axis=1, dtype=np.int64)
        return cls(n, width, rise, low, high, np.cumsum(counts) - counts)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.width, self.rise, len(self.low), len(self.ones)], dtype="<i8").tobytes()
        return head + self.low.astype("<u8").tobytes() + self.high.astype("<u8").tobytes() + self.ones.astype("<i8").tobytes()

    @classmethod
    def from_buffer(cls, data: bytes | memoryview, at: int = 0) -> tuple[EliasFano, int]:
        """A view of the bytes, nothing is copied; and where the next structure begins."""
        n, width, rise, words, groups = (int(x) for x in np.frombuffer(data, "<i8", 5, at))
        low = np.frombuffer(data, "<u8", words, at + 40)
        at += 40 + 8 * words
        high = np.frombuffer(data, "<u8", groups * GROUP, at)
        at += 8 * groups * GROUP
        return cls(n, width, rise, low, high, np.frombuffer(data, "<i8", groups, at)), at + 8 * groups

    def _select(self, which: np.ndarray, bit: int) -> np.ndarray:
        """The places of these ones (or zeros) among the high bits: the group by the directory, the word
        by counts, the bit by halves."""
        before = self.ones if bit else np.arange(len(self.ones)) * (64 * GROUP) - self.ones
        out = np.empty(len(which), dtype=np.int64)
        for begin in range(0, len(which), AT_ONCE):
            left = which[begin : begin + AT_ONCE].astype(np.int64)
            row = np.arange(len(left))
            group = np.searchsorted(before, left, side="right") - 1
            left -= before[group]
            words = self.high[group[:, None] * GROUP + np.arange(GROUP)]
            words = words if bit else ~words
            counts = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
            part = (counts <= left[:, None]).sum(axis=1)
            left -= np.where(part > 0, counts[row, part - 1], 0)
            word, at = words[row, part], group * (64 * GROUP) + part * 64
            for half in (32, 16, 8, 4, 2, 1):
                lower = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
                beyond = left >= lower
                left -= np.where(beyond, lower, 0)
                word = np.where(beyond, word >> np.uint64(half), word)
                at += np.where(beyond, half, 0)
            out[begin : begin + AT_ONCE] = at
        return out

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        first = self.low[word] >> shift
        # A shift by 64 is undefined, so the upper part moves in two steps.
        second = (self.low[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return (first | second) & np.uint64((1 << self.width) - 1)

    def values(self, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(self.n) if at is None else np.asarray(at)
        return (self._select(at, 1) - at).astype(np.uint64) << np.uint64(self.width) | self._low(at)

    def successor(self, targets: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """The first place in begin..end whose value is not below the target; ``end`` if none is.

        The zeros of the high bits give the run with the target's high part, and its low bits are
        searched by halves."""
        targets = np.asarray(targets, dtype=np.uint64)
        end = np.full(len(targets), self.n) if end is None else end
        upper = (targets >> np.uint64(self.width)).astype(np.int64)
        known = upper < self.rise
        part = np.minimum(upper, self.rise - 1)
        before = np.maximum(part - 1, 0)
        lo = np.where(part > 0, self._select(before, 0) - before, 0)
        hi = np.minimum(self._select(part, 0) - part, self.n)
        lo = np.where(known, lo, self.n)
        hi = np.where(known, hi, self.n)
        lo, hi = np.clip(lo, begin, end), np.clip(hi, begin, end)
        wanted = targets & np.uint64((1 << self.width) - 1)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            less = open_.copy()
            less[open_] = self._low(mid[open_]) < wanted[open_]
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
