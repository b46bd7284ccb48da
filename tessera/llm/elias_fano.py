"""Elias-Fano sequences and a trie of n-grams made of them, read in place from its bytes."""

from __future__ import annotations

import numpy as np


class EliasFano:
    """A non-decreasing sequence of whole numbers: ``width`` low bits of each packed, the rest in
    unary. The packed bits are read where they lie (a memory map or any buffer); opening it scans
    the unary part, which has two bits or so a number."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))[:n]
        self._above = (ones - np.arange(n)).astype(np.int64)
        # the first number of each value of the upper bits
        top = int(self._above[-1]) + 1 if n else 0
        self._begin = np.searchsorted(self._above, np.arange(top + 1)).astype(np.int64)
        self._words = np.ndarray((max(0, len(low) - 7),), "<u8", low, 0, (1,))

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        above = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros((int(above[-1]) + n + 1 if n else 0), np.uint8)
        bits[above + np.arange(n)] = 1
        low = np.zeros((n * width + 7) // 8 + 8, np.uint8)
        for i in range(0, n if width else 0, 1 << 16):  # a multiple of eight numbers fills whole bytes
            part = (values[i:i + (1 << 16), None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(part.ravel(), bitorder="little")
            low[i * width // 8:i * width // 8 + len(packed)] = packed
        return EliasFano(n, width, low, np.packbits(bits, bitorder="little"))

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        out = self._above[i] << self.width
        if self.width:
            bit = i.astype(np.int64) * self.width
            out = out | (self._words[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.width) - 1)).astype(np.int64)
        return out

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in ``begin`` to ``end`` whose number is not under ``x``; ``end`` if none.
        The upper bits lead to the few numbers that share them."""
        above = x >> self.width
        far = above >= len(self._begin) - 1
        bucket = np.where(far, 0, above)
        if not self.n:
            return end.copy()
        lo = np.where(far, end, np.clip(self._begin[bucket], begin, end))
        hi = np.where(far, end, np.clip(self._begin[bucket + 1], begin, end))
        live = np.flatnonzero(lo < hi)
        while len(live):  # halve the bucket
            mid = (lo[live] + hi[live]) >> 1
            less = self.at(mid) < x[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def parts(self) -> list[bytes]:
        return [np.array([self.n, self.width, len(self.low), len(self.high)], "<i8").tobytes(), self.low.tobytes(), self.high.tobytes()]

    @staticmethod
    def read(buffer, at: int) -> tuple[EliasFano, int]:
        """The sequence that begins at a byte of a buffer, and where it ends."""
        n, width, low, high = np.frombuffer(buffer, "<i8", 4, at).tolist()
        at += 32
        return EliasFano(n, width, np.frombuffer(buffer, np.uint8, low, at), np.frombuffer(buffer, np.uint8, high, at + low)), at + low + high


class Level:
    """States of one depth. Labels are relative to their context: each context's labels start
    again above the last one of the context before, so the whole level does not decrease."""

    def __init__(self, values: EliasFano, pointers: EliasFano, codes: np.ndarray):
        self.values, self.pointers, self.codes = values, pointers, codes

    @staticmethod
    def of(labels: np.ndarray, children: np.ndarray, codes: np.ndarray) -> Level:
        """``children``: how many states each context has. ``codes``: a row of bytes for each state."""
        ends = np.cumsum(children)
        some = np.flatnonzero(children)
        last = labels[ends[some] - 1].astype(np.int64) + 1
        base = np.zeros(len(children), np.int64)
        base[some] = np.cumsum(last) - last
        values = labels.astype(np.int64) + np.repeat(base, children)
        return Level(EliasFano.of(values), EliasFano.of(np.append(0, ends)), codes)

    def find(self, context: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The state of each label in its context, -1 if there is none."""
        known = np.flatnonzero(context >= 0)
        out = np.full(len(labels), -1, np.int64)
        if not len(known) or not self.values.n:
            return out
        begin, end = self.pointers.at(context[known]), self.pointers.at(context[known] + 1)
        base = np.where(begin > 0, self.values.at(np.maximum(begin - 1, 0)) + 1, 0)
        x = labels[known].astype(np.int64) + base
        place = self.values.successor(x, begin, end)
        hit = place < end
        hit[hit] = self.values.at(place[hit]) == x[hit]
        out[known[hit]] = place[hit]
        return out


class Trie:
    """Levels of n-grams, one context above the first level."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def to_bytes(self) -> bytes:
        out = [np.array([len(self.levels)], "<i8").tobytes()]
        for v in self.levels:
            out += v.values.parts() + v.pointers.parts()
            out += [np.array(v.codes.shape, "<i8").tobytes(), v.codes.tobytes()]
        return b"".join(out)

    @staticmethod
    def read(buffer) -> Trie:
        """A trie in place over a buffer: bytes, an Arrow buffer or ``numpy.memmap`` of a file."""
        levels, at = [], 8
        for _ in range(int(np.frombuffer(buffer, "<i8", 1)[0])):
            values, at = EliasFano.read(buffer, at)
            pointers, at = EliasFano.read(buffer, at)
            shape = np.frombuffer(buffer, "<i8", 2, at).tolist()
            levels.append(Level(values, pointers, np.frombuffer(buffer, np.uint8, shape[0] * shape[1], at + 16).reshape(shape)))
            at += 16 + shape[0] * shape[1]
        return Trie(levels)
