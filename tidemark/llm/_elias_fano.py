"""Monotone sequences in Elias-Fano form on plain numpy arrays, read for many positions or values at a time."""

from __future__ import annotations

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
ONES = _BITS.sum(1).astype(np.int64)
#: NTH[b, k]: position of the k-th set bit of byte b.
NTH = np.argsort(1 - _BITS.astype(np.int8), axis=1, kind="stable").astype(np.int64)
MOST_LOW = 57  # so that low bits and their offset in a byte fit 64 bits


class EliasFano:
    """Of n values below a bound u: log2(u/n) low bits each, packed, and the high parts in unary (as many ones as values share
    a high part, then a zero), with zeros counted before every 64 bits."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width, self.zeros = (int(x) for x in arrays["shape"])
        self.low, self.high, self.before = arrays["low"], arrays["high"].reshape(-1, 8), arrays["before"]
        self.mask = np.uint64((1 << self.width) - 1)
        self.wide = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))

    @staticmethod
    def arrays(values: np.ndarray) -> dict[str, np.ndarray]:
        """What a sequence of uint64, never falling, is stored as."""
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(MOST_LOW, max(0, (top // max(n, 1)).bit_length() - 1)) if n else 0
        low = [np.zeros(0, np.uint8)]
        for lo in range(0, n if width else 0, 1 << 16):
            part = (values[lo : lo + (1 << 16), None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            low.append(np.packbits(part.astype(np.uint8).ravel(), bitorder="little"))
        part = (values >> np.uint64(width)).astype(np.int64)
        zeros = (int(part[-1]) if n else 0) + 1
        bits = np.zeros(-(-(n + zeros) // 64) * 64, np.uint8)
        bits[part + np.arange(n)] = 1
        bits[n + zeros :] = 1  # no zeros beyond the end
        high = np.packbits(bits, bitorder="little")
        count = 64 - ONES[high].reshape(-1, 8).sum(1)
        return {
            "shape": np.array([n, width, zeros], np.int64),
            "low": np.concatenate([*low, np.zeros(8, np.uint8)]),
            "high": high,
            "before": np.concatenate([[0], np.cumsum(count)]).astype(np.int64),
        }

    def _select(self, before: np.ndarray, flip: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one, or zero where bytes are flipped."""
        word = np.searchsorted(before, k, "right") - 1
        eight = self.high[word] ^ np.uint8(flip)
        ones = np.cumsum(ONES[eight], axis=1)
        rest = k - before[word]
        byte = (ones > rest[:, None]).argmax(1)
        rows = np.arange(len(k))
        mine = eight[rows, byte]
        return word * 64 + byte * 8 + NTH[mine, rest - ones[rows, byte] + ONES[mine]]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        return (self.wide[at >> 3] >> (at & 7).astype(np.uint64)) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        if not len(i):
            return np.zeros(0, np.uint64)
        ones_before = np.arange(len(self.before)) * 64 - self.before
        high = self._select(ones_before, 0, i) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successor search: the first position from ``lo`` on, below ``hi``, of a value of at least x (else where the search
        ends), and whether the value is x."""
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        want = np.minimum(x >> np.uint64(self.width), np.uint64(self.zeros)).astype(np.int64)
        there = want < self.zeros
        h = np.minimum(want, self.zeros - 1)
        first = np.where(h > 0, self._select(self.before, 255, np.maximum(h - 1, 0)) - h + 1, 0)
        end = np.minimum(self._select(self.before, 255, h) - h, hi)
        b, e = np.maximum(first, lo), np.maximum(end, np.maximum(first, lo))
        low, stop = x & self.mask, e
        while (open_ := b < e).any():
            mid = np.minimum((b + e) >> 1, self.n - 1)
            less = open_ & (self._low(mid) < low)
            b, e = np.where(less, mid + 1, b), np.where(less | ~open_, e, mid)
        found = there & (b < stop)
        found &= self._low(np.minimum(b, self.n - 1)) == low
        return b, found
