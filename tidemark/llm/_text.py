"""Numpy views of Arrow text columns: byte classes, word bounds and word hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial word hash (mod 2**64) and the steps of the splitmix finaliser.
MULT = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing, and in ``[^\x20\x09-\x0D]+``.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
SOLID = np.ones(256, bool)
SOLID[[32, *range(9, 14)]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` mod 2**64; kept per worker, grown when a longer text comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null counts as an empty text."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets.astype(np.int64)


def pieces(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows, so that what is made of it stays small."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def frugal(*steps):
    """Iterator functions over batches as one, which at a task's end gives back what its worker no longer needs: workers
    are kept for later tasks, and each holds on to its memory."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        try:
            yield from batches
        finally:
            release()

    return work


def release() -> None:
    for base in [b for b, t in _powers.items() if len(t) > 1 << 20]:
        del _powers[base]
    pa.default_memory_pool().release_unused()


def slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` of runs of whole texts of about ``limit`` bytes."""
    if not len(column):
        return
    data, offsets = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column), lo + 4000)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``mask`` that do not cross a text's bounds."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(mask) + 1, bool)
    cut[offsets] = True
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    before &= ~cut[:-1]
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    after &= ~cut[1:]
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(MULT, len(data)), out=sums[1:])
    back = powers(pow(MULT, -1, 1 << 64), len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts])


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, start, end, first)`` of the words of lower-cased texts; first[i]:first[i+1] are those of text i."""
    low = LOWER[data]
    starts, ends = runs(kind[low], offsets)
    return span_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, offsets)
