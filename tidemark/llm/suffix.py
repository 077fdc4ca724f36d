"""Suffix-array removal of long repeated byte strings across documents.

A byte goes where some ``window``-byte string that covers it also starts in a document with a smaller id. In three steps:

1. Each window is represented by its minimiser: the least of its ``GRAM``-byte grams under a random order. Equal windows
   have equal minimisers at equal places, so a window whose minimiser occurs in one document only is unique. Per task,
   minimisers collapse to one entry each; their hashes meet in hash buckets, and only those of several documents go on.
2. Every shared minimiser sends its contexts (the bytes that its windows can span) to the bucket of its hash, each context of a
   unit of documents once, beside the places where it stands in the unit's smallest document that has it; its places in other documents of the unit travel
   packed and unread. There, units are shards of ``SHARD_BYTES``: each shard builds its
   suffix array by Larsson-Sadakane refinement, takes common prefixes by Kasai's rule and so has its distinct windows in order,
   with the smallest document of each. Shards merge in pairs by binary search of the one's windows among the other's.
3. Windows whose smallest document is smaller than theirs go back to their documents as intervals.

Contexts count as equal only where their bytes are, and what is removed is decided by the merged order alone.

A minimiser in more than ``HOT_CONTEXTS`` different surroundings would fill one bucket. Its windows are then dealt by where the
minimiser stands in them, ``STEP`` places together, and by the bytes that all windows of those places share; equal windows agree
in both, so each still meets all its equals, in a bucket of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

WINDOW = 50
GRAM = 16
SHARD_BYTES = 1 << 19
SLICE = 1 << 19
#: Different surroundings of a minimiser: in one unit, from which on they are counted; in all, from which on they are dealt out.
WARM, HOT_CONTEXTS = 8, 20_000
STEP = 5
#: Bytes of text of a unit; it grows with the input, as units times buckets rows travel between the two.
UNIT_BYTES, MOST_UNIT_BYTES = 8 << 20, 16 << 20


# ---------------------------------------------------------------------------------------------- suffix arrays in numpy


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: suffixes of ``text`` sorted by their first ``depth`` symbols or more, with their group numbers.

    Suffixes start sorted by eight bytes; then groups that are not settled yet, and only those, are sorted again by the
    group of the suffix ``h`` further on, while h doubles. Returns the order and each suffix's group (rank of its head).
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    head = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (n,), (1,)).astype(np.uint64)
    order = np.argsort(head)
    sorted_head = head[order]
    new = np.ones(n, bool)
    new[1:] = sorted_head[1:] != sorted_head[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    h = 8
    while h < depth:
        alone = new & np.append(new[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        suffix = order[open_at]
        group = rank[suffix]
        further = suffix + h
        key = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        again = np.argsort(group * (n + 1) + key)
        order[open_at] = suffix = suffix[again]
        group, key = group[again], key[again]
        split = np.ones(len(again), bool)
        split[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        new[open_at] = split
        rank[suffix] = open_at[np.maximum.accumulate(np.where(split, np.arange(len(split)), 0))]
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Kasai's common prefix of each sorted suffix with the one before, capped at ``depth``, all texts at once.

    Kasai: the value at position i is at least the value at i-1 less one, and exactly that where the characters before
    both suffixes agree. So only positions where they differ are compared byte by byte; the rest follow by subtraction.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    pos = np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (text[:-1] == text[np.maximum(before[1:] - 1, 0)])
    base = np.maximum.accumulate(np.where(follows, 0, pos))
    follows &= (pos - base) % 64 != 0  # compared anew now and then, as comparisons stop at a cap
    base = np.maximum.accumulate(np.where(follows, 0, pos))
    value = np.zeros(n, np.int64)
    at = np.flatnonzero(~follows & (before >= 0))
    for k in range(depth + 64):
        a, b = at + k, before[at] + k
        same = (a < n) & (b < n)
        same &= text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)]
        at = at[same]
        if not len(at):
            break
        value[at] = k + 1
    return np.minimum(np.maximum(value[base] - (pos - base), 0), depth)[order]


def window_groups(text: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their windows, and a group number for each: equal numbers are equal windows."""
    order, _ = suffix_array(text, window)
    prefix = common_prefixes(text, order, window)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    group = np.cumsum(prefix < window)
    chosen = wanted[order]
    return order[chosen], group[chosen]


# ------------------------------------------------------------------------------------------------- minimisers of a text


def gram_hashes(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the GRAM bytes from each position, or from those of ``at``; bytes past the end count as 0."""
    n = len(data)
    padded = np.zeros(n + GRAM, np.uint8)
    padded[:n] = data
    word = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (n + 8,), (1,))
    a, b = (word[:n], word[8 : n + 8]) if at is None else (word[at], word[at + 8])
    return _text.mix(a * np.uint64(_text.MULT) + b * _text.MIX_1)


def anchors(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: ``(hash, first window, last window, minimiser)``, as positions in ``data``."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < window:
        return none.astype(np.uint64), none, none, none
    gram = gram_hashes(data)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    key = (gram & ~low) | np.arange(n, dtype=np.uint64)
    width, have = window - GRAM + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if width > have:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    key = key[: n - window + 1]
    starts = np.arange(len(key))
    valid = np.zeros(len(key) + 1, np.int64)
    lo, hi = offsets[:-1], np.maximum(offsets[1:] - window + 1, offsets[:-1])
    np.add.at(valid, np.minimum(lo, len(key)), 1)
    np.add.at(valid, np.minimum(hi, len(key)), -1)
    starts = starts[np.cumsum(valid)[:-1] > 0]
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    best = (key[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return gram[best[first]], starts[first], starts[last], best[first]


def _unit(table: pa.Table, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per slice of a unit's texts: ``bytes, hash, document id, text tag, first and last window, minimiser, text start``."""
    for batch in table.combine_chunks().to_batches():
        ids = batch.column(0)
        known = np.asarray(ids.is_valid())
        ids = ids.fill_null(0).to_numpy()
        for lo, hi, data, offsets in _text.slices(batch.column(1), SLICE):
            h, first, last, best = anchors(data, offsets, window)
            row = np.searchsorted(offsets, first, "right") - 1
            use = known[lo + row]
            h, first, last, best, row = h[use], first[use], last[use], best[use], row[use]
            present = np.unique(row)
            tags = np.zeros(hi - lo, np.int64)
            for r in present:
                tags[r] = zlib.crc32(data[offsets[r] : offsets[r + 1]])
            yield data, h, ids[lo + row], tags[row], first, last, best, offsets[row]


def _surroundings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number made of the 16 bytes before and after the gram at each position; the text's ends count as 0."""
    n = len(data)
    padded = np.zeros(n + 2 * GRAM + 24, np.uint8)
    padded[16 : 16 + n] = data
    word = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (n + 2 * GRAM + 16,), (1,))
    out = np.zeros(len(at), np.uint64)
    for k in (0, 8, 16 + GRAM, 24 + GRAM):
        out = _text.mix(out * np.uint64(_text.MULT) + word[at + k])
    return out


def _low_bits(buckets: int) -> np.uint64:
    """A key is a bucket number and, below it, so many bits of hash; two hashes that agree in them only cost some work."""
    return np.uint64(min(48, 64 - (buckets - 1).bit_length()))


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    bits = _low_bits(buckets)
    return ((_text.mix(h) % np.uint64(buckets)) << bits) | (h & ((np.uint64(1) << bits) - np.uint64(1)))


def _pack48(keys: np.ndarray, buckets: int) -> bytes:
    """The hash bits of keys, six bytes each."""
    keys = keys & ((np.uint64(1) << _low_bits(buckets)) - np.uint64(1))
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _spread(window: int, buckets: int):
    """A unit's minimisers, one entry each, by hash bucket: bytes of the hashes, a bit that says more than one document, and
    the places and numbers of those in many different surroundings."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, docs, around = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for data, h, doc, _, _, _, best, _ in _unit(table.select(["doc_id", "text"]), window):
            keys.append(_keys(h, buckets))
            docs.append(doc)
            around.append(_surroundings(data, best))
        keys, docs, around = np.concatenate(keys), np.concatenate(docs), np.concatenate(around)
        order = np.lexsort((around, keys))
        keys, docs, around = keys[order], docs[order], around[order]
        start, _ = _cuts(keys)
        new = np.ones(len(keys), np.int64)
        new[1:] = (keys[1:] != keys[:-1]) | (around[1:] != around[:-1])
        many = np.minimum.reduceat(docs, start) != np.maximum.reduceat(docs, start) if len(start) else np.zeros(0, bool)
        kinds = np.add.reduceat(new, start) if len(start) else np.zeros(0, np.int64)
        keys = keys[start]
        bucket = (keys >> _low_bits(buckets)).astype(np.int32)
        cuts, ends = _cuts(bucket)
        warm = [np.flatnonzero(kinds[a:b] >= WARM) for a, b in zip(cuts, ends, strict=True)]
        return pa.table(
            {
                "bucket": pa.array(bucket[cuts], pa.int32()),
                "unit": pa.array(np.full(len(cuts), key[0].as_py(), np.int32)),
                "keys": pa.array([_pack48(keys[a:b], buckets) for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                "warm": pa.array([np.stack([w, kinds[a + w]]).astype(np.int32).tobytes() for a, w in zip(cuts, warm, strict=True)], pa.binary()),
            }
        )

    return work


def _meet(buckets: int):
    """One hash bucket: each unit gets back those of its minimisers that several documents hold, and which of them are hot."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [_unpack48(x.as_py()) for x in table["keys"]]
        many = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool) for x, p in zip(table["many"], parts, strict=True)]
        kinds = [np.ones(len(p), np.int64) for p in parts]
        for x, k in zip(table["warm"], kinds, strict=True):
            at, n = np.frombuffer(x.as_py(), np.int32).reshape(2, -1)
            k[at] = n
        keys, flag, kinds = np.concatenate(parts), np.concatenate(many), np.concatenate(kinds)
        unit = np.repeat(table["unit"].to_numpy(), [len(p) for p in parts])
        order = np.lexsort((unit, keys))
        keys, flag, kinds, unit = keys[order], flag[order], kinds[order], unit[order]
        start, end = _cuts(keys)
        shared = np.repeat((end - start > 1) | np.logical_or.reduceat(flag, start), end - start)
        hot = np.repeat(np.add.reduceat(kinds, start) > HOT_CONTEXTS, end - start)
        keys, unit, hot = keys[shared], unit[shared], hot[shared]
        order = np.argsort(unit, kind="stable")
        keys, unit, hot = keys[order], unit[order], hot[order]
        cuts, ends = _cuts(unit)
        return pa.table(
            {
                "unit": pa.array(unit[cuts], pa.int32()),
                "bucket": pa.array(np.full(len(cuts), key[0].as_py(), np.int32)),
                "keys": pa.array([_pack48(keys[a:b], buckets) for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                "hot": pa.array([np.flatnonzero(hot[a:b]).astype(np.int32).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            }
        )

    return work


MARKS = "unit int, marks binary"
CONTEXTS = f"bucket int, {MARKS}, lengths binary, bytes binary, next binary, others binary"


def _cuts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return start, np.append(start[1:], len(keys))[: len(start)]


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _open(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _pack(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Marks, best sorted by document: differences of ids and lengths in place of ends squeeze well."""
    return _squeeze(np.concatenate([np.diff(doc, prepend=0), tag, lo, hi - lo]).astype(np.int64).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    doc, tag, lo, size = np.frombuffer(_open(blob), np.int64).reshape(4, -1)
    return np.stack([np.cumsum(doc), tag, lo, lo + size])


def _gather(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The spans of a text, one after the other."""
    to = np.cumsum(length) - length
    return text[np.arange(length.sum()) - np.repeat(to, length) + np.repeat(start, length)]


def _equals(text: np.ndarray, start: np.ndarray, length: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each span, the first one found that agrees in the keys and in every byte, or itself; the first of a class is its own."""
    order = np.lexsort(keys)
    head = np.ones(len(order), bool)
    head[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    mine, other = order[~head], first[~head]
    fits = length[mine] == length[other]
    mine, other = mine[fits], other[fits]
    same = np.zeros(len(mine), bool)
    for lo in range(0, len(mine), 100_000):
        m, o = mine[lo : lo + 100_000], other[lo : lo + 100_000]
        n = length[m]
        if len(m):
            same[lo : lo + 100_000] = np.logical_and.reduceat(_gather(text, start[m], n) == _gather(text, start[o], n), np.cumsum(n) - n)
    out = np.arange(len(start))
    out[mine[same]] = other[same]
    return out


def _dealt(window: int, buckets: int, data, h, first, last, best, hot):
    """Runs of windows as they travel: ``(row, key, first window, last window)``; those of hot minimisers by where it stands."""
    cold = np.flatnonzero(~hot)
    out = [(cold, _keys(h[cold], buckets), first[cold], last[cold])]
    i = np.flatnonzero(hot)
    for a in range(0, window - GRAM + 1, STEP) if len(i) else ():
        b = min(a + STEP - 1, window - GRAM)
        lo, hi = np.maximum(first[i], best[i] - b), np.minimum(last[i], best[i] - a)
        some = np.flatnonzero(lo <= hi)
        j = i[some]
        common = _text.span_hashes(data, best[j] - a, best[j] - b + window)
        out.append((j, _keys(_text.mix(h[j] ^ _text.mix(common + np.uint64(a + 1))), buckets), lo[some], hi[some]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _contexts(window: int, buckets: int):
    """A unit's shared windows by bucket: each distinct context once, and every place where one stands."""

    def work(key: tuple[pa.Scalar, ...], docs: pa.Table, reply: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        unit, bits = key[0].as_py(), _low_bits(buckets)
        if reply.num_rows:
            shared = [(np.uint64(b.as_py()) << bits) | _unpack48(k.as_py()) for b, k in zip(reply["bucket"], reply["keys"], strict=True)]
            heat = [np.zeros(len(k), bool) for k in shared]
            for x, k in zip(reply["hot"], heat, strict=True):
                k[np.frombuffer(x.as_py(), np.int32)] = True
            shared, heat = np.concatenate(shared), np.concatenate(heat)
            order = np.argsort(shared)
            shared, heat = shared[order], heat[order]
            found, pieces = [], []
            for data, h, doc, tag, first, last, best, begin in _unit(docs.select(["doc_id", "text"]), window):
                k = _keys(h, buckets)
                at = np.minimum(np.searchsorted(shared, k), len(shared) - 1)
                use = np.flatnonzero(shared[at] == k)
                if not len(use):
                    continue
                row, k, lo, hi = _dealt(window, buckets, data, h[use], first[use], last[use], best[use], heat[at[use]])
                row, hi = use[row], hi + window
                found.append((k, _text.span_hashes(data, lo, hi), doc[row], tag[row], lo - begin[row], hi - lo))
                pieces.append(_gather(data, lo, hi - lo))
            if found:
                k, ctx, doc, tag, lo, length = (np.concatenate(x) for x in zip(*found, strict=True))
                text = np.concatenate(pieces)
                start = np.cumsum(length) - length
                rep = _equals(text, start, length, ctx, k)
                # the places of a context but for those in the unit's smallest document that has it travel packed: the bucket
                # only says whether its windows stand in a smaller document than any of them
                least = np.full(len(rep), np.iinfo(np.int64).max)
                np.minimum.at(least, rep, doc)
                other = doc > least[rep]
                next_ = np.full(len(rep), np.iinfo(np.int64).max)
                np.minimum.at(next_, rep[other], doc[other])
                next_ = next_[rep]
                far = np.stack([(k >> bits).astype(np.int64), doc, tag, lo, lo + length])[:, other]
                far = far[:, np.lexsort((far[3], far[2], far[1], far[0]))]
                packed = {int(far[0, x]): _pack(*_runs(far[:, x:y])[1:]) for x, y in zip(*_cuts(far[0]), strict=True)}
                first_at = np.full(len(rep), len(rep))
                np.minimum.at(first_at, rep[~other], np.arange(len(rep) - int(other.sum())))
                k, doc, tag, lo, length, start, rep, next_ = (x[~other] for x in (k, doc, tag, lo, length, start, rep, next_))
                rep = first_at[rep]
                bucket = (k >> bits).astype(np.int64)
                order = np.lexsort((lo, doc, bucket))
                for a, b in zip(*_cuts(bucket[order]), strict=True):
                    i = order[a:b]
                    own, at, number = np.unique(rep[i], return_index=True, return_inverse=True)
                    turn = np.argsort(at)
                    place = np.empty(len(own), np.int64)
                    place[turn] = np.arange(len(own))
                    own = own[turn]
                    marks = np.concatenate([np.diff(doc[i], prepend=0), tag[i], lo[i], np.diff(place[number], prepend=0)])
                    bytes_of = _gather(text, start[own], length[own])
                    rows.append((int(bucket[i[0]]), unit, _squeeze(marks.astype(np.int64).tobytes()), length[own].astype(np.uint8).tobytes(), _squeeze(bytes_of.tobytes()), _squeeze(next_[own].tobytes()), packed.get(int(bucket[i[0]]))))
        names = ["bucket", "unit", "marks", "lengths", "bytes", "next", "others"]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return work


class _Shard:
    """The distinct windows of a shard's contexts in order (``strings``), each with its smallest document (``least``).

    ``of`` leads from the windows of the contexts, one after the other, to the distinct ones.
    """

    def __init__(self, text: np.ndarray, length: np.ndarray, doc: np.ndarray, window: int) -> None:
        start = np.cumsum(length) - length
        windows = length - window + 1
        owner = np.repeat(np.arange(len(start)), windows)
        at = start[owner] + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        number = np.full(len(text), -1, np.int64)
        number[at] = np.arange(len(at))
        order, group = window_groups(text, at, window)
        slot = number[order]
        new = np.append(True, group[1:] != group[:-1])
        head = np.flatnonzero(new)
        self.least = np.minimum.reduceat(doc[owner[slot]], head)
        self.of = np.empty(len(at), np.int64)
        self.of[slot] = np.cumsum(new) - 1
        rows = np.lib.stride_tricks.sliding_window_view(text, window)[order[head]]
        self.strings = np.ascontiguousarray(rows).view(f"S{window}").ravel()


def merged_least(shards: list[_Shard]) -> list[np.ndarray]:
    """For every shard, the smallest document of each of its distinct windows in any shard.

    Neighbours merge in pairs until one order is left: each window of the one is looked up among the other's by binary search,
    and those not there are put in their places.
    """
    level = [(x.strings, x.least, [(n, np.arange(len(x.strings)))]) for n, x in enumerate(shards)]
    while len(level) > 1:
        above = [level[-1]] if len(level) % 2 else []
        for (a, low_a, from_a), (b, low_b, from_b) in zip(level[0::2], level[1::2], strict=False):
            at = np.searchsorted(a, b)
            both = a[np.minimum(at, len(a) - 1)] == b
            add = np.flatnonzero(~both)
            move_a = np.arange(len(a)) + np.cumsum(np.bincount(at[add], minlength=len(a) + 1))[: len(a)]
            move_b = np.empty(len(b), np.int64)
            move_b[add] = at[add] + np.arange(len(add))
            move_b[both] = move_a[at[both]]
            low = np.insert(low_a, at[add], low_b[add])
            met = move_b[both]
            low[met] = np.minimum(low[met], low_b[both])
            above.append((np.insert(a, at[add], b[add]), low, [*((n, move_a[x]) for n, x in from_a), *((n, move_b[x]) for n, x in from_b)]))
        level = above
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(shards)
    for _, low, parts in level:
        for n, x in parts:
            out[n] = low[x]
    return out


def _bucket(window: int):
    """One bucket: its contexts by shards of documents, the shards merged, and every place judged by the merged order."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        places, units, sizes, pieces, base = [], [], [], [], 0
        nexts, others = [], []
        for row in range(table.num_rows):
            doc, tag, lo, c = np.frombuffer(_open(table["marks"][row].as_py()), np.int64).reshape(4, -1)
            places.append(np.stack([np.cumsum(doc), tag, lo, np.cumsum(c) + base]))
            units.append(np.full(len(doc), table["unit"][row].as_py(), np.int64))
            sizes.append(np.frombuffer(table["lengths"][row].as_py(), np.uint8).astype(np.int64))
            pieces.append(np.frombuffer(_open(table["bytes"][row].as_py()), np.uint8))
            nexts.append(np.frombuffer(_open(table["next"][row].as_py()), np.int64))
            others.append((table["unit"][row].as_py(), table["others"][row].as_py(), base))
            base += len(sizes[-1])
        doc, tag, lo, c = np.concatenate(places, axis=1)
        unit, length, text = np.concatenate(units), np.concatenate(sizes), np.concatenate(pieces)
        start = np.cumsum(length) - length
        own, c_of = np.unique(_equals(text, start, length, _text.span_hashes(text, start, start + length)), return_inverse=True)
        c = c_of[c]  # of the place, its distinct context
        length, start = length[own], start[own]
        order = np.argsort(c, kind="stable")
        unit, doc, tag, lo, c = unit[order], doc[order], tag[order], lo[order], c[order]
        least = np.minimum.reduceat(doc, _cuts(c)[0])
        cuts, _ = _cuts((np.cumsum(length) - length) // SHARD_BYTES)
        cuts = [*cuts, len(length)]
        shards = [_Shard(_gather(text, start[a:b], length[a:b]), length[a:b], least[a:b], window) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        low = np.concatenate([x[shard.of] for x, shard in zip(merged_least(shards), shards, strict=True)])
        windows = length - window + 1
        begin = np.cumsum(windows) - windows
        top, bottom = np.maximum.reduceat(low, begin), np.minimum.reduceat(low, begin)
        whole = np.flatnonzero(doc > top[c])
        marks = [np.stack([unit[whole], doc[whole], tag[whole], lo[whole], lo[whole] + length[c[whole]]])]
        part = np.flatnonzero((doc <= top[c]) & (doc > bottom[c]))
        for a in range(0, len(part), 50_000):
            e = part[a : a + 50_000]
            n = windows[c[e]]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            e = np.repeat(e, n)
            gone = np.flatnonzero(low[begin[c[e]] + offset] < doc[e])
            e, at = e[gone], lo[e[gone]] + offset[gone]
            marks.append(np.stack([unit[e], doc[e], tag[e], at, at + window]))
        m = np.concatenate(marks, axis=1)
        m = m[:, np.lexsort((m[3], m[2], m[1], m[0]))]
        # packed places go where the merged order has a smaller document for every window of their contexts
        out = [(u, x) for (u, x, at), n in zip(others, nexts, strict=True) if x is not None and (top[c_of[at : at + len(n)]] < n).all()]
        for a, b in zip(*_cuts(m[0]), strict=True):
            u, d, t, x, y = _runs(m[:, a:b])
            out.append((int(u[0]), _pack(d, t, x, y)))
        names, kinds = ["unit", "marks"], [pa.int32(), pa.binary()]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return work


def _runs(m: np.ndarray) -> np.ndarray:
    """Marks sorted by document and start, with those that begin at most one byte on from each other made one."""
    new = np.ones(m.shape[1], bool)
    same = (m[1][1:] == m[1][:-1]) & (m[2][1:] == m[2][:-1])
    new[1:] = ~same | (m[3][1:] > m[4][:-1])
    head = np.flatnonzero(new)
    out = m[:, head]
    out[4] = np.maximum.reduceat(m[4], head)
    return out


def _finish(with_text: bool):
    def work(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if marks.num_rows:
            doc, tag, lo, hi = np.concatenate([_unpack(x.as_py()) for x in marks["marks"]], axis=1)
            for d, t, a, b in zip(doc.tolist(), tag.tolist(), lo.tolist(), hi.tolist(), strict=True):
                by.setdefault((d, t), []).append((a, b))
        marked = {d for d, _ in by}
        rows = []
        for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
            raw = (text or "").encode()
            spans: list[tuple[int, int]] = []
            if doc_id in marked:
                for a, b in sorted(by.get((doc_id, zlib.crc32(raw)), ())):
                    if spans and spans[-1][1] >= a:
                        spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                    else:
                        spans.append((a, b))
            at, kept = 0, []
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            left = b"".join([*kept, raw[at:]]) if spans else raw
            row = (doc_id, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(left).hexdigest())
            rows.append((*row, left.decode("utf-8", "ignore")) if with_text else row)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names[: 5 + with_text], kinds, strict=False))})

    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and kept_text if asked for
    (remaining bytes; a character cut in two is left out of the text, never of the digest).

    A null or short text has nothing removed; a null id neither causes nor suffers removal; rows that repeat an id do not
    remove from each other. Each row of the input gives one row, an empty table none; other columns are not read. A very long
    text is one row of its unit, where slices of whole texts are worked on in turn.
    """
    if window < GRAM + 8 or window + window - GRAM > 255:
        raise ValueError(f"windows must have {GRAM + 8} to {(255 + GRAM) // 2} bytes")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bytes_in = base.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    size = UNIT_BYTES
    while size < MOST_UNIT_BYTES and bytes_in > size * 2000:
        size *= 2
    units, buckets = max(8, bytes_in // size), max(16, 4 * bytes_in // size)
    base = base.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).cast("int"))
    spread = base.groupBy("unit").applyInArrow(_spread(window, buckets), "bucket int, unit int, keys binary, many binary, warm binary")
    reply = spread.groupBy("bucket").applyInArrow(_meet(buckets), "unit int, bucket int, keys binary, hot binary")
    contexts = base.groupBy("unit").cogroup(reply.groupBy("unit")).applyInArrow(_contexts(window, buckets), CONTEXTS)
    marks = contexts.groupBy("bucket").applyInArrow(_bucket(window), MARKS)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return base.groupBy("unit").cogroup(marks.groupBy("unit")).applyInArrow(_finish(with_text), schema).withColumnRenamed("doc_id", id_col)
