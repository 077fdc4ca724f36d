"""Scoring texts by a trigram model in Elias-Fano tries, one trie for each shard of last words.

An n-gram's probability is a smoothed relative frequency,

    p(c | a b) = (n(abc) + alpha * (n(bc) + mu * p1(c))) / (n(ab) + alpha * (n(b) + mu)),    p1(c) = (n(c) + 1) / (N + V + 1),

which adds up to one over c. Its numerator needs counts of n-grams that end in c only, its denominator of those that end in b,
so tries are sharded by the last word, and a text's score is a sum of numerators, each looked up where the token is the last
word, less denominators, each looked up where the context's last word is. Texts are read twice: for the words' counts, and in
units of whole documents, each of which sends a shard its distinct n-grams with their training counts and the documents they
stand in. The shard adds the counts up to a trie of three levels (word, the word before, the word before that), all monotone
sequences in Elias-Fano form in one memory-mapped file: a node's children stand between two pointers and are coded relative to
the context, by adding up ranges; probabilities are stored as 16-bit logarithms. Then it answers its units. Words that make up
over a thousandth of all tokens are dealt to shards by the word before as well; their own counts are sent along (at most 1,024).

Within a shard a word is its 64-bit hash, the word before 40 bits of one, relative to its successor, and the word before that
32 bits relative to the pair: two contexts of one word fall together with a probability of 2**-40 or 2**-32.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._elias_fano import EliasFano
from ._shared import forget, materialise
from ._text import SOLID, frugal, mix, release, slices, words

ALPHA, MU = 0.02, 200.0
#: Logarithms to base ten are kept in steps of one 1,024th.
STEPS = 1024
UNIT_TOKENS, COUNT_TOKENS, SHARD_TOKENS = 2_000_000, 4_000_000, 3_000_000
HOT_WORDS = 1024
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)

COUNTED = "word long, n long, n_all long"
SENT = "shard int, unit long, payload binary"
ANSWER = "unit long, doc array<int>, code array<int>, base array<double>, n_known array<int>, last array<long>, n_tokens array<long>, doc_id array<long>, known array<long>, held_out array<long>"
SUMMED = "doc_id long, held_out boolean, n_tokens long, code long, base double, n_known long"


def held(id_column, mod: int, rest: int):
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % mod == rest, F.lit(False))


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, tokens, tokens of each row)``; END closes every text."""
    for lo, hi, data, offsets in slices(batch.column("text")):
        hashes, _, _, first = words(data, offsets, SOLID)
        n = np.diff(first)
        out = np.full(len(hashes) + len(n), END)
        out[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes
        yield lo, hi, out, n + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_tokens, train, size = [], [], 0

    def flush() -> pa.RecordBatch:
        word, at = np.unique(np.concatenate(held_tokens), return_inverse=True)
        n = np.bincount(at, np.concatenate(train), len(word)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(np.bincount(at, minlength=len(word)))], names=["word", "n", "n_all"])

    for batch in batches:
        out = batch.column("held_out").to_numpy(zero_copy_only=False)
        for lo, hi, tokens, n in _tokens(batch):
            held_tokens.append(tokens)
            train.append(np.repeat(~out[lo:hi], n))
            size += len(tokens)
            if size >= COUNT_TOKENS:
                yield flush()
                held_tokens, train, size = [], [], 0
    if size:
        yield flush()


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each, then compressed."""
    parts = []
    for a in arrays:
        kind = np.min_scalar_type(int(a.max()) if len(a) else 0) if a.dtype.kind == "u" or (len(a) == 0 or a.min() >= 0) else np.dtype(np.int64)
        a = a.astype(kind)
        parts += [np.array([ord(kind.kind), kind.itemsize, len(a)], np.int64).tobytes(), a.tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        kind, size, n = (int(x) for x in np.frombuffer(raw, np.int64, 3, at))
        at += 24
        out.append(np.frombuffer(raw, f"{chr(kind)}{size}", n, at))
        at += n * size
    return out


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted sequence changes, the first place included."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _shard_of(word: np.ndarray, before: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    h = np.where(np.isin(word, hot), mix(word ^ (before * np.uint64(0x9E3779B97F4A7C15))), word)
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _messages(tokens: np.ndarray, n: np.ndarray, train: np.ndarray, ids: np.ndarray, known: np.ndarray, hot: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """A unit's part for each shard."""
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(tokens)) - first[doc]
    word, at = np.unique(np.append(tokens, START), return_inverse=True)
    start = at[-1]
    c = at[:-1].astype(np.uint64)
    b = np.where(place >= 1, np.roll(c, 1), np.uint64(start))
    a = np.where(place >= 2, np.roll(c, 2), np.uint64(start))
    shard = _shard_of(word[c], word[b], hot, shards)
    bits = np.uint64(max(1, int(len(word)).bit_length()))
    if 3 * int(bits) <= 64:
        order = np.argsort((c << (bits + bits)) | (b << bits) | a, kind="stable")
        order = order[np.argsort(shard[order].astype(np.uint16 if shards < 1 << 16 else np.int64), kind="stable")]
    else:
        order = np.lexsort((a, b, c, shard))
    shard, doc, a, b, c = shard[order], doc[order], a[order], b[order], c[order]
    tri = _heads(shard, c, b, a)
    n_train = np.add.reduceat(train[doc].astype(np.int64), tri) if len(tri) else np.zeros(0, np.int64)
    places = np.diff(np.append(tri, len(doc)))
    cuts = np.searchsorted(shard[tri], np.arange(shards + 1))
    for s in np.unique(shard):
        lo, hi = cuts[s], cuts[s + 1]
        t = tri[lo:hi]
        pair = _heads(c[t], b[t])
        one = _heads(c[t[pair]])
        docs = doc[tri[lo] : tri[hi] if hi < len(tri) else len(doc)]
        last = doc[tri[lo] : tri[hi] if hi < len(tri) else len(doc)][np.repeat(word[c[t]] == END, places[lo:hi])]
        before = word[b[t[pair]]] >> np.uint64(24)
        yield int(s), _pack(
            word[c[t[pair[one]]]], np.diff(np.append(one, len(pair))), before >> np.uint64(32), before & np.uint64(0xFFFFFFFF), np.diff(np.append(pair, len(t))),
            word[a[t]] >> np.uint64(32), n_train[lo:hi], places[lo:hi], docs, last, n[last], ids[last].view(np.uint64), known[last].astype(np.uint8), (~train[last]).astype(np.uint8),
        )


def _send(batches: Iterator[pa.RecordBatch], hot: np.ndarray, shards: int, unit_tokens: int) -> Iterator[pa.RecordBatch]:
    unit, parts, size = TaskContext.get().partitionId() << 32, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        tokens, n, train, ids, known = (np.concatenate(x) for x in zip(*parts, strict=True))
        rows = [(s, blob) for s, blob in _messages(tokens, n, train, ids, known, hot, shards)]
        for lo in range(0, len(rows), 16):
            s, blob = zip(*rows[lo : lo + 16], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array([unit] * len(s), pa.int64()), pa.array(blob, pa.binary())], names=["shard", "unit", "payload"])

    for batch in batches:
        out = batch.column("held_out").to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id")
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        for lo, hi, tokens, n in _tokens(batch):
            parts.append((tokens, n, ~out[lo:hi], ids[lo:hi], known[lo:hi]))
            size += len(tokens)
            if size >= unit_tokens:
                yield from flush()
                unit, parts, size = unit + 1, [], 0
    if size:
        yield from flush()


def _codes(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log10(x) * STEPS).astype(np.int16)


def _relative(parent_size: np.ndarray, child: np.ndarray) -> np.ndarray:
    """Children's values, each range counted on from the last value of the range before it, so all rise."""
    end = np.cumsum(parent_size)
    last = child[end - 1] + np.uint64(1)
    base = np.concatenate([[np.uint64(0)], np.cumsum(last)[:-1]]) if len(last) else last
    return child + np.repeat(base, parent_size)


class Trie:
    """Levels of n-grams by last word, the word before it and the word before that, with 16-bit logarithms of numerators and,
    for what can be a context, of denominators."""

    def __init__(self, word: np.ndarray, n_pair: np.ndarray, before: np.ndarray, n_tri: np.ndarray, third: np.ndarray, count: np.ndarray, hot: dict[int, int], total: int, kinds: int, alpha: float, mu: float):
        """Of sorted distinct words with the numbers of their pairs, pairs with the numbers of their triples, and counts of
        triples. A pair's and a word's counts are their sums; those of hot words, dealt to several shards, are given."""
        pair_of = np.repeat(np.arange(len(n_tri)), n_tri)
        pair_count = np.bincount(pair_of, count, len(n_tri))
        word_count = np.bincount(np.repeat(np.arange(len(n_pair)), n_pair), pair_count, len(n_pair)).astype(np.int64)
        more = np.setdiff1d(np.array(sorted(k for k, v in hot.items() if v > 0), np.uint64), word)
        if len(more):  # hot words without an n-gram here are words all the same
            at = np.searchsorted(word, more)
            word, n_pair, word_count = np.insert(word, at, more), np.insert(n_pair, at, 0), np.insert(word_count, at, 0)
        for k, v in hot.items():
            word_count[word == np.uint64(k)] = v
        p1 = (word_count + 1) / (total + kinds + 1)
        of = np.repeat(np.arange(len(word)), n_pair)
        lower = alpha * (pair_count + mu * p1[of])
        some = n_pair > 0
        arrays = {"count": word_count, "word_num": _codes(alpha * mu * p1), "word_den": _codes(alpha * (word_count + mu))}
        arrays |= {"pair_num": _codes(lower), "pair_den": _codes(pair_count + alpha * (word_count[of] + mu)), "tri_num": _codes(count + lower[pair_of])}
        levels = {
            "words": word - word[:1].repeat(len(word)),
            "word_ends": np.concatenate([[0], np.cumsum(n_pair)]).astype(np.uint64),
            "pairs": _relative(n_pair[some], before),
            "pair_ends": np.concatenate([[0], np.cumsum(n_tri)]).astype(np.uint64),
            "triples": _relative(n_tri, third),
        }
        for name, values in levels.items():
            arrays |= {f"{name}.{k}": v for k, v in EliasFano.arrays(values).items()}
        self.least = word[0] if len(word) else np.uint64(0)
        arrays = self.map(arrays)
        self.levels = {name: EliasFano({k: arrays[f"{name}.{k}"] for k in ("shape", "low", "high", "before")}) for name in levels}
        self.arrays = arrays
        self.unknown = int(_codes(np.array([alpha * mu / (total + kinds + 1)]))[0]), int(_codes(np.array([alpha * mu]))[0])

    @staticmethod
    def map(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The arrays in one memory-mapped file, which is gone from its folder once it is open."""
        handle, path = tempfile.mkstemp(prefix="tidemark-trie-")
        try:
            with os.fdopen(handle, "wb") as f:
                at = {}
                for name, a in arrays.items():
                    at[name] = f.tell()
                    f.write(np.ascontiguousarray(a).tobytes())
                    f.write(b"\0" * (-f.tell() % 8 + 8))
            whole = np.memmap(path, np.uint8, "r")
        finally:
            os.unlink(path)
        return {name: np.ndarray(a.shape, a.dtype, whole, at[name]) for name, a in arrays.items()}

    def _children(self, level: str, ends: str, parent: np.ndarray, there: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the parents' children x (n for each parent), and whether they exist."""
        lo = self.levels[ends].access(np.where(there, parent, 0)).astype(np.int64)
        hi = np.where(there, self.levels[ends].access(np.where(there, parent, 0) + 1).astype(np.int64), lo) if len(parent) else lo
        base = np.zeros(len(parent), np.uint64)
        later = (lo > 0) & (hi > lo)
        base[later] = self.levels[level].access(lo[later] - 1) + np.uint64(1)
        of = np.repeat(np.arange(len(parent)), n)
        return self.levels[level].find(base[of] + x, lo[of], hi[of])

    def look_up(self, word: np.ndarray, n_pair: np.ndarray, before: np.ndarray, n_tri: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For nested n-grams: the codes of the triples (numerator less, but for END, the denominator of what it is the context
        of), and the words' counts."""
        a = self.arrays
        n_words = np.full(len(word), self.levels["words"].n)
        above = word >= self.least
        w, there = self.levels["words"].find(np.where(above, word - self.least, 0), np.zeros(len(word), np.int64), n_words)
        there &= above
        p, has_pair = self._children("pairs", "word_ends", w, there, n_pair, before)
        t, has_tri = self._children("triples", "pair_ends", p, has_pair, n_tri, third)
        pick = lambda name, i, ok, other: np.where(ok, a[name][np.where(ok, i, 0)].astype(np.int64), other) if len(a[name]) else np.broadcast_to(other, i.shape)
        word_num, word_den = pick("word_num", w, there, self.unknown[0]), pick("word_den", w, there, self.unknown[1])
        of = np.repeat(np.arange(len(word)), n_pair)
        pair_num, pair_den = pick("pair_num", p, has_pair, word_num[of]), pick("pair_den", p, has_pair, word_den[of])
        pair_den = np.where(word[of] == END, 0, pair_den)
        of_pair = np.repeat(np.arange(len(before)), n_tri)
        return pick("tri_num", t, has_tri, pair_num[of_pair]) - pair_den[of_pair], pick("count", w, there, 0)


def _merge(messages: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Training counts of all units as sorted nested arrays."""
    word = np.concatenate([m[0] for m in messages]).astype(np.uint64)
    n_pair = np.concatenate([m[1] for m in messages]).astype(np.int64)
    before = np.concatenate([(m[2].astype(np.uint64) << np.uint64(32)) | m[3].astype(np.uint64) for m in messages])
    n_tri = np.concatenate([m[4] for m in messages]).astype(np.int64)
    third = np.concatenate([m[5] for m in messages]).astype(np.uint64)
    count = np.concatenate([m[6] for m in messages]).astype(np.int64)
    words_, at = np.unique(word, return_inverse=True)
    pairs, at = np.unique((np.repeat(at, n_pair).astype(np.uint64) << np.uint64(40)) | before, return_inverse=True)
    key = (np.repeat(at, n_tri).astype(np.uint64) << np.uint64(32)) | third
    key, count = key[count > 0], count[count > 0]
    order = np.argsort(key)
    key, count = key[order], count[order]
    head = _heads(key)
    count = np.add.reduceat(count, head) if len(head) else count
    key = key[head]
    pair = (key >> np.uint64(32)).astype(np.int64)
    head = _heads(pair)
    n_tri = np.diff(np.append(head, len(pair)))
    pairs = pairs[pair[head]]
    of = (pairs >> np.uint64(40)).astype(np.int64)
    head = _heads(of)
    return words_[of[head]], np.diff(np.append(head, len(of))), pairs & np.uint64((1 << 40) - 1), n_tri, key & np.uint64(0xFFFFFFFF), count


def _answer(table: pa.Table, hot: dict[int, int], total: int, kinds: int, alpha: float, mu: float) -> pa.Table:
    messages = [_unpack(x) for x in table["payload"].to_pylist()]
    trie = Trie(*_merge(messages), hot, total, kinds, alpha, mu)
    rows = []
    for unit, m in zip(table["unit"].to_pylist(), messages, strict=True):
        word, n_pair, n_tri, places, docs = m[0].astype(np.uint64), m[1].astype(np.int64), m[4].astype(np.int64), m[7].astype(np.int64), m[8].astype(np.int64)
        before = (m[2].astype(np.uint64) << np.uint64(32)) | m[3].astype(np.uint64)
        code, count = trie.look_up(word, n_pair, before, n_tri, m[5].astype(np.uint64))
        of = np.repeat(np.repeat(np.repeat(np.arange(len(word)), n_pair), n_tri), places)
        hit, at = np.unique(docs, return_inverse=True)
        sums = [np.bincount(at, x, len(hit)) for x in (np.repeat(code, places), np.log10(count + 1.0)[of], (count > 0)[of])]
        rows.append((unit, hit.astype(np.int32), sums[0].astype(np.int32), sums[1], sums[2].astype(np.int32), *(m[k].astype(np.uint64).view(np.int64) for k in range(9, 14))))
    names = [c.split()[0] for c in ANSWER.split(", ")]
    lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x) for x in c])).astype(np.int32), pa.array(np.concatenate(c))) for c in list(zip(*rows, strict=True))[1:]]
    release()
    return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *lists], names=names)


def _sum(table: pa.Table) -> pa.Table:
    """A unit's texts, with what all shards found for them added up."""
    flat = lambda name: table[name].combine_chunks().flatten().to_numpy()
    doc, last = flat("doc"), flat("last")
    n = len(last)
    put = np.empty(n, np.int64)
    put[last] = np.arange(n)
    given = {name: flat(name)[put] for name in ("n_tokens", "doc_id", "known", "held_out")}
    order = np.lexsort((flat("code"), flat("base"), doc))  # one order of addition, whatever the order of arrival
    total = lambda name: np.bincount(doc[order], flat(name)[order], n)
    return pa.table({
        "doc_id": pa.array(given["doc_id"], mask=given["known"] == 0), "held_out": given["held_out"] > 0, "n_tokens": given["n_tokens"],
        "code": total("code").astype(np.int64), "base": total("base"), "n_known": total("n_known").astype(np.int64),
    })


def language_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_mod: int = 7,
    held_rest: int = 2,
    alpha: float = ALPHA,
    mu: float = MU,
    unit_tokens: int = UNIT_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score (one-word model) and score.

    All texts that are not held out are learnt from, all are scored whole. A null or empty text is the end token alone. A null id
    is learnt from; rows that repeat an id are texts of their own. An empty table gives no rows; other columns are not read. A
    text of any length stays in one unit, whose memory grows with it. ``docs`` is read twice and should be read alike if a task
    runs again, as tables are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held(F.col(id_col), held_mod, held_rest).alias("held_out"))
    counted = rows.mapInArrow(frugal(_count), COUNTED).groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))
    counted = materialise(counted, "words")
    some = lambda c: F.coalesce(c, F.lit(0))
    size = counted.agg(some(F.sum("n")).alias("n"), some(F.sum("n_all")).alias("all"), F.count_if(F.col("n") > 0).alias("kinds"), some(F.max(F.when(F.col("word") == int(END), F.col("n")))).alias("texts")).first()
    often = counted.where(F.col("n_all") > size["all"] // HOT_WORDS).orderBy(F.desc("n_all")).limit(HOT_WORDS).collect()
    forget(docs.sparkSession, counted)
    total, kinds = size["n"], size["kinds"]
    hot = {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in often}
    shards = max(1, math.ceil(size["all"] / shard_tokens))
    send = partial(_send, hot=np.array(sorted(hot), np.uint64), shards=shards, unit_tokens=unit_tokens)

    def answer(table: pa.Table) -> pa.Table:
        return _answer(table, hot, total, kinds, alpha, mu)

    answers = rows.mapInArrow(frugal(send), SENT).groupBy("shard").applyInArrow(answer, ANSWER)
    # every text opens in the context of two starts, which as many training texts do
    opening = int(_codes(np.array([size["texts"] + alpha * (size["texts"] + mu)]))[0])
    summed = answers.groupBy("unit").applyInArrow(_sum, SUMMED)
    return summed.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(total + kinds + 1)).alias("base_score"), ((F.col("code") - opening) / STEPS).alias("score"),
    )
