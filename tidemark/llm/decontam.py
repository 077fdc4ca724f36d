"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Texts are lower-cased (A-Z) and split into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The automaton accepts every run of
words of any item; streaming a document's words through it tracks the longest match that ends at each word. A match of at
least ``window`` words (or a whole shorter item) is a hit, and all its words are hit words.

Streaming in Python costs per word, so a numpy pass first finds the stretches where every short gram of words, by hash,
belongs to some item; nothing outside such a stretch can match, and inside one the automaton reads the words themselves.

Test items are a stated query set. They travel in blocks of at most ``BLOCK_WORDS`` words, one pass over the documents for
each block, so no broadcast grows with them. What a pass found is stored before the next begins, so one block is held at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fresh
from . import _text
from ._shared import forget, materialise

WINDOW = 10
GRAM = 4
BLOCK_WORDS = 500_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """Suffix automaton of word sequences; state arrays ``length``, ``link``, ``step`` (transitions) and item sets."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.length, self.link, self.step = [0], [-1], [{}]
        ends: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        whole: list[tuple[str, list[bytes]]] = []
        for item_id, words in items:
            state = 0
            for word in words:
                state = self._extend(state, word)
                ends.setdefault(state, set()).add(item_id)
            if 0 < len(words) < window:
                whole.append((item_id, words))
        # an item ends wherever a longer suffix of it ends: sets flow along links, as far as windows reach
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            up = self.link[state]
            if up > 0 and self.length[up] >= window and state in ends:
                ends.setdefault(up, set()).update(ends[state])
        self.items = {s: sorted(x) for s, x in ends.items() if self.length[s] >= window}
        for item_id, words in whole:
            state = 0
            for word in words:
                state = self.step[state][word]
            self.short.setdefault(state, []).append((len(words), item_id))

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.step[last]:
            there = self.step[last][word]
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new = self._state(self.length[last] + 1, 0, {})
        while last != -1 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last != -1:
            there = self.step[last][word]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        return new

    def _split(self, last: int, word: bytes, there: int) -> int:
        twin = self._state(self.length[last] + 1, self.link[there], dict(self.step[there]))
        self.link[there] = twin
        while last != -1 and self.step[last].get(word) == there:
            self.step[last][word] = twin
            last = self.link[last]
        return twin

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit intervals of word positions, and the items whose windows occur."""
        state, matched = 0, 0
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        for i, word in enumerate(words):
            while state and word not in self.step[state]:
                state = self.link[state]
                matched = self.length[state]
            if word not in self.step[state]:
                state = matched = 0
                continue
            state, matched = self.step[state][word], matched + 1
            reach = 0
            if matched >= self.window:
                at = state
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                reach = self.window
                found.update(self.items.get(at, ()))
            if self.short:
                at = state
                while at > 0:
                    for n, item_id in self.short.get(at, ()):
                        if n <= matched:
                            reach = max(reach, n)
                            found.add(item_id)
                    at = self.link[at]
            if reach:
                lo = i + 1 - reach
                while hits and hits[-1][1] >= lo:
                    lo = min(lo, hits.pop()[0])
                hits.append((lo, i + 1))
        return hits, found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and out[-1][1] >= lo:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


class Scanner:
    """Finds hits of one block of items in runs of texts."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.automaton = Automaton(items, window)
        sizes = [len(w) for _, w in items if w]
        self.least = min([window, *sizes])
        self.gram = min(GRAM, self.least)
        grams = [np.zeros(0, np.uint64)]
        for _, words in items:
            if words:
                text = np.frombuffer(b" ".join(words), np.uint8)
                h = _text.words(text, np.array([0, len(text)]), _text.ALNUM)[0]
                grams.append(self._grams(h))
        self.known = np.unique(np.concatenate(grams))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.known >> np.uint64(44)] = True

    def _grams(self, h: np.ndarray) -> np.ndarray:
        n = max(0, len(h) - self.gram + 1)
        g = np.zeros(n, np.uint64)
        for k in range(self.gram):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
        return _text.mix(g)

    def hits(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int, int]], set[str]]]:
        """For each text: words, ``(first word, word after, first byte, byte after)`` of its hits, items found."""
        for lo, hi, data, offsets in _text.slices(column):
            h, starts, ends, first = _text.words(data, offsets, _text.ALNUM)
            g = self._grams(h)
            good = np.flatnonzero(self.bits[g >> np.uint64(44)])
            good = good[np.isin(g[good], self.known)]
            spans: dict[int, list[tuple[int, int]]] = {}
            if len(good):
                doc = np.searchsorted(first, good, "right") - 1
                inside = good + self.gram <= first[doc + 1]
                good, doc = good[inside], doc[inside]
            if len(good):
                new = np.ones(len(good), bool)
                new[1:] = (good[1:] != good[:-1] + 1) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(good)))
                for b, n in zip(begin, size, strict=True):
                    if n + self.gram - 1 >= self.least:
                        spans.setdefault(int(doc[b]), []).append((int(good[b]), int(good[b] + n + self.gram - 1)))
            low = _text.LOWER[data].tobytes() if spans else b""
            for r in range(hi - lo):
                out: list[tuple[int, int, int, int]] = []
                found: set[str] = set()
                for a, b in spans.get(r, ()):
                    got, some = self.automaton.stream([low[starts[i] : ends[i]] for i in range(a, b)])
                    found |= some
                    out += [
                        (a + x - int(first[r]), a + y - int(first[r]), int(starts[a + x] - offsets[r]), int(ends[a + y - 1] - offsets[r]))
                        for x, y in got
                    ]
                yield int(first[r + 1] - first[r]), out, found


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    rows = items.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).where(F.col(item_col).isNotNull())
    block, n = [], 0
    for item_id, text in rows.toLocalIterator():
        words = WORD.findall((text or "").encode().translate(bytes(_text.LOWER)))
        if not words:
            continue
        if block and n + len(words) > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((item_id, words))
        n += len(words)
    if block:
        yield block


_built: dict[str, Scanner] = {}


def scanner_of(block: str, items, window: int) -> Scanner:
    """The scanner of a block, built once per Python worker, which keeps that of the last block it saw."""
    if block not in _built:
        _built.clear()
        _built[block] = Scanner(items.value, window)
    return _built[block]


def _pass(items, window: int, text_at: int, width: int):
    block = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(block, items, window)
        for batch in (part for whole in batches for part in _text.pieces(whole)):
            n_words, hits, found = [], [], []
            earlier = batch.column(width + 1).to_pylist()
            known = batch.column(width + 2).to_pylist()
            for r, (n, got, some) in enumerate(scanner.hits(batch.column(text_at))):
                flat = earlier[r] or []
                if flat and got or len(got) > 1:
                    old = [tuple(flat[i : i + 4]) for i in range(0, len(flat), 4)]
                    by = _merge([(a, b) for a, b, _, _ in [*old, *got]])
                    first = {a: c for a, _, c, _ in [*old, *got]}
                    end = {b: d for _, b, _, d in [*old, *got]}
                    got = [(a, b, first[a], end[b]) for a, b in by]
                elif flat:
                    got = [tuple(flat[i : i + 4]) for i in range(0, len(flat), 4)]
                n_words.append(n)
                hits.append([x for span in got for x in span])
                found.append(sorted(some | set(known[r] or [])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))],
                names=batch.schema.names,
            )

    return work


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with three columns more, named by ``scan_names``: words (count), hits (flat list: first word, word after, first
    byte, byte after) and found (sorted item ids). Null and empty texts have no words. Without items, or with empty ones only,
    nothing is hit; rows that repeat are scanned each; an empty table stays empty. A very long text is one row of a small batch."""
    rows, work = _scanned(docs, items, text_col, window, item_col, item_text)
    return rows.mapInArrow(_text.frugal(work), _nullable(rows)).toDF(*docs.columns, *scan_names(docs))


def scan_names(docs: DataFrame) -> list[str]:
    """Names of the columns that ``scan`` adds: words, hits, found, with underscores so that none is one of the frame's."""
    return fresh(docs.columns, "words", "hits", "found")


def _nullable(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])


def _scanned(docs: DataFrame, items: DataFrame, text_col: str, window: int, item_col: str = "item_id", item_text: str = "text"):
    """Rows after all blocks of items but the last, and the pass of the last block."""
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]  # a frame's own names may be such as Arrow functions do not take
    text_at = docs.columns.index(text_col)
    empty = (F.lit(0).cast("long"), F.array().cast("array<bigint>"), F.array().cast("array<string>"))
    first = out = docs.toDF(*names).select("*", *[c.alias(n) for c, n in zip(empty, ("words", "hits", "found"), strict=True)])
    blocks = _blocks(items, item_col, item_text)
    block = next(blocks, [])
    while True:
        shared = spark.sparkContext.broadcast(block)
        work = _pass(shared, window, text_at, len(names))
        block = next(blocks, None)
        if block is None:
            return out, work
        before, out = out, materialise(out.mapInArrow(_text.frugal(work), _nullable(out)), "scanned")
        shared.destroy()
        if before is not first:
            forget(spark, before)


def n_hit(hits: str) -> Column:
    """Hit words of a row of ``scan``, by its column of hits."""
    at = lambda k: f"coalesce(try_element_at(`{hits}`, cast(k * 4 + {k} as int)), 0L)"
    return F.expr(f"aggregate(sequence(0, cast(size(`{hits}`) div 4 as int)), 0L, (s, k) -> s + {at(2)} - {at(1)})")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 (ids sorted as strings, comma-joined), contaminated.

    Rows that repeat a document each give a row; null ids stay null; empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words, hits, found = scan_names(rows)
    return scan(rows, items).select(
        F.col("doc_id").alias(id_col),
        F.col(words).alias("n_words"),
        n_hit(hits).alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(hits) > 0).alias("contaminated"),
    )


def _cut(text_at: int, width: int, max_coverage: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _text.pieces(whole)):
            texts, keep = batch.column(text_at).to_pylist(), []
            for r, flat in enumerate(batch.column(width + 1).to_pylist()):
                spans = [flat[i : i + 4] for i in range(0, len(flat or []), 4)]
                words = batch.column(width)[r].as_py()
                keep.append(sum(b - a for a, b, _, _ in spans) <= max_coverage * max(words, 1))
                if spans:
                    raw, at, parts = texts[r].encode(), 0, []
                    for _, _, lo, hi in spans:
                        parts.append(raw[at:lo])
                        at = hi
                    texts[r] = b"".join([*parts, raw[at:]]).decode()
            columns = list(batch.columns[:width])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width]).filter(pa.array(keep, pa.bool_()))

    return work


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.8) -> DataFrame:
    """``docs`` (all its columns) with every hit span cut out of its text; a document of which hits cover more than
    ``max_coverage`` of its words is removed altogether. Texts without hits, null and empty ones stay byte for byte, whatever
    their length; rows that repeat are judged each; an empty table stays empty, and without items all rows stay."""
    rows, work = _scanned(docs, items, text_col, window)
    cut = _cut(docs.columns.index(text_col), len(docs.columns), max_coverage)
    kept = rows.mapInArrow(_text.frugal(work, cut), _nullable(rows.drop("words", "hits", "found")))
    return kept.toDF(*docs.columns)
