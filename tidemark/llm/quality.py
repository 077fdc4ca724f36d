"""Quality classifier: a generalised additive model with pairwise interactions over features of whole texts.

Each feature is cut into bins at quantiles. Boosting goes round the features in turn and fits a tree of at most three leaves
on one feature each time, so all it learns of a feature adds up to one lookup table; then the pairs with most left to
explain get tables of their own from trees that split one feature and then the other. A score is a sum of lookups.

Training uses at most ``TRAIN_ROWS`` labelled rows, those of the smallest hashes of their ids: a bound, whatever the corpus
holds. Rows whose crc32(doc_id as text) mod 3 is 1 are held out. Labels, language, source and id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._shared import hashed_sample

TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, RATE, RIDGE = 120, 0.1, 2.0

FEATURES = [
    "log_words", "log_chars", "word_length", "longest_word", "upper", "digit", "space", "newline", "stop", "comma", "loud",
    "bar", "symbol", "other_mark", "beyond_ascii", "caps_words", "echo_words", "distinct_words", "short_words", "long_words",
    "marked_words", "line_words", "repeated_lines", "distinct_pairs",
]


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


def _range(lo: int, hi: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[lo:hi] = True
    return out


UPPER, LOWER, DIGIT, WIDE = _range(65, 91), _range(97, 123), _range(48, 58), _range(0xC0, 256)
LOUD, SYMBOL = _mask("!?"), _mask("#$%&*@^~_=+<>/\\")
OTHER = (_range(33, 48) | _range(58, 65) | _range(91, 97) | _range(123, 127)) & ~LOUD & ~SYMBOL & ~_mask(".,|")


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes in each row."""
    key = np.sort((row.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return np.diff(np.searchsorted(key >> np.uint64(52), np.arange(n + 1)))


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of FEATURES for runs of texts; an empty or null text has zeros."""
    for lo, hi, data, offsets in _text.slices(column, 1 << 19):
        n = hi - lo

        def count(table: np.ndarray, data: np.ndarray = data, offsets: np.ndarray = offsets) -> np.ndarray:
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(table[data], out=sums[1:])
            return sums[offsets[1:]] - sums[offsets[:-1]]

        chars = np.maximum(count(~_range(0x80, 0xC0)), 1)
        h, starts, ends, first = _text.words(data, offsets, _text.SOLID)
        row = np.repeat(np.arange(n), np.diff(first))
        words = np.maximum(np.diff(first), 1)
        size = ends - starts

        def per_word(flag: np.ndarray, row: np.ndarray = row, n: int = n) -> np.ndarray:
            return np.bincount(row, weights=flag, minlength=n)

        def within(table: np.ndarray, data: np.ndarray = data, starts: np.ndarray = starts, ends: np.ndarray = ends) -> np.ndarray:
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(table[data], out=sums[1:])
            return sums[ends] - sums[starts]

        longest = np.zeros(n)
        np.maximum.at(longest, row, size)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        pair = _text.mix(h[:-1] * np.uint64(31) + h[1:]) if len(h) > 1 else h[:0]
        pair_row = row[:-1][row[1:] == row[:-1]] if len(h) > 1 else row[:0]
        pair = pair[row[1:] == row[:-1]] if len(h) > 1 else pair
        l_start, l_end = _text.runs(data != 10, offsets)
        l_first = np.searchsorted(l_start, offsets)
        l_row = np.repeat(np.arange(n), np.diff(l_first))
        lines = np.maximum(np.diff(l_first), 1)
        upper = within(UPPER)
        columns = [
            np.log1p(np.diff(first)),
            np.log1p(np.diff(offsets)),
            per_word(size) / words,
            np.minimum(longest, 200),
            count(UPPER) / chars,
            count(DIGIT) / chars,
            count(_mask(" ")) / chars,
            count(_mask("\n")) / chars,
            count(_mask(".")) / words,
            count(_mask(",")) / words,
            count(LOUD) / words,
            count(_mask("|")) / words,
            count(SYMBOL) / words,
            count(OTHER) / words,
            count(WIDE) / chars,
            per_word((upper > 1) & (within(LOWER) == 0)) / words,
            per_word(same) / words,
            _distinct(row, h, n) / words,
            per_word(size <= 2) / words,
            per_word(size > 15) / words,
            per_word(within(SYMBOL) > 0) / words,
            words / lines,
            1 - _distinct(l_row, _text.span_hashes(data, l_start, l_end), n) / lines,
            _distinct(pair_row, pair, n) / np.maximum(np.bincount(pair_row, minlength=n), 1),
        ]
        out = np.stack(columns, axis=1)
        out[np.diff(offsets) == 0] = 0
        yield out


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins in two."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = gl[-1] + g[-1] - gl, hl[-1] + h[-1] - hl
    total = (gl[-1] + g[-1]) ** 2 / (hl[-1] + h[-1] + RIDGE)
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - total
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _stump(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over the bins of one feature, as a value for each bin."""
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        found = [(*_best_cut(g[a:b], h[a:b]), a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        gain, k, a = max(found)
        if gain <= 1e-9:
            break
        cuts = sorted([*cuts, a + k])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _crossed(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree that cuts the first feature, then the second on either side, as a value for each pair of bins."""
    best, out = 0.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        gain, value = 0.0, np.zeros_like(g)
        for part in (slice(0, cut), slice(cut, None)):
            gs, hs = g[part].sum(0), h[part].sum(0)
            more, k = _best_cut(gs, hs)
            gain += more + gs.sum() ** 2 / (hs.sum() + RIDGE)
            for side in (slice(0, k), slice(k, None)):
                if gs[side].size:
                    value[part, side] = gs[side].sum() / (hs[side].sum() + RIDGE)
        if gain > best:
            best, out = gain, value
    return out


@dataclass
class Additive:
    """Lookup tables of one feature each and of pairs; ``score`` adds them up."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def _bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        """Boost on 0/1 labels; with one class only, or no rows, the score is the (smoothed) share of ones."""
        share = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(share / (1 - share)))
        if not 0 < y.sum() < len(y):
            return self
        cuts = lambda n: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) for j in range(x.shape[1])]
        self.edges, self.coarse = cuts(BINS), cuts(PAIR_BINS)
        bins, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        total = np.full(len(y), self.start)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                g, h = slopes()
                step = RATE * _stump(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)))
                table += step
                total += step[bins[j]]
        g, h = slopes()
        gains = []
        for i in range(len(coarse)):
            for j in range(i + 1, len(coarse)):
                code, n = coarse[i] * PAIR_BINS + coarse[j], PAIR_BINS * PAIR_BINS
                gains.append((float((np.bincount(code, g, n) ** 2 / (np.bincount(code, h, n) + RIDGE)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]
        for _ in range(ROUNDS // 4):
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                g, h = slopes()
                code, n = coarse[i] * PAIR_BINS + coarse[j], PAIR_BINS * PAIR_BINS
                step = RATE * _crossed(*(np.bincount(code, v, n).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h)))
                table += step
                total += step[coarse[i], coarse[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for table, b in zip(self.tables, self._bins(x, self.edges), strict=True):
            total += table[b]
        if self.pairs:
            coarse = self._bins(x, self.coarse)
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that training never sees; a null id is not held out (and has no label)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.concatenate([np.zeros((0, len(FEATURES))), *features(batch.column(1))])
        flat = pa.array(x.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Additive:
    """Fit on at most ``rows`` labelled documents that are not held out. Several labels of one id count as their least, and of
    several texts of one id the one of the least md5 counts."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    known = hashed_sample(known.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id", rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("digest"), "text"))
    picked = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(one.alias("one")).select("label", "one.text")  # at most ``rows`` rows
    table = picked.mapInArrow(_text.frugal(_measure), "label int, x array<double>").toArrow()
    x = np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in table["x"].chunks)]).reshape(-1, len(FEATURES))
    y = table["label"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the result does not depend on the order in which tasks end
    return Additive().fit(x[order], y[order])


def _score(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, len(FEATURES))), *features(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], names=["doc_id", "score"])

    return work


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: held_out, score (0 to 1), predicted (1 where score >= 0.5).

    Empty and null texts are scored like any other; rows that repeat a document each give a row; without labels every score
    is 0.5; an empty table gives an empty result; other columns are not read. A very long text is measured whole.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(_text.frugal(_score(model)), "doc_id long, score double")
    return scored.select(F.col("doc_id").alias(id_col), held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _sift(model, text_at: int, least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.pieces(batch):
                x = np.concatenate([np.zeros((0, len(FEATURES))), *features(part.column(text_at))])
                yield part.filter(pa.array(model.value.score(x) >= least))

    return work


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rows that score below ``least``. Null and empty texts are scored as texts without
    words, very long ones whole; rows that repeat are judged each; an empty table stays empty; without labels all rows stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # a frame's own names may be such as Arrow functions do not take
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema.fields])
    return plain.mapInArrow(_text.frugal(_sift(model, docs.columns.index(text_col), least)), schema).toDF(*docs.columns)
