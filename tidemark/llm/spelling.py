"""Spelling variants: words one inserted, deleted or replaced code point apart, found by dense tiles of words that agree outside
one third.

Words are counted by Spark. A single edit leaves two of three parts of a word as they are, so each word is sent to the blocks of
its first two parts, of its last two and of its outer two (as the shorter word of a pair and as the longer one); two words one
edit apart meet in at least one block, and nothing is lost. A block is a padded matrix of code points, one aligned to the left
and one to the right; all its rows meet all, and a pair is an edit apart if common prefix plus common suffix reach the longer
length minus one. A pair that meets in several blocks counts in the first kind only. Blocks of over ``TILE`` words are dealt to
parts and every pair of parts is a tile of its own, so no task holds a block whole, however common its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import forget, materialise
from ._text import frugal

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_CHARS, LEAST_COUNT, FACTOR = 7, 2, 10
#: One in so many (document, run) pairs loses a letter: the planted slips of the pen.
SLIP = 31
#: Most rows of one side of a tile, and most matrix cells of a stack of tiles.
TILE, CELLS = 1024, 1 << 23

NEAR = "word string, n_near long, best_n long, best string"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, slip: int | None = SLIP) -> DataFrame:
    """``(word, n)`` of the words of whole texts, A-Z lower-cased. With ``slip``, a run whose crc32 of ``<id>:<run>`` it divides
    loses the code point at that crc32 modulo its length. A null id counts as an empty one; null and empty texts have no words."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{least_chars},}}"), 0)  # a shorter run never grows
    r = F.col("run")
    low = F.when(F.octet_length(r) == F.length(r), F.lower(r)).otherwise(F.translate(r, UPPER, LOWER))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", low.alias("word"))
    if slip:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        words = words.withColumn("at", (F.col("h") % F.length("word")).cast("int"))
        cut = F.concat(F.expr("substr(word, 1, at)"), F.expr("substr(word, at + 2)"))
        words = words.withColumn("word", F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word"))).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _keys(word: Column, short: Column) -> list[Column]:
    """Block keys of a word in the class of pairs whose shorter word has ``short`` letters: a third from each end is ``a``."""
    a = F.floor((short + 1) / 3).cast("int")
    kept = short - a
    tail = lambda n: F.substring(word, F.length(word) - n + 1, n)
    head = lambda n: F.substring(word, F.lit(1), n)
    said = [("0", head(kept)), ("1", tail(kept)), ("2", F.concat(head(a), F.lit(" "), tail(a)))]
    return [F.struct(short.cast("int").alias("short"), F.concat(F.lit(kind), text).alias("key")) for kind, text in said]


def blocks(words: DataFrame) -> DataFrame:
    """``(short, key, p, q, part, word, n)``: each word in its six blocks, blocks of over TILE words dealt to tiles (p, q)."""
    m = F.length("word")
    keyed = words.select("word", "n", F.explode(F.array(*_keys(F.col("word"), m), *_keys(F.col("word"), m - 1))).alias("k")).select("k.*", "word", "n")
    large = keyed.groupBy("short", "key").agg(F.count("*").alias("size")).where(F.col("size") > TILE)
    dealt = keyed.join(large, ["short", "key"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("size") / TILE), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("part", F.expr("cast(pmod(xxhash64(word), parts) as int)")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("short", "key", F.least("part", "x").alias("p"), F.greatest("part", "x").alias("q"), "part", "word", "n")


def _common(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common starts of all rows of a with all of b, stacked: (t, m, w) and (t, k, w) to (t, m, k)."""
    differ = a[:, :, None, :most] != b[:, None, :, :most]
    return np.where(differ.any(-1), differ.argmax(-1), most)


def _tiles(short: int, kind: int, words: _Words, mine: np.ndarray, other: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a stack of tiles, rows ``mine`` (t, m) against rows ``other`` (t, k), -1 for none: how many of the others each of
    mine is an edit from, and the first of them (-1 for none).

    ``within`` says whether a tile compares one part with itself; else only rows of different parts meet.
    """
    a, b = np.maximum(mine, 0), np.maximum(other, 0)
    # only the first and last ``short`` letters are compared, so padding never counts
    prefix = _common(words.left[a], words.left[b], short)
    suffix = _common(words.right[a], words.right[b], short)
    is_short = (words.length[a] == short)[:, :, None], (words.length[b] == short)[:, None, :]
    ok = (mine >= 0)[:, :, None] & (other >= 0)[:, None, :] & (is_short[0] | is_short[1]) & (mine[:, :, None] != other[:, None, :])
    ok &= within[:, None, None] | (words.part[a][:, :, None] != words.part[b][:, None, :])
    near = ok & (prefix + suffix >= short - (is_short[0] & is_short[1]))  # the longer length minus one
    kept = short - (short + 1) // 3
    if kind >= 1:  # pairs that an earlier kind of block holds as well count there
        near &= prefix < kept
    if kind >= 2:
        near &= suffix < kept
    return near.sum(-1), np.where(near.any(-1), near.argmax(-1), -1)


class _Words(NamedTuple):
    """Padded code-point matrices of sorted rows, aligned to the left and (reversed) to the right."""

    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    part: np.ndarray


def _matrices(words: pa.Array, part: np.ndarray) -> _Words:
    length = pc.utf8_length(words).to_numpy().astype(np.int64)
    codes = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
    start = (np.cumsum(length) - length)[:, None]
    col = np.arange(int(length.max()))
    inside = col < length[:, None]
    left = np.where(inside, codes[np.minimum(start + col, len(codes) - 1)], 0)
    right = np.where(inside, codes[np.maximum(start + length[:, None] - 1 - col, 0)], 0)
    return _Words(left, right, length, part)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of batches sorted by tile, in it by falling n and word; a tile that a batch ends in waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        edges = _edges(table)
        last = int(edges[-2])
        if last:
            yield from _near(table.slice(0, last), edges[:-1])
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _near(table, _edges(table))


def _edges(table: pa.Table) -> np.ndarray:
    """Starts of the tiles and, last, the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in ("short", "key", "p", "q"):
        c = table[name].combine_chunks()
        if table.num_rows > 1:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), table.num_rows)


def _near(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(edges)
    first = edges[:-1][sizes > 1]
    sizes = sizes[sizes > 1]
    if not len(sizes):
        return
    text, n, short = table["word"].combine_chunks(), table["n"].to_numpy(), table["short"].to_numpy()
    words = _matrices(text, table["part"].to_numpy())
    kind = pc.utf8_slice_codeunits(table["key"].combine_chunks(), 0, 1).cast(pa.int8()).to_numpy()
    within = (table["p"].to_numpy() == table["q"].to_numpy())[first]
    power = np.ceil(np.log2(sizes)).astype(np.int64)
    group = (short[first].astype(np.int64) * 3 + kind[first]) * 64 + power
    at, near, best = [], [], []
    for g in np.unique(group):
        stack = np.flatnonzero(group == g)
        m, s, k = 1 << int(g % 64), int(g // 192), int(g // 64 % 3)
        strip = min(m, max(1, CELLS // (m * s)))  # a large tile goes by strips of its rows
        step = max(1, CELLS // (m * m * s))
        for lo in range(0, len(stack), step):
            t = stack[lo : lo + step]
            slot = np.arange(m)
            rows = np.where(slot < sizes[t][:, None], first[t][:, None] + slot, -1)
            for x in range(0, m, strip):
                mine = rows[:, x : x + strip]
                counts, where = _tiles(s, k, words, mine, rows, within[t])
                hit = np.nonzero(counts)
                at.append(mine[hit])
                near.append(counts[hit])
                best.append(rows[hit[0], where[hit]])
    at, near, best = np.concatenate(at), np.concatenate(near), np.concatenate(best)
    if len(at):
        columns = [text.take(pa.array(at)), pa.array(near.astype(np.int64)), pa.array(n[best]), text.take(pa.array(best))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` of words with near words; best has the largest n, then comes first in code points."""
    tiles = blocks(words).repartition("short", "key", "p", "q").sortWithinPartitions("short", "key", "p", "q", F.desc("n"), "word")
    found = tiles.mapInArrow(frugal(_compare), NEAR)
    low = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), low.alias("low")).select("word", "n_near", (-F.col("low.m")).alias("best_n"), F.col("low.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: the last of the forms that follow one another, by doubling. Each form is at least
    ``FACTOR`` times as frequent as its word, so chains have at most 19 steps and five rounds are enough."""
    spark = forms.sparkSession
    at = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = at.alias("a").join(at.select(F.col("word").alias("w"), F.col("root").alias("further")), F.col("a.root") == F.col("w"), "left")
        step = materialise(step.select("a.word", F.coalesce("further", "a.root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        forget(spark, at)
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR, **counting) -> DataFrame:
    """One row per word: word, form (its most frequent near word, if at least ``factor`` times as frequent, else null), root (the
    last of forms, or itself), n, n_near, form_n.

    Null, empty and very long texts, repeated rows (each counts) and an empty table are fine; other columns are not read. Ties of
    n go to the first word in code-point order.
    """
    words = materialise(count_words(docs, id_col, text_col, **counting), "words")
    has = F.col("best_n") >= factor * F.col("n")
    near = words.join(near_words(words), "word", "left").select(
        "word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")
    )
    near = materialise(near, "near")
    last = roots(near.where("form IS NOT NULL"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
