"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Each source's documents, in the order of the md5 of their ids, are cut into blocks of ``block_docs``. A source of weight w
releases its k-th block (from 0) at slot floor(k/w), due by slot ceil((k+1)/w); each slot goes to the released block of
the earliest deadline, then of the first source by name. Weights add up to one, so every slot has a block, every block keeps its
deadline, and at any slot each source that still has blocks is less than one block from w times the slots, however long the
mixture and whatever the number of sources.

Nothing of that needs one task for all slots. At a slot B a source has had floor(wB) blocks or one more; which sources have one
more follows from the weights alone: of the blocks whose window B cuts, those of the earliest deadlines that still fit before B,
level by level from the latest release on, as many as there are free slots. So the slots are cut into periods, each knows the
blocks that fall into it, and each is scheduled by a fold over its own slots; the result is that of one pass over all of them.

Weights are whole numbers that add up to about ``RESOLUTION``, so they are exact to one part in that, the least of them one slot
in ``LONGEST``; slots and blocks may go up to 2**32. When a source runs out its slots stay empty and the others keep their relative weights; no document is dropped or
repeated. A period has ``PERIOD`` slots, or as many as there are sources or as the longest window has; work a slot grows with the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import fresh
from ._shared import materialise

BLOCK_DOCS = 16
PERIOD = 1000
RESOLUTION = 2**30
#: The least weight is one slot in so many.
LONGEST = 2**18
GROUP_ROWS = 100_000
ALPHA = 0.7

#: Blocks whose windows are cut at a slot, the latest releases first: the pool keeps the earliest deadlines, at most as many as
#: slots are free from that release on.
CHOSEN = """
slice(
  aggregate(
    levels,
    cast(array() as array<struct<deadline: long, i: int>>),
    (pool, l) -> slice(array_sort(concat(pool, l.cut)), 1, cast(greatest(0L, l.free) as int))),
  1, cast(more as int))
"""

#: One period's slots in turn: what is released joins the pending blocks, and the one of the earliest deadline goes. Slots go by
#: the thousand, so that no long array is copied for each.
PATTERN = """
flatten(aggregate(
  sequence(0L, {period}L - 1, 1000L),
  named_struct('next', 1, 'pending', {none}, 'out', cast(array() as array<array<{block}>>)),
  (whole, from) -> aggregate(
    array(aggregate(
      sequence(from, least(from + 999L, {period}L - 1)),
      named_struct('next', whole.next, 'pending', whole.pending, 'out', {none}),
      (state, t) -> aggregate(
        array(named_struct(
          'now', coalesce(try_element_at(released, state.next).release = t, false),
          'pending', if(coalesce(try_element_at(released, state.next).release = t, false), concat(state.pending, try_element_at(released, state.next).b), state.pending))),
        state,
        (s, x) -> named_struct(
          'next', s.next + cast(x.now as int), 'pending', array_remove(x.pending, array_min(x.pending)), 'out', array_append(s.out, array_min(x.pending)))))),
    whole,
    (w, part) -> named_struct('next', part.next, 'pending', part.pending, 'out', array_append(w.out, part.out))),
  whole -> whole.out))
"""
PATTERN_BLOCK = "struct<deadline: long, i: int, block: long>"


def target_weights(counts: DataFrame, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    """``(source, n, i, own, total)``: number in the order of names, and the weight as a whole number of ``total``.

    Weights are given, or the source's documents to the power ``alpha``; a given weight of a source not there is unused and
    a source without one counts as the least of those given.
    """
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        w = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(float(min(weights.values()))))
    everything = Window.partitionBy()  # a row a source
    own = F.greatest(F.lit(RESOLUTION // LONGEST), F.round(F.col("w") / F.sum("w").over(everything) * RESOLUTION)).cast("long")
    rows = counts.withColumn("w", w).withColumn("own", own).withColumn("total", F.sum("own").over(everything))
    return rows.withColumn("i", (F.row_number().over(Window.orderBy("source")) - 1).cast("int")).select("source", "n", "i", "own", "total")


def blocks_before(weighted: DataFrame, slots: DataFrame) -> DataFrame:
    """``(slot, i, own, total, done)``: how many blocks each source has had before each of the slots.

    ``done`` is the whole part of weight times slot, and one more for the chosen. A block that a slot cuts can be had before it
    if a slot is free: from a release on, what is free is the slots up to this one less the blocks that have to be had in them.
    """
    at = materialise(weighted.select("i", "own", "total").crossJoin(F.broadcast(slots)).withColumn("done", F.expr("own * slot div total")), "cuts")
    cut = at.where(F.expr("own * slot % total > 0")).select(
        "slot", F.expr("done * total div own").alias("release"), F.struct(F.expr("((done + 1) * total + own - 1) div own").alias("deadline"), "i").alias("c")
    )
    low = cut.groupBy("slot").agg(F.min("release").alias("low"))
    due = at.join(low, "slot").withColumn("first", F.expr("(own * low + total - 1) div total")).where("first < done")
    due = due.select("slot", "own", "total", F.explode(F.sequence("first", F.col("done") - 1)).alias("k")).select("slot", F.expr("k * total div own").alias("release"), F.lit(None).alias("c"))
    events = cut.unionByName(due).groupBy("slot", "release").agg(F.count_if(F.col("c").isNull()).alias("due"), F.collect_list("c").alias("cut"))
    back = Window.partitionBy("slot").orderBy(F.desc("release")).rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumns({"free": F.col("slot") - F.col("release") - F.sum("due").over(back), "level": F.count_if(F.size("cut") > 0).over(back)})
    levels = events.where("level > 0").groupBy("slot", "level").agg(F.min("free").alias("free"), F.flatten(F.collect_list("cut")).alias("cut"))
    levels = levels.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("level", "free", "cut"))).alias("levels"))
    left = at.groupBy("slot").agg((F.col("slot") - F.sum("done")).alias("more"))
    chosen = levels.join(left, "slot").select("slot", F.explode(F.expr(CHOSEN)).alias("c")).select("slot", "c.i", F.lit(1).alias("one"))
    return at.join(chosen, ["slot", "i"], "left").select("slot", "i", "own", "total", (F.col("done") + F.coalesce("one", F.lit(0))).alias("done"))


def schedule(weighted: DataFrame, last_slot: int, period: int) -> DataFrame:
    """``(i, block, slot)`` of all blocks of the periods up to that of ``last_slot``. A period is one row of an aggregation and
    one fold."""
    slots = weighted.sparkSession.range(last_slot // period + 2).select((F.col("id") * period).alias("slot"))
    done = materialise(blocks_before(weighted, slots), "done")
    after = done.select((F.col("slot") - period).alias("slot"), "i", F.col("done").alias("end"))
    job = done.join(after, ["slot", "i"]).where("end > done").withColumn("block", F.explode(F.sequence("done", F.col("end") - 1)))
    job = job.select(
        "slot",
        F.greatest(F.expr("block * total div own") - F.col("slot"), F.lit(0)).alias("release"),
        F.struct(F.expr("((block + 1) * total + own - 1) div own").alias("deadline"), "i", "block").alias("b"),
    )
    ready = job.groupBy("slot", "release").agg(F.collect_list("b").alias("b"))
    ready = ready.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("release", "b"))).alias("released"))
    fold = PATTERN.format(period=period, block=PATTERN_BLOCK, none=f"cast(array() as array<{PATTERN_BLOCK}>)")
    out = ready.select("slot", F.posexplode(F.expr(fold)).alias("place", "b"))
    return out.select("b.i", "b.block", (F.col("slot") + F.col("place")).alias("slot"))


def period_of(longest: int, sources: int, least: int) -> int:
    """Slots of a period: at least as many as the longest window has, so that finding where it starts costs no more than it."""
    return max(least, sources, -(-longest // 1000) * 1000)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_docs: int = BLOCK_DOCS,
    period: int = PERIOD,
    alpha: float = ALPHA,
) -> DataFrame:
    """One row per document: id, source, block (of its source), slot and position (0, 1, ... in the mixture).

    A null source counts as the source ''. Rows that repeat an id are documents of their own, in any order among
    themselves. A null id comes first in its source. An empty table gives an empty result. Other columns, texts among them, are
    not read. The result does not depend on ``period``, which only says how many slots one task takes.
    """
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    counts = keys.groupBy("source").agg(F.count("*").alias("n"))
    weighted = materialise(target_weights(counts, weights, alpha).withColumn("blocks", F.expr(f"(n + {block_docs} - 1) div {block_docs}")), "weights")
    # the last slot of any block is before the deadline of its source's last one
    reach = F.max(F.expr("(blocks * total + own - 1) div own"))
    size = weighted.agg(F.count("*").alias("s"), F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(reach, F.lit(0)).alias("last"), F.coalesce(F.max(F.expr("total div own")), F.lit(0)).alias("longest")).first()
    period = period_of(size["longest"], size["s"], period)
    digits = 1
    while size["n"] > GROUP_ROWS * 16**digits:
        digits += 1

    # place in its source without a window over a whole source: counts of hash prefixes give each prefix's offset
    order = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    keys = keys.withColumn("h", order).withColumn("part", F.substring("h", 1, digits))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keys.groupBy("source", "part").agg(F.count("*").alias("n"))
    parts = parts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("source", "part").orderBy("h", "doc_id")) - 1
    ranked = keys.withColumn("inside", inside).join(parts, ["source", "part"]).withColumn("rank", F.col("offset") + F.col("inside"))
    ranked = ranked.withColumn("block", F.expr(f"rank div {block_docs}"))
    planned = schedule(weighted, size["last"], period)
    blocks = planned.join(weighted, "i").where("block < blocks").withColumn("round", F.expr(f"slot div {period}"))
    blocks = blocks.select("source", "block", "round", "slot", F.least(F.lit(block_docs), F.col("n") - F.col("block") * block_docs).alias("size"))
    blocks = materialise(blocks, "blocks")
    rounds = blocks.groupBy("round").agg(F.sum("size").alias("size"))
    rounds = rounds.select("round", (F.sum("size").over(Window.orderBy("round")) - F.col("size")).alias("base"))
    first = F.sum("size").over(Window.partitionBy("round").orderBy("slot")) - F.col("size")
    placed = blocks.withColumn("first", first).join(rounds, "round").select("source", "block", "slot", (F.col("base") + F.col("first")).alias("start"))
    return ranked.join(placed, ["source", "block"]).select(
        F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "block", "slot", (F.col("start") + F.col("rank") - F.col("block") * block_docs).alias("position")
    )


def in_mixed_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with its own columns, all rows, sorted over its partitions by position in the mixture; files written from
    it keep that order (file name, then row). Rows that repeat an id stand together at the first place of any; so do rows
    without an id. An empty table stays empty; null sources and texts of any length are as good as others."""
    spot, key = fresh(docs.columns, "position", "key")
    where = mix(docs, id_col=id_col, source_col=source_col, **options).groupBy(F.col(id_col).alias(key)).agg(F.min("position").alias(spot))
    rows = docs.join(where, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key)), "left")
    return rows.repartitionByRange(spot, key).sortWithinPartitions(spot, key).select(*[F.col(f"`{c}`") for c in docs.columns])
