"""Preference formatting: paired conversations with their longest common turn prefix rendered once as the prompt.

A table without ratings still says what to prefer: of two conversations that open alike the fuller one, and elsewhere a
conversation's own reply before the reply that another conversation gave to something else.

Everything stays at one row for each rendered turn, so a conversation that holds a third of all turns is never gathered:
the two sides of a pair meet turn by turn, the first turn that differs is a minimum, and the turns before it are the prompt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialise

FAMILY_ROWS = 5_000
START, END = "<|{}|>\n", "<|end|>\n"


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, chars, digest, said)``: what was said at each turn, rendered, and its md5, by which turns are
    compared so that texts need not travel. Equal rows are one; different rows of one turn all stand, in no set order. A null
    role is 'user', a null text empty; rows of null conversations or turns go."""
    said = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit(END))
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv is not null and turn is not null")
    rows = rows.select("conv", "turn", "role", F.length("text").cast("long").alias("chars"), said.alias("said"))
    return rows.withColumn("digest", F.md5(F.col("said").cast("binary"))).dropDuplicates(["conv", "turn", "digest"])


def preference_pairs(turns: DataFrame) -> DataFrame:
    """``(chosen, rejected, at, own, reply_turn, reply)``: each conversation that holds an assistant turn, and the next such.

    Conversations stand in the order of the md5 of what they open with, then of their ids; those whose md5 has the same first
    digit form a ring, where the first follows the last. Where the two open alike they are siblings and are compared whole
    (``at`` and what follows it are null): the one with more assistant characters is chosen, at a tie the smaller id. Where they
    do not, the first is chosen up to its last assistant turn ``at``, and rejected is the same conversation with the last
    assistant turn of the other in that place: what they share is all that was said before. ``own`` and ``reply`` are the digests
    of the two turns, the largest of several in one turn, beside which a turn's other rows are left out. Equal conversations, or
    equal replies, differ nowhere and are all prompt.

    A conversation alone in its ring gives no pair, one without an assistant turn none and is in none; an empty table gives an
    empty result. The order is cut into ranges of about ``FAMILY_ROWS`` conversations, and the last of a range is followed by the
    first of the ring's next range, so who is paired depends neither on the size of the table nor on how many open alike. A long
    conversation or text counts by one row here.
    """
    reply = F.max(F.when(F.col("role") == "assistant", F.struct("turn", "digest")))
    first = turns.groupBy("conv").agg(
        F.min(F.struct("turn", "role", "digest"))["digest"].alias("opening"),
        F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("chars"))), F.lit(0)).alias("answer"),
        reply.alias("reply"),
    )
    first = materialise(first.where("reply is not null").withColumn("ring", F.substring("opening", 1, 1)), "openings")
    ranges = first.count() // FAMILY_ROWS + 1
    # stored, as another run of the plan may cut the ranges elsewhere
    rows = materialise(first.repartitionByRange(ranges, "opening", "conv").withColumn("cut", F.spark_partition_id()), "ranges")
    one = F.struct("opening", "conv", "answer", "reply")
    heads = rows.groupBy("ring", "cut").agg(F.min(one).alias("head"))
    on = Window.partitionBy("ring").orderBy("cut")
    whole = on.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("ring", "cut", F.coalesce(F.lead("head").over(on), F.first("head").over(whole)).alias("head"))
    near = Window.partitionBy("ring", "cut").orderBy("opening", "conv")
    after = rows.withColumn("after", F.lead(one).over(near)).join(heads, ["ring", "cut"])
    after = after.withColumn("after", F.coalesce("after", "head")).where("conv != after.conv")
    alike = F.col("opening") == F.col("after.opening")
    mine = ~alike | (F.col("answer") > F.col("after.answer")) | ((F.col("answer") == F.col("after.answer")) & (F.col("conv") < F.col("after.conv")))
    swapped = {"at": "reply.turn", "own": "reply.digest", "reply_turn": "after.reply.turn", "reply": "after.reply.digest"}
    return after.select(
        F.when(mine, F.col("conv")).otherwise(F.col("after.conv")).alias("chosen"),
        F.when(mine, F.col("after.conv")).otherwise(F.col("conv")).alias("rejected"),
        *[F.when(~alike, F.col(c)).alias(n) for n, c in swapped.items()],
    ).distinct()


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rendered turns of each pair: chosen, rejected, part (prompt, chosen, rejected), turn, role, said, loss.

    ``pairs`` has whole conversations (chosen, rejected), or also replies as ``preference_pairs`` gives them. The longest common
    turn prefix is the prompt, and its rows stand once for both sides. ``loss`` is true on assistant turns of a completion and
    false elsewhere (masked). Two equal conversations are all prompt. A conversation that is not there has no turns, a
    pair that is listed again counts once, other columns are not read, and without pairs or turns there are no rows. A turn is a row whatever its length.
    """
    key = ["chosen", "rejected"]
    pairs = pairs.select(*[c for c in (*key, "at", "own", "reply_turn", "reply") if c in pairs.columns])
    for name, kind in {"at": "long", "own": "string", "reply_turn": "long", "reply": "string"}.items():
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, F.lit(None).cast(kind))
    pairs = pairs.dropDuplicates(key)
    marks = turns.select("conv", "turn", "role", "digest")
    side = lambda *names: F.array(*[F.lit(x) for x in names])
    left = pairs.join(marks.withColumnRenamed("conv", "chosen"), "chosen").where("at is null or turn < at or turn = at and role = 'assistant' and digest = own")
    sides = F.when(F.col("turn") < F.col("at"), side("chosen", "rejected")).otherwise(side("chosen"))
    left = left.select(*key, "turn", "role", "digest", F.explode(sides).alias("side"), F.struct(F.col("chosen").alias("conv"), "turn").alias("teller"))
    right = pairs.where("at is null").join(marks.withColumnRenamed("conv", "rejected"), "rejected")
    right = right.select(*key, "turn", "role", "digest", F.lit("rejected").alias("side"), F.struct(F.col("rejected").alias("conv"), "turn").alias("teller"))
    other = pairs.where("at is not null").select(
        *key, F.col("at").alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("digest"), F.lit("rejected").alias("side"),
        F.struct(F.col("rejected").alias("conv"), F.col("reply_turn").alias("turn")).alias("teller"),
    )
    both = left.unionByName(right).unionByName(other)
    # a turn is common if each of its rows stands on both sides
    rows = both.groupBy(*key, "turn", "role", "digest").agg(F.count("*").alias("sides"), F.min("side").alias("side"), F.min("teller").alias("teller"))
    cut = rows.where("sides < 2").groupBy(*key).agg(F.min("turn").alias("cut"))
    marked = rows.join(cut, key, "left")
    common = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    # past the cut a row that both sides hold belongs to each of them
    parts = F.when(common, side("prompt")).when(F.col("sides") == 2, side("chosen", "rejected")).otherwise(F.array("side"))
    out = marked.withColumn("part", F.explode(parts)).select(*key, "part", "turn", "role", "digest", F.col("teller.conv").alias("conv"), F.col("teller.turn").alias("from"))
    texts = turns.select("conv", F.col("turn").alias("from"), "digest", "said")
    out = out.join(texts, ["conv", "from", "digest"])
    return out.select(*key, "part", "turn", "role", "said", ((F.col("part") != "prompt") & (F.col("role") == "assistant")).alias("loss"))
