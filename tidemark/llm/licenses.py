"""License scan: phrases at word positions, and an exact set-similarity join of text blocks with license templates.

Built-in functions only. One scan cuts every whole text into words, places the base phrases, and keeps the words of those
documents that hold enough of a template's words to have any block over the threshold. Those are cut into overlapping blocks
and joined with the templates by their token sets: tokens are ordered by how many documents hold them (rarest first), a block
meets a template on a token of the template's prefix (long enough that any block over the threshold holds one of its
tokens), and length and position bounds discard what cannot reach the overlap that is counted last.

A template's blocks are made to its measure: its class is the least power of two, ``LEAST`` or more, that its words do not
exceed, and the blocks of a class are twice as wide and start at its every multiple. Any run of as many words as the template
has lies whole in one of them, so a template that stands anywhere in a text is found, however long it is; and what matches
lies within four times the template's words (within 16 words, for one of fewer than eight).

Templates are a parameter: the driver holds them, and their words are literals of the plan. Tables made of them are broadcast up
to ``BROADCAST_WORDS`` words, and joined by key beyond.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._license_texts import TEMPLATES
from ._shared import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
THRESHOLD = (4, 5)
LEAST = 8
BROADCAST_WORDS = 100_000


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BREAK, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_sets(templates: list[tuple[str, str]], threshold: tuple[int, int]) -> list[tuple[int, str, list[str], int, int]]:
    """``(number, label, distinct words, words needed, class)`` of templates that have words."""
    num, den = threshold
    out = []
    for t, (label, text) in enumerate(templates):
        said = words_of(text)
        if said:
            distinct = sorted(set(said))
            out.append((t, label, distinct, -(-num * len(distinct) // den), max(LEAST, 1 << (len(said) - 1).bit_length())))
    return out


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)  # words hold neither quotes nor backslashes


def _places(phrases: list[tuple[str, str]]) -> str:
    """SQL for an array of ``(at, label)`` over ``words``, searched only in texts ``low`` that hold each word of a phrase."""
    places = []
    for label, phrase in phrases:
        said = words_of(phrase)
        test = " and ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(said))
        some = " and ".join(f"contains(low, '{w}')" for w in sorted(set(said), key=lambda w: -len(w)))
        found = f"filter(sequence(0, size(words) - {len(said)}), i -> {test})"
        label = label.replace("\\", "\\\\").replace("'", "\\'")
        places.append(f"if({some} and size(words) >= {len(said)}, transform({found}, i -> named_struct('at', cast(i as bigint), 'label', '{label}')), cast(array() as array<struct<at:bigint,label:string>>))")
    return f"concat({', '.join(places)})"


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: list[tuple[str, str]] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: tuple[int, int] = THRESHOLD,
) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a base phrase stands, else the largest share of a template's distinct words found in one block, and
    0 below the threshold. Null and empty texts have no words, no places (null positions) and the score 0. Rows that repeat
    an id each give a row, and share labels only if their texts are the same. An empty table gives an empty result; other
    columns are not read. Two templates of the same words count under each label; one without words is never found. A very long
    text is one row while it is scanned; only its blocks that hold enough words of a template travel.
    """
    sets = template_sets(templates, threshold)
    vocabulary = sorted({w for _, _, words, _, _ in sets for w in words})
    least = {}
    for *_, need, half in sets:
        least[half] = min(need, least.get(half, need))
    spark = docs.sparkSession
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("key"), low.alias("low"))
    base = base.select("*", F.filter(F.split("low", BREAK), lambda w: w != "").alias("words"))
    known = f"w -> w in ({_quoted(vocabulary)})" if sets else "w -> false"
    base = base.select(
        "doc_id",
        "key",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.expr(_places(phrases) if phrases else "cast(array() as array<struct<at:bigint,label:string>>)").alias("places"),
        F.expr(f"array_distinct(filter(words, {known}))").alias("held"),
    )
    holds = [f"if(size(held) >= {need} and size(filter(held, w -> w in ({_quoted(words)}))) >= {need}, {half}, null)" for _, _, words, need, half in sets]
    base = base.withColumn("classes", F.expr(f"array_distinct(array_compact(array({', '.join(holds)})))" if sets else "cast(array() as array<int>)"))
    kept = materialise(base.withColumn("words", F.when(F.size("classes") > 0, F.col("words"))), "license-words")

    small = F.broadcast if sum(len(words) for _, _, words, _, _ in sets) <= BROADCAST_WORDS else lambda df: df
    rank = F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "token"))  # one row for each template word
    counts = kept.select(F.explode("held").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    tokens = spark.createDataFrame([(w,) for w in vocabulary], "token string")
    order = small(tokens.join(counts, "token", "left").select("token", rank.alias("rank")))
    template = spark.createDataFrame(
        [(t, label, w, len(words), need, half) for t, label, words, need, half in sets for w in words], "template int, label string, token string, size int, need int, half int"
    )
    template = template.join(order, "token").withColumn("i", F.row_number().over(Window.partitionBy("template").orderBy("rank")))
    prefix = small(template.where(F.col("i") <= F.col("size") - F.col("need") + 1))

    # the blocks of a document's classes that hold as many known words as the class's least template needs
    texts = kept.where("size(classes) > 0").dropDuplicates(["key"]).select("key", "words", F.explode("classes").alias("half"))
    starts = "sequence(0, greatest(0, cast(ceil((size(words) - 2 * half) / half) as int)) * half, half)"
    cut = f"transform({starts}, s -> named_struct('start', s, 'tokens', array_distinct(filter(slice(words, s + 1, 2 * half), {known}))))"
    wanted = F.expr(f"case {' '.join(f'when half = {half} then {n}' for half, n in least.items())} end") if sets else F.lit(1)
    blocks = texts.select("key", "half", F.explode(F.expr(cut)).alias("b")).where(F.size("b.tokens") >= wanted)
    held = blocks.select("key", "half", F.col("b.start").alias("start"), F.explode("b.tokens").alias("token"))
    # a block's tokens in the global order; it has at most as many as its width or templates have words
    sizes = held.join(order, "token").groupBy("key", "half", "start").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("block"))
    placed = sizes.select("key", "half", "start", "block", F.size("block").alias("n"), F.posexplode("block").alias("j", "b"))
    placed = placed.withColumn("token", F.col("b.token"))
    met = placed.join(prefix, ["half", "token"]).where("n >= need")
    first = met.groupBy("key", "start", "template", "label", "size", "need", "n").agg(F.min(F.struct("i", "j")).alias("at"), F.first("block.token").alias("block"))
    first = first.where(F.least(F.col("size") - F.col("at.i"), F.col("n") - F.col("at.j") - 1) + 1 >= F.col("need"))
    full = small(template.groupBy("template").agg(F.collect_list("token").alias("tokens")))
    shared = F.size(F.array_intersect("block", "tokens"))
    links = first.join(full, "template").withColumn("shared", shared).where("shared >= need")
    found = links.groupBy("key").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("size")).alias("share"))

    out = kept.drop("words", "held", "classes").join(found, "key", "left")
    base_labels = F.array_distinct(F.col("places.label"))
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").alias("first_word"),
        F.array_max("places.at").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
