"""Backward as-of joins with a tolerance, freshness and missing marks, and the fusion of several sources.

Time is cut into buckets of an hour, or of the tolerance where that is shorter. Within a bucket the latest right row at or before
each left row is carried forward by one window; into each bucket goes a copy of the last right row before it, as far as the
tolerance reaches, so a left row finds its match in its own bucket however long the tolerance. Both sides are shuffled once, the
copies are one a bucket, and no pair is ever formed. Base rows that crowd in one bucket (a million stations in an hour) are dealt
to several tasks, each with a copy of the bucket's source rows. A match travels as one struct, so a right row of nulls still counts as
matched.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import fresh
from .dedupe import keep_last
from .ranks import join_null_safe

MICROS = 60_000_000
#: The widest bucket, in minutes.
BUCKET_MIN = 60
#: Base rows of one bucket and key that one task takes, and hot buckets that are broadcast (more are joined by key).
HOT_ROWS, MOST_BROADCAST = 200_000, 50_000


@dataclass
class Source:
    """A right side: its rows, time and key columns, the columns to attach and how old a match may be."""

    name: str
    rows: DataFrame
    time: str
    columns: Sequence[str]
    tolerance_min: float
    by: Sequence[str] = ()


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _carried(own: DataFrame, match: str, keys: list[str], names: _Names, width: int, tolerance: int) -> DataFrame:
    """The last match of each bucket at the start of those after it, up to the next that has one of its own (where rows may
    stand before that) and as far as it may be old."""
    last = own.groupBy(*keys, names.bucket).agg(F.max_by(match, names.t).alias(match))
    until = F.least(F.lead(names.bucket).over(Window.partitionBy(*keys).orderBy(names.bucket)), F.floor((F.col(match)["at"] + tolerance) / width))
    later = last.withColumn(names.until, until).where(F.col(names.until) > F.col(names.bucket))
    later = later.withColumn(names.bucket, F.explode(F.sequence(F.col(names.bucket) + 1, names.until)))
    return later.select(F.lit(0).alias(names.side), (F.col(names.bucket) * width).alias(names.t), names.bucket, *keys, match)


class _Names(NamedTuple):
    """Columns of the union, called as no column of the user is."""

    t: str
    bucket: str
    side: str
    row: str
    until: str
    salt: str
    salts: str


def _deal(left: DataFrame, sides: list[DataFrame], keys: list[str], names: _Names, hot_rows: int) -> tuple[DataFrame, list[DataFrame], bool]:
    """Base rows of a bucket with more than ``hot_rows`` dealt to salts by a hash of the row, the bucket's source rows copied to
    each; whether there was any such bucket. A base row needs its bucket's source rows only, so nothing is lost."""
    spot = [*keys, names.bucket]
    hot = left.groupBy(*spot).agg(F.ceil(F.count("*") / hot_rows).cast("int").alias(names.salts)).where(F.col(names.salts) > 1)
    n = hot.count()
    if not n:
        return left, sides, False
    hot = F.broadcast(hot) if n <= MOST_BROADCAST else hot
    salts = F.coalesce(names.salts, F.lit(1))
    left = join_null_safe(left, hot, spot, "left").withColumn(names.salt, F.pmod(F.xxhash64(F.to_json(names.row)), salts)).drop(names.salts)
    copied = [join_null_safe(s, hot, spot, "left").withColumn(names.salt, F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1))).drop(names.salts) for s in sides]
    return left, copied, True


def fuse(base: DataFrame, time: str, sources: Sequence[Source], by: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """``base`` with, for each source, its columns, ``{name}_timestamp``, ``{name}_freshness_min`` and ``{name}_missing``.

    All sources share one union and one window. The latest row at or before the base row counts if it is at most the
    tolerance old, both bounds included. Of several rows of a source at one time and key the greatest (all columns in order)
    counts. Base rows with a null time or key match nothing and stay; an empty source attaches nulls and missing = true. Columns
    may have any names, but a name that the result would hold twice is refused. A bucket with more than ``hot_rows`` base rows
    is spread over tasks.
    """
    width = max(1, int(min(BUCKET_MIN, max(s.tolerance_min for s in sources)) * MICROS))
    for s in sources:
        if list(s.by) != list(by):
            raise ValueError("all sources of one fusion share their keys")
    made = [*base.columns, *(c for s in sources for c in [*s.columns, f"{s.name}_timestamp", f"{s.name}_freshness_min", f"{s.name}_missing"])]
    if twice := sorted({c for c in made if made.count(c) > 1}):
        raise ValueError(f"the result would hold {twice} more than once; rename them in the source or give it another name")
    taken = [*made, *by]
    names = _Names(*fresh(taken, "t", "bucket", "side", "row", "until", "salt", "salts"))
    keys = fresh(taken, *[f"key_{i}" for i in range(len(by))]) if by else []
    matches = fresh(taken, *[f"match_{i}" for i in range(len(sources))])
    of = lambda c: F.col(f"`{c}`")
    keyed = [of(k).alias(n) for k, n in zip(by, keys, strict=True)]
    t = _micros(of(time))
    row = F.struct(*[of(c) for c in base.columns])
    left = base.select(F.lit(2).alias(names.side), t.alias(names.t), F.floor(t / width).alias(names.bucket), *keyed, row.alias(names.row))
    sides = []
    for s, name in zip(sources, matches, strict=True):
        rows = keep_last(s.rows.where(of(s.time).isNotNull()), [*by, s.time], s.columns)
        at = _micros(of(s.time))
        match = F.struct(at.alias("at"), F.struct(*[of(c) for c in s.columns]).alias("row"))
        own = rows.select(F.lit(1).alias(names.side), at.alias(names.t), F.floor(at / width).alias(names.bucket), *keyed, match.alias(name))
        sides += [own, _carried(own, name, keys, names, width, int(s.tolerance_min * MICROS))]
    left, sides, dealt = _deal(left, sides, keys, names, hot_rows)
    union = left
    for side in sides:
        union = union.unionByName(side, allowMissingColumns=True)
    w = Window.partitionBy(names.bucket, *keys, *([names.salt] if dealt else [])).orderBy(names.t, names.side).rowsBetween(Window.unboundedPreceding, 0)
    carried = union.withColumns({m: F.last(m, ignorenulls=True).over(w) for m in matches}).where(F.col(names.side) == 2)
    out = [F.col(names.row)[c].alias(c) for c in base.columns]
    for s, name in zip(sources, matches, strict=True):
        m = F.col(name)
        age = F.col(names.t) - m["at"]
        fits = F.coalesce(age <= int(s.tolerance_min * MICROS), F.lit(False))
        for k in keys:
            fits = fits & F.col(k).isNotNull()
        out += [F.when(fits, m["row"][c]).alias(c) for c in s.columns]
        out += [
            F.when(fits, F.timestamp_micros(m["at"])).alias(f"{s.name}_timestamp"),
            F.when(fits, age / MICROS).cast("float").alias(f"{s.name}_freshness_min"),
            (~fits).alias(f"{s.name}_missing"),
        ]
    return carried.select(*out)


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance_min: float, columns: Sequence[str], by: Sequence[str] = (), name: str = "right") -> DataFrame:
    """One source: see ``fuse``."""
    return fuse(left, left_time, [Source(name, right, right_time, columns, tolerance_min, by)], by)


def empty_source(like: DataFrame, columns: Sequence[str], time: str) -> DataFrame:
    """A source without rows but with the right types."""
    fields = [f for f in like.schema.fields if f.name in {*columns, time}]
    return like.sparkSession.createDataFrame([], T.StructType(fields))
