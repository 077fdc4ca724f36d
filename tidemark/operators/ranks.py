"""Exact ranks, running totals and quantiles of groups of any size.

A window over a group's distinct values puts them all into one task. Here values are dealt to buckets by a rule that never
decreases (sign and binary logarithm, ``STEPS`` buckets to each doubling), so running totals over the few buckets of a group
and inside each bucket add up to running totals over the group, and no task holds more than a bucket of it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import fresh

STEPS = 4096


def rank_bucket(value: str | Column) -> Column:
    """A number that never falls as the value rises; NaN comes last, as in Spark's own order."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    zero, top = 2000 * STEPS, 4000 * STEPS  # doubles have some 2,100 binades, so logarithms stay between -1,075 and 1,024
    place = F.when(F.abs(x) == float("inf"), F.lit(top).cast("long")).otherwise(F.floor(F.log2(F.abs(x)) * STEPS) + zero)
    return F.when(F.isnan(x), F.lit(2 * top).cast("long")).when(x == 0, F.lit(0).cast("long")).otherwise(F.when(x < 0, -place).otherwise(place))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys stand once."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row for the one group
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    rest = [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return left.alias("a").join(right.alias("b"), same, how).select("a.*", *rest)


def running_totals(counts: DataFrame, keys: Sequence[str], value: str, sums: dict[str, tuple[str, str]], descending: bool = False) -> DataFrame:
    """``counts`` (one row for each group and value) with, for each ``column: (upto, whole)``, the column's total up to and
    with the value and over the group. A null key is a group; values are numbers without nulls."""
    keys = list(keys)
    bucket, *before = fresh([*counts.columns, *(n for pair in sums.values() for n in pair)], "bucket", *[f"before_{c}" for c in sums])
    turn = F.desc if descending else F.asc
    rows = counts.withColumn(bucket, rank_bucket(value))
    totals = rows.groupBy(*keys, bucket).agg(*[F.sum(c).alias(b) for c, b in zip(sums, before, strict=True)])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(turn(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in before],
        *[F.sum(b).over(group).alias(whole) for b, (_, whole) in zip(before, sums.values(), strict=True)],
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(turn(value)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({upto: F.sum(c).over(inside) for c, (upto, _) in sums.items()})
    joined = join_null_safe(rows, totals, [*keys, bucket])
    return joined.withColumns({upto: F.col(upto) + F.col(b) for b, (upto, _) in zip(before, sums.values(), strict=True)}).drop(bucket, *before)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, asked: dict[str, tuple[float, str]], aggs: Sequence[Column] = (), window_rows: int = 100_000) -> DataFrame:
    """Per group, exact quantiles ``name: (q, rule)`` of a column's values that are not null, and further aggregates over its
    distinct values (of which only minima and maxima make sense, as equal values may count more than once). Rules: ``nearest``,
    the value at rank round((n - 1) q), halves up; ``linear``, between the two ranks around (n - 1) q. No rows give no groups
    (one null row without keys).

    Groups of at most ``window_rows`` rows are sorted in a window each, with one shuffle of their rows; whether there are larger
    ones is asked at once, by counts per group. In those equal values count once, combined before the shuffle, and go by buckets."""
    keys, rows = list(keys), df.where(F.col(value).isNotNull())
    if not keys:
        return _bucket_quantiles(rows, keys, value, asked, aggs)
    count, large = fresh(df.columns, "count", "large")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias(count)).where(F.col(count) > window_rows).select(*keys, F.lit(True).alias(large))
    if sizes.isEmpty():
        return _window_quantiles(rows, keys, value, asked, aggs)
    marked = join_null_safe(rows.select(*keys, value), F.broadcast(sizes), keys, "left")  # a row for each window_rows rows of df at most
    small, rest = marked.where(F.col(large).isNull()).drop(large), marked.where(large).drop(large)
    return _window_quantiles(small, keys, value, asked, aggs).unionByName(_bucket_quantiles(rest, keys, value, asked, aggs))


def _window_quantiles(rows: DataFrame, keys: list[str], value: str, asked: dict[str, tuple[float, str]], aggs: Sequence[Column]) -> DataFrame:
    number, whole = fresh(rows.columns, "number", "whole")
    if rows.schema[value].dataType.typeName() in ("float", "double"):
        rows = rows.withColumn(value, F.when(F.col(value) == 0, F.lit(0).cast(rows.schema[value].dataType)).otherwise(F.col(value)))  # -0.0, as grouping has it
    line = Window.partitionBy(*keys).orderBy(value)
    ranked = rows.select(*keys, value).withColumns({number: F.row_number().over(line), whole: F.count("*").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return ranked.groupBy(*keys).agg(*_at_ranks(value, number, whole, asked), *aggs)


def _bucket_quantiles(rows: DataFrame, keys: list[str], value: str, asked: dict[str, tuple[float, str]], aggs: Sequence[Column]) -> DataFrame:
    count, upto, whole = fresh(rows.columns, "count", "upto", "whole")
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias(count))
    ranked = running_totals(counts, keys, value, {count: (upto, whole)})
    return ranked.groupBy(*keys).agg(*_at_ranks(value, upto, whole, asked), *aggs)


def _at_ranks(value: str, upto: str, whole: str, asked: dict[str, tuple[float, str]]) -> list[Column]:
    """Aggregates of rows with how many of a group's rows lie up to and with them and in all."""
    at = lambda rank: F.min(F.when(F.col(upto) > rank, F.col(value)))
    columns = []
    for name, (q, rule) in asked.items():
        spot = (F.col(whole) - 1) * q
        if rule == "nearest":
            columns.append(at(F.floor(spot + 0.5)).alias(name))
        elif rule == "linear":
            part = F.max(spot - F.floor(spot))
            low, high = at(F.floor(spot)).cast("double"), at(F.ceil(spot)).cast("double")
            columns.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(name))
        else:
            raise ValueError(f"unknown rule {rule}")
    return columns


def column_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float], accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """The exact linear quantiles of each column over all rows, None where a column has no value.

    A bounded-error sketch of all columns brackets each rank; a second pass counts what lies below the brackets, and only the
    rows inside them (about 4 / ``accuracy`` of them each) are counted by value. A bracket that should miss its rank is widened.
    """
    columns, x = list(dict.fromkeys(columns)), lambda c: F.col(c).cast("double")
    near = [max(0.0, min(1.0, q + d)) for q in qs for d in (-2 / accuracy, 2 / accuracy)]
    ends = [y for i, c in enumerate(columns) for y in (F.percentile_approx(x(c), near, accuracy).alias(f"s{i}"), F.min(x(c)).alias(f"a{i}"), F.max(x(c)).alias(f"b{i}"), F.count(c).alias(f"n{i}"))]
    first = df.agg(*ends).first()
    found: dict[tuple[int, int], float | None] = {}
    open_at = {}
    for i in range(len(columns)):
        for k in range(len(qs)):
            if first[f"n{i}"]:
                open_at[i, k] = tuple(first[f"s{i}"][2 * k : 2 * k + 2])
            else:
                found[i, k] = None
    while open_at:
        asked = [(e, i, k, lo, hi) for e, ((i, k), (lo, hi)) in enumerate(open_at.items())]
        inside = lambda i, lo, hi: x(columns[i]).between(lo, hi)
        sums = [y for e, i, _, lo, hi in asked for y in (F.sum((x(columns[i]) < lo).cast("long")).alias(f"x{e}"), F.sum(inside(i, lo, hi).cast("long")).alias(f"y{e}"))]
        seen = df.agg(*sums).first()
        cells = [F.when(inside(i, lo, hi), F.struct(F.lit(e).alias("e"), x(columns[i]).alias("v"))) for e, i, _, lo, hi in asked]
        counts = df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.e", "x.v").groupBy("e", "v").agg(F.count("*").alias("n"))
        ranked = running_totals(counts, ["e"], "v", {"n": ("upto", "whole")})
        rank = {e: ((first[f"n{i}"] - 1) * qs[k], seen[f"x{e}"]) for e, i, k, _, _ in asked}
        at = lambda f, rank=rank: F.min(F.when(F.col("upto") > F.element_at(F.create_map(*[y for e, (p, below) in rank.items() for y in (F.lit(e), F.lit(int(f(p)) - below))]), F.col("e")), F.col("v")))
        rows = {r["e"]: r for r in ranked.groupBy("e").agg(at(math.floor).alias("lo"), at(math.ceil).alias("hi")).collect()}  # a row a quantile
        for e, i, k, _, _ in asked:
            p, below = rank[e]
            if below <= math.floor(p) and math.ceil(p) < below + seen[f"y{e}"]:
                part = p - math.floor(p)
                found[i, k] = rows[e]["lo"] if not part else (1 - part) * rows[e]["lo"] + part * rows[e]["hi"]
                del open_at[i, k]
            else:
                open_at[i, k] = (first[f"a{i}"], first[f"b{i}"])
    return {c: [found[i, k] for k in range(len(qs))] for i, c in enumerate(columns)}
