"""Resampling to minutes with quality diagnostics, gapless minute grids, and reductions over satellites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import all_present, circular_mean, fresh
from .ranks import join_null_safe


def floor_minute(time: str) -> Column:
    return F.date_trunc("minute", F.col(time))


def resample_minutes(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    means: Sequence[str] = (),
    circular: Sequence[str] = (),
    maxima: Sequence[str] = (),
    firsts: Sequence[str] = (),
    components: Sequence[str] = (),
) -> DataFrame:
    """One row per key and minute: means (``x``), non-null counts (``n_x``), fractions missing (``x_missing_fraction``),
    circular means, maxima of flags, the earliest non-null of ``firsts``, ``n_points`` and ``n_valid`` (rows that hold
    every component). Rows with a null time are left out; minutes without rows give none (see ``minute_grid``)."""
    (minute,) = fresh(df.columns, "minute")
    rows = df.where(F.col(time).isNotNull()).withColumn(minute, floor_minute(time))
    aggs = [F.count("*").alias("n_points")]
    for c in means:
        aggs += [F.avg(c).alias(c), F.count(c).alias(f"n_{c}"), (1 - F.count(c) / F.count("*")).alias(f"{c}_missing_fraction")]
    aggs += [circular_mean(F.col(c)).alias(c) for c in circular]
    aggs += [F.max(c).alias(c) for c in maxima]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(time, c))).alias(c) for c in firsts]
    if components:
        aggs.append(F.sum(all_present(components).cast("long")).alias("n_valid"))
    return rows.groupBy(*keys, minute).agg(*aggs).withColumnRenamed(minute, time)


def minute_grid(df: DataFrame, keys: Sequence[str], time: str, step: str = "minute", flag: str = "has_observation") -> DataFrame:
    """Every step between each key's first and last row, with a flag for those observed; introduced rows carry the key only.

    Times count by their step, so rows should be one for each key and step. The grid is made from bounds only (two values a
    key), exploded by day first so that no task makes a whole history.
    """
    at, (lo, hi) = F.date_trunc(step, F.col(time)), fresh(df.columns, "lo", "hi")
    bounds = df.groupBy(*keys).agg(F.min(at).alias(lo), F.max(at).alias(hi)).where(F.col(lo).isNotNull())
    return _filled(df, bounds, keys, time, step, flag, lo, hi)


def month_grid(df: DataFrame, keys: Sequence[str], time: str, step: str = "minute", flag: str | None = None) -> DataFrame:
    """Every step of every calendar month in which a key has a row; gap rows are null beside key and time, flags included."""
    at, (lo, hi) = F.date_trunc("month", F.col(time)), fresh(df.columns, "lo", "hi")
    months = df.where(F.col(time).isNotNull()).select(*keys, at.alias(lo)).distinct()
    bounds = months.withColumn(hi, F.add_months(lo, 1).cast("timestamp") - F.expr(f"interval 1 {step}"))
    return _filled(df, bounds, keys, time, step, flag, lo, hi)


def _filled(df: DataFrame, bounds: DataFrame, keys: Sequence[str], time: str, step: str, flag: str | None, lo: str, hi: str) -> DataFrame:
    day, at, seen = fresh([*df.columns, lo, hi], "day", "at", "seen")
    days = bounds.select(*keys, lo, hi, F.explode(F.expr(f"sequence(date_trunc('day', {lo}), date_trunc('day', {hi}), interval 1 day)")).alias(day))
    steps = F.explode(F.expr(f"sequence(greatest({lo}, {day}), least({hi}, {day} + interval 1 day - interval 1 {step}), interval 1 {step})"))
    grid = days.withColumn(at, steps).select(*keys, at)
    rows = df.withColumns({at: F.date_trunc(step, F.col(time)), seen: F.lit(True)}).drop(time)
    joined = grid.join(rows, [*keys, at], "left").withColumnRenamed(at, time)
    if flag:
        joined = joined.withColumn(flag, F.coalesce(seen, F.lit(False)))
    out = [c for c in df.columns] + ([flag] if flag else [])
    return joined.select(*out)


def grid_gaps(grid: DataFrame, keys: Sequence[str], observed: Column) -> DataFrame:
    """Rows and gaps of each key of a grid."""
    return grid.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum((~F.coalesce(observed, F.lit(False))).cast("long")).alias("gaps"))


def fill_both_ways(df: DataFrame, keys: Sequence[str], time: str, column: str, step: str = "day") -> DataFrame:
    """Nulls of a column from the last value before, else the first after, per key.

    Rows are filled within ``step``s (days); what a step takes from others comes from a window over one row a step. Among rows
    of one time the largest value is the last and the smallest the first; rows without a time stand before all others.
    """
    keys = list(keys)
    part, first, last = fresh(df.columns, "part", "first", "last")
    rows = df.withColumn(part, F.date_trunc(step, F.col(time)))
    held = F.when(F.col(column).isNotNull(), F.struct(time, column))
    ends = rows.groupBy(*keys, part).agg(F.min(held).alias(first), F.max(held).alias(last))
    along = Window.partitionBy(*keys).orderBy(part)
    back = Window.partitionBy(*keys).orderBy(F.desc(part))
    earlier = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))[column]
    ends = ends.select(*keys, part, earlier(last, along).alias(last), earlier(first, back).alias(first))
    inside = Window.partitionBy(*keys, part).rowsBetween(Window.unboundedPreceding, 0)
    known = lambda *order: F.last(column, ignorenulls=True).over(inside.orderBy(*order))
    rows = rows.withColumns({f"{first}_": known(F.desc(time), F.desc_nulls_last(column)), f"{last}_": known(time, F.asc_nulls_first(column))})
    filled = join_null_safe(rows, ends, [*keys, part])
    value = F.coalesce(column, f"{last}_", last, f"{first}_", first)
    return filled.withColumn(column, value).select(*df.columns)


def reduce_satellites(df: DataFrame, time: str, satellite: str, means: Sequence[str] = (), flags: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """One row per time over all satellites: how many, means, ``any_{flag}`` and sums (0 where all are null)."""
    aggs = [F.countDistinct(satellite).alias("n_satellites")]
    aggs += [F.avg(c).alias(c) for c in means]
    aggs += [F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)).cast("boolean").alias(f"any_{c}") for c in flags]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    return df.groupBy(time).agg(*aggs)


def attach_residuals(observed: DataFrame, model: DataFrame, keys: Sequence[str], components: Sequence[str] = ("north", "east", "centre")) -> DataFrame:
    """Observed fields with supplied model fields on the keys: internal = tdep + static, external = gsm + sm, total = both,
    residuals = observed less total and less internal. Rows without model fields are left out.

    Observed columns are ``b_{c}``; model columns ``{part}_{c}`` for the parts tdep, static, gsm and sm.
    """
    rows = observed.join(model, list(keys))
    for c in components:
        internal, external = F.col(f"tdep_{c}") + F.col(f"static_{c}"), F.col(f"gsm_{c}") + F.col(f"sm_{c}")
        rows = rows.withColumns(
            {
                f"internal_{c}": internal, f"external_{c}": external, f"model_{c}": internal + external,
                f"residual_total_{c}": F.col(f"b_{c}") - internal - external, f"residual_internal_{c}": F.col(f"b_{c}") - internal,
            }
        )
    return rows


def left_on_minute(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Left equi join on keys and minute; the right side is one row for each."""
    (minute,) = fresh([*left.columns, *right.columns], "minute")
    cut = lambda df: df.withColumn(minute, floor_minute(time))
    return cut(left).join(cut(right).drop(time), [*keys, minute], "left").drop(minute)
