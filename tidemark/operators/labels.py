"""Thresholds per group and forward-window labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fresh
from .blocks import over_blocks
from .ranks import join_null_safe, quantiles


def magnitude_and_change(df: DataFrame, keys: Sequence[str], time: str, north: str, east: str, reset: str | None = "month") -> DataFrame:
    """``magnitude`` and ``abs_change`` (from the row before, starting anew each month unless ``reset`` is None)."""
    rows, part, (again,) = df.withColumn("magnitude", F.hypot(north, east).cast("float")), [*keys], fresh(df.columns, "reset")
    if reset:
        rows = rows.withColumn(again, F.date_trunc(reset, F.col(time)))
        part.append(again)
    made = lambda w: {"abs_change": F.abs(F.col("magnitude") - F.lag("magnitude", 1).over(w))}
    return over_blocks(rows, part, time, made, before=1).drop(again)


def lagged_differences(df: DataFrame, keys: Sequence[str], time: str, lags: dict[str, tuple[str, int]], reset: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """``{new: (column, k)}``: column less its value k rows (not minutes) before; with ``reset`` ("month"), rows before the month's
    first do not count."""
    rows, part, (again,) = df, [*keys], fresh(df.columns, "reset")
    if reset:
        rows = rows.withColumn(again, F.date_trunc(reset, F.col(time)))
        part.append(again)
    made = lambda w: {n: F.col(c) - F.lag(c, k).over(w) for n, (c, k) in lags.items()}
    return over_blocks(rows, part, time, made, before=max(k for _, k in lags.values()), ties=ties).drop(again)


def forward_labels(
    df: DataFrame, keys: Sequence[str], time: str, value: str, thresholds: dict[str, str], horizons: Sequence[int], drop_incomplete: bool = True, ties: Sequence[str] = (), longest: int | None = None
) -> DataFrame:
    """``target_geq_{name}_{h}m`` = 1 if the largest value of the next h rows reaches the threshold column, null unless all
    h are there and not null. ``thresholds`` maps names to columns, ``longest`` the rows of the longest
    series, if known. One frame for each horizon, no chain of shifts."""

    def made(w) -> dict[str, Column]:
        out = {}
        for h in horizons:
            ahead = w.rowsBetween(1, h)
            full = F.count(value).over(ahead) == h
            for name, column in thresholds.items():
                out[f"target_geq_{name}_{h}m"] = F.when(full, (F.max(value).over(ahead) >= F.col(column)).cast("byte"))
        return out

    labelled = over_blocks(df, keys, time, made, after=max(horizons), ties=ties, longest=longest)
    names = [f"target_geq_{n}_{h}m" for h in horizons for n in thresholds]
    return labelled.dropna(subset=names) if drop_incomplete else labelled


def quantile(df: DataFrame, value: str | Column, q: float, name: str) -> DataFrame:
    """One row: the exact quantile of a number, with linear interpolation; null without values."""
    return quantiles(df.select((F.col(value) if isinstance(value, str) else value).alias(name)), [], name, {name: (q, "linear")})


def quantiles_nearest(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Per group, the value at rank round((n - 1) q), halves up, as ``p95`` and so on."""
    return quantiles(df, keys, value, {f"p{round(q * 100)}": (q, "nearest") for q in qs})


def group_thresholds(df: DataFrame, keys: Sequence[str], value: str, method: str = "nearest", accuracy: int = 10_000) -> DataFrame:
    """n_samples, min, median, max, p95, p99 per group; ``method`` is nearest, linear (both exact) or approx (bounded error)."""
    rows = df.where(F.col(value).isNotNull())
    base = rows.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    if method == "approx":
        part = rows.groupBy(*keys).agg(*[F.percentile_approx(value, q, accuracy).alias(n) for n, q in (("median_value", 0.5), ("p95", 0.95), ("p99", 0.99))])
    else:
        part = quantiles(rows, keys, value, {"median_value": (0.5, "linear"), "p95": (0.95, method), "p99": (0.99, method)})
    return join_null_safe(base, part, list(keys)).select(*keys, "n_samples", "min_value", "median_value", "max_value", "p95", "p99")


def bad_thresholds(thresholds: DataFrame) -> DataFrame:
    """Thresholds that are null or out of order."""
    return thresholds.where("p95 is null or p99 is null or p99 < p95")


def attach_thresholds(df: DataFrame, thresholds: DataFrame, key: str, columns: Sequence[str] = ("p95", "p99"), check: bool = True) -> DataFrame:
    """Left lookup; with ``check``, groups without thresholds raise, naming up to five of them."""
    small = thresholds.select(key, *columns)
    if check:
        missing = [r[0] for r in df.select(key).distinct().join(small, key, "left_anti").orderBy(key).limit(5).collect()]
        if missing:
            raise ValueError(f"no thresholds for {missing}")
    return df.join(small, key, "left")


def lookback_sequences(df: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], length: int, ties: Sequence[str] = ()) -> DataFrame:
    """Every run of ``length`` rows of a series as an array of structs beside the row that ends it."""

    def made(w) -> dict[str, Column]:
        back = w.rowsBetween(-(length - 1), 0)
        return {"sequence": F.collect_list(F.struct(*features)).over(back)}

    return over_blocks(df, keys, time, made, before=length - 1, ties=ties).where(F.size("sequence") == length)
