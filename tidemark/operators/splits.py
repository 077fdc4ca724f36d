"""Chronological splits, their validation, and task tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import fresh
from .ranks import join_null_safe, quantiles

SPLITS = ("train", "val", "test")
#: Parts of names that hint at the future.
LEAKS = ("target", "future", "lead", "t_plus")


def split_by_dates(df: DataFrame, time: str, ranges: dict[str, tuple[str, str]]) -> DataFrame:
    """``split`` by inclusive day ranges, the first that fits; rows outside all ranges go."""
    day = F.to_date(F.col(time))
    out = F.lit(None).cast("string")
    for name, (start, end) in reversed(ranges.items()):
        out = F.when(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(name)).otherwise(out)
    return df.withColumn("split", out).where("split is not null")


def year_splits(years: Sequence[int]) -> dict[int, str]:
    """The last year tests, the one before validates, the rest train; of two years the first trains, one alone trains."""
    years = sorted(years)
    if len(years) < 3:
        return dict(zip(years, ("train", "test"), strict=False))
    return {y: "test" if y == years[-1] else "val" if y == years[-2] else "train" for y in years}


def split_by_years(df: DataFrame, time: str, assigned: dict[int, str] | None = None) -> DataFrame:
    """``split`` by calendar year, from a map or from the years found; rows of other years go."""
    year = F.year(F.col(time))
    if assigned is None:
        assigned = year_splits([r[0] for r in df.select(year.alias("y")).where("y is not null").distinct().collect()])  # a row a year
    if not assigned:
        return df.withColumn("split", F.lit(None).cast("string")).where("false")
    pairs = [x for y, s in assigned.items() for x in (F.lit(y), F.lit(s))]
    return df.withColumn("split", F.try_element_at(F.create_map(*pairs), year)).where("split is not null")


def split_report(df: DataFrame, time: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """One row per split, also empty ones: rows, first and last time, and a status.

    pass: it has rows and starts after the last split before it that has any; fail: it starts too early; warn: no rows.
    """
    names = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(splits)], "place int, split string")
    found = df.groupBy("split").agg(F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"))
    table = names.join(found, "split", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    before = table.select(F.col("place").alias("p"), F.col("last").alias("l"))
    latest = table.join(before, before.p < table.place, "left").groupBy("split", "place", "rows", "first", "last").agg(F.max("l").alias("before"))
    status = F.when(F.col("rows") == 0, "warn").when(F.col("before").isNotNull() & (F.col("first") <= F.col("before")), "fail").otherwise("pass")
    return latest.select("place", "split", "rows", "first", "last", status.alias("status"))


def check_splits(df: DataFrame, time: str) -> None:
    """Raise if a split starts before an earlier one ends."""
    bad = [r["split"] for r in split_report(df, time).where("status = 'fail'").collect()]
    if bad:
        raise ValueError(f"splits out of order: {bad}")


def feature_columns(df: DataFrame, metadata: Sequence[str], excluded: Sequence[str] = ()) -> list[str]:
    """Numeric and boolean columns that are neither metadata nor excluded and whose names hint at no future value."""
    kinds = (T.NumericType, T.BooleanType)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, kinds) and f.name not in {*metadata, *excluded} and not any(t in f.name.lower() for t in LEAKS)
    ]


def task_table(df: DataFrame, target: str, metadata: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Metadata, features, one target and split; rows without the target go."""
    return df.where(F.col(target).isNotNull()).select(*metadata, *features, target, "split")


def task_summary(df: DataFrame, targets: Sequence[str], station: str, time: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Per target and split: rows, stations, first and last time, event rate, mean and nearest-rank 95th percentile of the
    target (the rate and the mean are one number, as a target is 0 or 1); splits without rows stand with 0.

    All targets in one pass: they are stacked as rows, which the aggregation combines before its shuffle.
    """
    cell, place, at, y = fresh([*df.columns, "target", "split"], "cell", "station", "time", "y")
    stacked = df.select(F.col(station).alias(place), F.col(time).alias(at), "split", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias(y)) for t in targets])).alias(cell))
    stacked = stacked.select(place, at, "split", f"{cell}.target", f"{cell}.{y}").where(F.col(y).isNotNull())
    found = stacked.groupBy("target", "split").agg(
        F.count("*").alias("rows"), F.countDistinct(place).alias("stations"), F.min(at).alias("first"), F.max(at).alias("last"), F.avg(y).alias("event_rate"), F.avg(y).alias("target_mean")
    )
    high = quantiles(stacked.select("target", "split", y), ["target", "split"], y, {"target_p95": (0.95, "nearest")})
    found = join_null_safe(found, high, ["target", "split"])
    names = df.sparkSession.createDataFrame([(t, s) for t in targets for s in splits], "target string, split string")
    return names.join(found, ["target", "split"], "left").fillna(0, ["rows", "stations"])


def station_summary(df: DataFrame, station: str, label: str, proxy: str, split: str = "split") -> DataFrame:
    """Per station and split: rows, event rate, mean and sample deviation of a proxy (null for one row); nulls are groups."""
    return df.groupBy(station, split).agg(
        F.count("*").alias("rows"), F.avg(label).alias("event_rate"), F.avg(proxy).alias("source_mean"), F.stddev_samp(proxy).alias("source_std")
    )


def label_summary(df: DataFrame, targets: Sequence[str], station: str) -> DataFrame:
    """One row: rows, stations and the event rate of each target."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(station).alias("stations"), *[F.avg(t).alias(f"{t}_rate") for t in targets])


def head_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows in an order (a cap that favours whatever sorts first).

    Where the first key is a number or a timestamp, a bounded-error sketch says how far n rows reach, and only the rows up to
    there are sorted; else every task would send its own first n rows to the last one.
    """
    kinds = (T.NumericType, T.TimestampType)
    if order and isinstance(order[0], str) and isinstance(df.schema[order[0]].dataType, kinds):
        key = F.col(order[0]).cast("double")
        size = df.agg(F.count("*").alias("all"), F.count(key).alias("known")).first()
        if size["all"] > 2 * n:
            reach = df.agg(F.percentile_approx(key, min(1.0, n / max(size["known"], 1) + 0.001), 10_000)).first()[0]
            near = df.where(key.isNull() | (key <= reach)) if reach is not None else df
            df = near if near.count() >= n else df
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same for the same seed, whatever the partitioning: those of the smallest md5 of the key's
    text and the seed. A first cut by the md5 keeps tasks from sorting and sending more than their share; it takes some more
    rows than asked, and where the keys crowd so that it took too few, it is left out."""
    (mark,) = fresh(df.columns, "mark")
    rows = df.withColumn(mark, F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))).cast("binary")))
    total, margin = df.count(), n + 6 * n**0.5 + 20
    if total > 2 * margin:
        cut = rows.where(F.col(mark) < f"{int(16**12 * margin / total):012x}")
        rows = cut if cut.count() >= n else rows
    return rows.orderBy(mark, *key).limit(n).drop(mark)


def stratified_cap(df: DataFrame, stratum: str, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), shared between strata in proportion to their rows by largest remainders (ties to the stratum
    that comes first), in each stratum those of the smallest md5 of the key's text and the seed: the same whatever the
    partitioning. A null stratum is one of its own.

    Rows are counted by stratum and the md5's first digits, so whole ranges of it are kept or left by count, and only the range
    in which a quota ends is ranked.
    """
    mark, digits, place, rank, quota, before, count, whole, share = fresh(df.columns, "mark", "digits", "place", "rank", "quota", "before", "count", "whole", "share")
    rows = df.withColumn(mark, F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))).cast("binary")))
    rows = rows.withColumn(digits, F.substring(mark, 1, 4))
    counts = rows.groupBy(stratum, digits).agg(F.count("*").alias(count))  # at most 65,536 rows a stratum
    strata = counts.groupBy(stratum).agg(F.sum(count).alias(whole))
    all_ = Window.partitionBy()  # a row a stratum
    exact = F.col(whole).cast("decimal(38,0)") * n
    total = F.sum(whole).over(all_).cast("decimal(38,0)")
    strata = strata.withColumns({share: F.floor(exact / total).cast("long"), rank: exact % total})
    left = F.least(F.lit(n), F.sum(whole).over(all_)) - F.sum(share).over(all_)
    order = F.row_number().over(all_.orderBy(F.desc(rank), F.asc_nulls_first(stratum)))
    strata = strata.select(stratum, F.when(total <= n, F.col(whole)).otherwise(F.col(share) + (order <= left).cast("int")).alias(quota))
    inside = Window.partitionBy(stratum).orderBy(digits).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(count).over(inside), F.lit(0)))
    spots = join_null_safe(counts, strata, [stratum]).where(F.col(before) < F.col(quota))
    kept = join_null_safe(rows, spots.select(stratum, digits, before, count, quota), [stratum, digits])
    ends = F.col(before) + F.col(count) > F.col(quota)
    last = kept.where(ends).withColumn(place, F.row_number().over(Window.partitionBy(stratum, digits).orderBy(mark, *key)))
    last = last.where(F.col(before) + F.col(place) <= F.col(quota))
    return kept.where(~ends).select(*df.columns).unionByName(last.select(*df.columns))
