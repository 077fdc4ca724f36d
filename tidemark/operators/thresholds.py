"""Exact group quantiles from stored value counts, kept by period, so that any set of periods is answered without raw rows.

``value_counts`` is stored once for each period (a month, say): how often each value of a group occurs, with the bucket of
``ranks.rank_bucket`` that it falls into. Counts of several periods merge by addition. A quantile's bucket follows from totals
by bucket, and only the counts of that one bucket are opened to find its value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.feeds import write_partitions
from .ranks import join_null_safe, rank_bucket

ASKED = {"median_value": (0.5, "linear"), "p95": (0.95, "nearest"), "p99": (0.99, "nearest")}


def value_counts(df: DataFrame, keys: Sequence[str], value: str, period: str) -> DataFrame:
    """``(keys, period, bucket, value, n)`` of the values that are not null."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, period, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    return rows.select(*keys, period, rank_bucket("value").alias("bucket"), "value", "n")


def store_counts(counts: DataFrame, path: str, period: str, force: bool = False) -> None:
    """Store counts under ``path``: ``values``, and ``buckets`` with the totals by bucket, both by period. Periods that are
    there already stay unless forced; files are sorted by bucket, so one bucket is read from few of their row groups."""
    keys = [c for c in counts.columns if c not in (period, "bucket", "value", "n")]
    write_partitions(counts, f"{path}/values", [period], force, order=["bucket", "value"])
    totals = counts.groupBy(*keys, period, "bucket").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    write_partitions(totals, f"{path}/buckets", [period], force, order=["bucket"])


def stored_thresholds(spark: SparkSession, path: str, keys: Sequence[str], periods: Column | None = None, asked: dict[str, tuple[float, str]] | None = None) -> DataFrame:
    """Per group n_samples, min_value, max_value and the quantiles asked for (``name: (q, rule)`` as in ``ranks.quantiles``), over
    the stored periods that the condition ``periods`` keeps: exact, and equal to what the raw rows give."""
    keys, asked = list(keys), asked or ASKED
    keep = periods if periods is not None else F.lit(True)
    totals = spark.read.parquet(f"{path}/buckets").where(keep).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    group = Window.partitionBy(*keys)  # a row a bucket
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    totals = totals.withColumns({"below": upto - F.col("n"), "whole": F.sum("n").over(group)})
    ranks = []
    for name, (q, rule) in asked.items():
        spot = (F.col("whole") - 1) * q
        if rule == "nearest":
            ends = [F.floor(spot + 0.5)]
        elif rule == "linear":
            ends = [F.floor(spot), F.ceil(spot)]
        else:
            raise ValueError(f"unknown rule {rule}")
        ranks += [F.struct(F.lit(name).alias("name"), F.lit(i).alias("end"), e.cast("long").alias("rank"), (spot - F.floor(spot)).alias("part")) for i, e in enumerate(ends)]
    inside = lambda r: (r["rank"] >= F.col("below")) & (r["rank"] < F.col("below") + F.col("n"))
    wanted = totals.withColumn("r", F.explode(F.filter(F.array(*ranks), inside))).select(*keys, "bucket", "below", "r.*")
    # only the buckets that hold a rank are opened
    spots = wanted.select(*keys, "bucket").distinct()
    opened = join_null_safe(spark.read.parquet(f"{path}/values").where(keep), spots, [*keys, "bucket"])
    opened = opened.groupBy(*keys, "bucket", "value").agg(F.sum("n").alias("n"))
    seen = F.sum("n").over(Window.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    found = join_null_safe(opened.withColumn("seen", seen), wanted, [*keys, "bucket"])
    found = found.where((F.col("rank") - F.col("below") < F.col("seen")) & (F.col("rank") - F.col("below") >= F.col("seen") - F.col("n")))
    columns = []
    for name, (_, rule) in asked.items():
        at = lambda i, name=name: F.max(F.when((F.col("name") == name) & (F.col("end") == i), F.col("value")))
        part = F.max(F.when(F.col("name") == name, F.col("part")))
        columns.append((at(0) if rule == "nearest" else F.when(part == 0, at(0)).otherwise((1 - part) * at(0) + part * at(1))).alias(name))
    base = totals.groupBy(*keys).agg(F.sum("n").alias("n_samples"), F.min("low").alias("min_value"), F.max("high").alias("max_value"))
    return join_null_safe(base, found.groupBy(*keys).agg(*columns), keys).select(*keys, "n_samples", "min_value", "max_value", *asked)
