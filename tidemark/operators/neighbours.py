"""Mutual information of a number and a class by nearest neighbours, exact and without a series in one task.

For each value the distance r to its k-th nearest neighbour of its own class is found, then how many rows of all classes lie
within it (m); with N rows, N_y of the class and k neighbours, the information is psi(N) + <psi(k)> - <psi(N_y)> - <psi(m)>.
Equal values count once with their number. Values are dealt to buckets that keep their order; a bucket borrows the k values
before and after it, so the neighbours come from windows over single buckets. How many rows lie below r's ends is read off
running totals into which the ends are merged, again bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import join_null_safe, rank_bucket, running_totals

EULER = 0.5772156649015329


def digamma(m: Column) -> Column:
    """psi of a whole number above 0: by harmonic numbers up to 10, by its series beyond."""
    small = F.array(*[F.lit(sum(1 / j for j in range(1, i)) - EULER) for i in range(1, 11)])
    x = m.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(m <= 10, F.element_at(small, F.least(m, F.lit(10)).cast("int"))).otherwise(series)


def _with_neighbours(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``(keys, y, v, n)`` with ``near``: the k values before and the k after, with their numbers."""
    rows = counts.withColumn("bucket", rank_bucket("v"))
    group = Window.partitionBy(*keys, "y", "bucket")
    item = F.struct("v", "n")
    rows = rows.withColumns({
        "i": F.row_number().over(group.orderBy("v")), "j": F.row_number().over(group.orderBy(F.desc("v"))),
        "before": F.collect_list(item).over(group.orderBy("v").rowsBetween(-k, -1)), "after": F.collect_list(item).over(group.orderBy("v").rowsBetween(1, k)),
    })
    ends = rows.where((F.col("i") <= k) | (F.col("j") <= k)).groupBy(*keys, "y", "bucket").agg(
        F.array_sort(F.collect_list(F.when(F.col("i") <= k, item))).alias("first"), F.array_sort(F.collect_list(F.when(F.col("j") <= k, item))).alias("last")
    )
    line = Window.partitionBy(*keys, "y").orderBy("bucket")  # a row a bucket; every bucket holds a value at least
    ends = ends.select(
        *keys, "y", "bucket", F.flatten(F.collect_list("last").over(line.rowsBetween(-k, -1))).alias("earlier"), F.flatten(F.collect_list("first").over(line.rowsBetween(1, k))).alias("later")
    )
    joined = join_null_safe(rows, ends, [*keys, "y", "bucket"])
    tail = F.reverse(F.slice(F.reverse(F.concat("earlier", "before")), 1, k))
    return joined.select(*keys, "y", "v", "n", F.concat(tail, F.slice(F.concat("after", "later"), 1, k)).alias("near"))


def neighbour_information(df: DataFrame, keys: Sequence[str], x: str, y: str, neighbours: int = 3) -> DataFrame:
    """``mutual_info`` (nats, at least 0) per group of a number ``x`` and a class ``y``.

    Rows without x or y, and classes of one row, are left out; a class of fewer rows than ``neighbours`` + 1 looks at all of
    its others. Distances are compared as they are: equal values are at distance 0, and no noise is added to tell them apart.
    A group without rows that count gives 0.
    """
    keys = list(keys)
    named = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & F.col(y).isNotNull()).select(*keys, F.col(y).alias("y"), F.col(x).cast("double").alias("v"))
    counts = named.groupBy(*keys, "y", "v").agg(F.count("*").alias("n"))
    classes = counts.groupBy(*keys, "y").agg(F.sum("n").alias("n_class")).where("n_class > 1")
    counts = join_null_safe(counts, classes, [*keys, "y"])
    k = F.least(F.lit(neighbours), F.col("n_class") - 1)
    ranked = join_null_safe(_with_neighbours(counts.drop("n_class"), keys, neighbours), classes, [*keys, "y"])
    by_distance = F.array_sort(F.transform("near", lambda s: F.struct(F.abs(s["v"] - F.col("v")).alias("d"), s["v"].alias("v"), s["n"].alias("n"))))
    ranked = ranked.withColumn("k", k).withColumn("near", by_distance)
    # the nearest value by which k rows are reached, the value's own other rows first
    reach = F.aggregate(
        "near",
        F.struct((F.col("n") - 1).alias("seen"), F.lit(None).cast("double").alias("r")),
        lambda s, e: F.struct(
            (s["seen"] + e["n"]).alias("seen"), F.coalesce(s["r"], F.when((s["seen"] < F.col("k")) & (s["seen"] + e["n"] >= F.col("k")), e["d"])).alias("r")
        ),
    )["r"]
    ranked = ranked.withColumn("r", F.when(F.col("n") > F.col("k"), F.lit(0.0)).otherwise(reach))
    # an end that is a neighbour's value is that value, so rounding cannot take it in
    end = lambda far, side: F.coalesce(F.try_element_at(F.transform(F.filter("near", lambda s: (s["d"] == F.col("r")) & side(s["v"], F.col("v"))), lambda s: s["v"]), F.lit(1)), far)
    low, high = end(F.col("v") - F.col("r"), lambda a, b: a < b), end(F.col("v") + F.col("r"), lambda a, b: a > b)
    one = F.col("r") == 0
    ranked = ranked.select(*keys, "y", "v", "n", "n_class", "k", one.alias("one"), F.when(one, F.col("v")).otherwise(low).alias("low"), F.when(one, F.col("v")).otherwise(high).alias("high"))
    ask = lambda c: ranked.select(*keys, F.col(c).alias("v"), F.lit(0).cast("long").alias("n"))
    merged = counts.select(*keys, "v", "n").unionByName(ask("low")).unionByName(ask("high")).groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    totals = running_totals(merged, keys, "v", {"n": ("upto", "whole")})
    at = lambda name: totals.select(*keys, F.col("v").alias(name), F.col("upto").alias(f"{name}_upto"), (F.col("upto") - F.col("n")).alias(f"{name}_below"), *(["whole"] if name == "low" else []))
    found = join_null_safe(join_null_safe(ranked, at("low"), [*keys, "low"]), at("high"), [*keys, "high"])
    m = F.when(F.col("one"), F.col("low_upto") - F.col("low_below")).otherwise(F.col("high_below") - F.col("low_upto"))
    mean = lambda c: F.sum(digamma(c) * F.col("n")) / F.sum("n")
    value = digamma(F.max("whole")) + mean(F.col("k")) - mean(F.col("n_class")) - mean(m)
    return found.groupBy(*keys).agg(F.greatest(F.lit(0.0), value).alias("mutual_info"))
