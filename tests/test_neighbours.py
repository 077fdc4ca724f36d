"""Nearest-neighbour mutual information against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import neighbours as N


def psi(m):
    return sum(1 / j for j in range(1, m)) - N.EULER


def plain(rows, k):
    rows = [(x, y) for x, y in rows if x is not None and y is not None and not math.isnan(x)]
    size = {c: sum(y == c for _, y in rows) for _, c in rows}
    rows = [(x, y) for x, y in rows if size[y] > 1]
    if not rows:
        return None
    total = 0.0
    for i, (x, y) in enumerate(rows):
        near = min(k, size[y] - 1)
        r = sorted(abs(a - x) for j, (a, b) in enumerate(rows) if j != i and b == y)[near - 1]
        m = sum(abs(a - x) < r or a == x for a, _ in rows)
        total += psi(near) - psi(size[y]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("k", [1, 3, 5])
def test_equals_all_pairs(spark, k):
    rng = random.Random(k)
    groups = {
        "apart": [(rng.randrange(-2000, 2000) / 64 + 40 * (y := rng.randrange(2)), y) for _ in range(150)],
        "ties": [(float(rng.randrange(6)), rng.randrange(3)) for _ in range(120)],
        "wide": [(math.ldexp(rng.randrange(-512, 512), rng.randrange(-30, 30)), rng.randrange(2)) for _ in range(80)],
        "few": [(1.0, 0), (2.0, 0), (5.0, 1), (None, 1), (3.0, None), (float("nan"), 0)],
        "same": [(7.0, i % 2) for i in range(9)],
        "one": [(1.0, 0)],
    }
    rows = [(g, x, y) for g, v in groups.items() for x, y in v]
    got = {r.g: r.mutual_info for r in N.neighbour_information(spark.createDataFrame(rows, "g string, x double, y int"), ["g"], "x", "y", k).collect()}
    want = {g: plain(v, k) for g, v in groups.items()}
    assert set(got) == {g for g, v in want.items() if v is not None}
    for g in got:
        assert got[g] == pytest.approx(want[g], abs=1e-9), g


def test_digamma(spark):
    got = spark.range(1, 400).select(F.col("id"), N.digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r.p - psi(r.id)) < 1e-10 for r in got)


def test_no_window_holds_a_whole_series(spark):
    df = spark.range(20_000).select(F.lit("s").alias("g"), (F.rand(1) * 100 + 1).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    counts = df.select("g", F.col("x").alias("v"), "y").groupBy("g", "y", "v").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("g", "y", N.rank_bucket("v").alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] < 100 < sizes.count()
    assert N.neighbour_information(df, ["g"], "x", "y").first().mutual_info < 0.05
