"""Ranks, running totals and quantiles against numpy, on values that spread over many buckets, and names that clash."""

import datetime
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import fresh
from tidemark.operators import blocks, dedupe, labels, metrics, ranking, ranks, resample, splits
from tidemark.sources import feeds


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(0, 1000, 4000)] + [("b", float(v)) for v in rng.exponential(1e-6, 3000)] + [("c", float(v)) for v in rng.integers(-3, 4, 500)]
    rows += [(None, 5.0), ("d", None), ("a", None), ("e", float("inf")), ("e", -float("inf")), ("e", 0.0)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(6).persist()


def test_buckets_never_fall(spark):
    ladder = sorted([0.0, math.inf, -math.inf, 1e-300, 5e-324, 1e308, *[s * b * (1 + i * 1e-9) for s in (1, -1) for b in (1e-9, 0.5, 1.0, 2.0, 1024.0, 3.7e11) for i in range(-40, 40)]])
    got = [r[0] for r in spark.createDataFrame([(v, i) for i, v in enumerate([*ladder, math.nan])], "v double, i int").select(ranks.rank_bucket("v"), "i").orderBy("i").collect()]
    assert all(x <= y for x, y in itertools.pairwise(got)) and len(set(got)) > 20


def test_running_totals(spark, values):
    rows, df = values
    counts = df.where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    for descending in (False, True):
        got = {(r.k, r.v): (r.upto, r.all) for r in ranks.running_totals(counts, ["k"], "v", {"n": ("upto", "all")}, descending).collect()}
        for k in {k for k, v in rows if v is not None}:
            mine = sorted(v for x, v in rows if x == k and v is not None)
            for v in mine[:: max(1, len(mine) // 200)]:
                assert got[k, v] == (sum(x >= v if descending else x <= v for x in mine), len(mine))


def test_quantiles(spark, values):
    rows, df = values
    got = {r.k: r for r in ranks.quantiles(df, ["k"], "v", {"mid": (0.5, "linear"), "hi": (0.95, "linear"), "near": (0.95, "nearest")}).collect()}
    assert set(got) == {"a", "b", "c", "e", None}
    for k in ("a", "b", "c", None):
        mine = np.sort([v for x, v in rows if x == k and v is not None])
        assert got[k].mid == pytest.approx(np.quantile(mine, 0.5), rel=1e-12) and got[k].hi == pytest.approx(np.quantile(mine, 0.95), rel=1e-12)
        assert got[k].near == mine[math.floor((len(mine) - 1) * 0.95 + 0.5)]
    whole = [v for k, v in rows if k in ("a", "b") and v is not None]
    some = df.where("k in ('a', 'b')").select("v", (-F.col("v")).alias("w"), F.lit(None).cast("double").alias("none"), F.lit(7).alias("same"))
    for accuracy in (10_000, 3):  # a coarse sketch misses its ranks, and brackets are widened
        found = ranks.column_quantiles(some, ["v", "w", "none", "same"], [0.0, 0.5, 0.97, 1.0], accuracy)
        assert found["none"] == [None] * 4 and found["same"] == [7.0] * 4
        assert found["v"] == pytest.approx(np.quantile(whole, [0, 0.5, 0.97, 1])) and found["w"] == pytest.approx(np.quantile([-v for v in whole], [0, 0.5, 0.97, 1]))
    assert labels.quantile(df.where("false"), "v", 0.5, "q").collect()[0].q is None
    assert ranks.quantiles(df.where("false"), ["k"], "v", {"mid": (0.5, "linear")}).count() == 0


def test_spearman_of_continuous_values(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=3000)
    y = x + rng.normal(size=3000)
    df = spark.createDataFrame([(None, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k string, x double, y double")
    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert ranking.spearman(df, ["k"], "x", "y").collect()[0].spearman == pytest.approx(want)
    assert ranking.spearman(df, [], "x", "y").collect()[0].spearman == pytest.approx(want)


def test_auc_of_continuous_scores(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 2000)
    p = np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y_true int, y_prob double")
    want = np.mean([(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]])
    assert metrics.ranking_metrics(df).collect()[0].roc_auc == pytest.approx(want)


def test_fill_both_ways_over_days(spark):
    rng = np.random.default_rng(7)
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"s{i % 3}", start + datetime.timedelta(hours=int(5 * i)), f"v{i}" if rng.random() < 0.1 else None, 1) for i in range(300)] + [("none", start, None, 1)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v string, __part int").repartition(5)
    got = resample.fill_both_ways(df, ["k"], "t", "v")
    assert got.columns == df.columns
    frame = pd.DataFrame(rows, columns=["k", "t", "v", "p"]).sort_values("t")
    want = frame.assign(v=frame.groupby("k")["v"].transform(lambda x: x.ffill().bfill()))
    assert {(r.k, r.t): r.v for r in got.collect()} == {(r.k, r.t.to_pydatetime()): r.v if isinstance(r.v, str) else None for r in want.itertuples()}


def test_names_that_clash(spark):
    assert fresh(["__day", "___DAY", "x"], "day", "x") == ["____day", "__x"]
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, start + datetime.timedelta(hours=i), float(i), "mine", i, {"b": i}) for i in range(60)], "k int, t timestamp, v double, __day string, __reset int, m map<string,int>")
    out = labels.lagged_differences(df, ["k"], "t", {"d": ("v", 2)}, "month")
    assert out.columns == [*df.columns, "d"] and {(r["__day"], r["__reset"] == r.v) for r in out.collect()} == {("mine", True)}
    with pytest.raises(ValueError, match="__block"):
        blocks.number_rows(df.withColumn("__block", F.lit(1)), ["k"], "t")
    twice = spark.createDataFrame([(1, {"a": 1}, "x", 5), (1, {"a": 2}, "x", 5), (2, None, "y", 6)], "k int, m map<string,int>, __row string, __priority int")
    assert sorted((r.k, (r.m or {}).get("a"), r["__row"]) for r in dedupe.keep_last(twice, ["k"]).collect()) == [(1, 2, "x"), (2, None, "y")]
    assert [r.m for r in dedupe.keep_priority(twice.where("k = 1"), ["k"], F.lit(1), "__row").collect()] == [{"a": 1}]


def test_sample_is_of_exactly_n_rows(spark):
    df = spark.range(3000).withColumn("same", F.lit("x"))
    for n in (0, 1, 7, 500, 5000):
        assert splits.seeded_sample(df, ["id"], n).count() == min(n, 3000)
    assert splits.seeded_sample(df, ["same"], 10).count() == 10
    assert splits.seeded_sample(df, ["id"], 10).collect() == splits.seeded_sample(df.repartition(7), ["id"], 10).collect()


def test_head_of_an_order(spark):
    df = spark.range(4000).select((F.col("id") * 7919 % 4001).alias("a"), F.when(F.col("id") % 400 != 0, F.col("id") % 50).alias("b"), F.col("id").cast("string").alias("c"))
    rows = [tuple(r) for r in df.collect()]
    for order in (["a"], ["b", "a"], ["c"]):
        at = [df.columns.index(o) for o in order]
        want = sorted(rows, key=lambda r: [(r[i] is not None, r[i] if r[i] is not None else 0) for i in at])
        for n in (0, 5, 300, 5000):
            assert [tuple(r) for r in splits.head_rows(df, order, n).collect()] == want[:n]


def test_years_prune_partitions(spark, tmp_path):
    spark.range(48).select("id", F.concat(2000 + F.floor(F.col("id") / 12), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0")).alias("yyyymm")).write.partitionBy("yyyymm").parquet(str(tmp_path / "t"))
    some = feeds.read_training_years(spark, str(tmp_path / "t"), 2001, 2002, [3])
    assert some.count() == 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "substring" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_station_summary(spark):
    df = spark.createDataFrame([("a", "train", 1, 2.0), ("a", "train", 0, 4.0), ("a", "test", 1, None), (None, "test", 0, 3.0)], "station string, split string, y int, proxy double")
    got = {(r.station, r.split): (r.rows, r.event_rate, r.source_mean, r.source_std) for r in splits.station_summary(df, "station", "y", "proxy").collect()}
    assert got == {("a", "train"): (2, 0.5, 3.0, pytest.approx(2**0.5)), ("a", "test"): (1, 1.0, None, None), (None, "test"): (1, 0.0, 3.0, None)}


def test_quantiles_of_groups_of_any_size_agree(spark):
    rng = np.random.default_rng(3)
    sizes = {"a": 1, "b": 2, "c": 7, "d": 60, None: 23}
    rows = [(k, float(x)) for k, n in sizes.items() for x in rng.choice([-0.0, 0.0, 1.5, -2.0, float("nan"), *rng.normal(size=9)], n)] + [("e", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    asked = {"n50": (0.5, "nearest"), "n95": (0.95, "nearest"), "l30": (0.3, "linear")}
    found = [sorted(map(str, ranks.quantiles(df, ["k"], "v", asked, [F.max("v").alias("top")], window_rows=w).collect())) for w in (0, 7, 23, 1000)]
    assert len(found[0]) == 5 and found[0] == found[1] == found[2] == found[3]
    plan = ranks.quantiles(df, ["k"], "v", asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # small groups: one shuffle of their rows
