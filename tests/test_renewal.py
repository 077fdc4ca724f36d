"""Incremental labels against whole histories, thresholds from stored counts, and the exact stratified cap."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels, splits, thresholds
from tidemark.plans import renewal
from tidemark.sources import feeds

SCHEMA = "id int, s string, t timestamp, v double"
START = datetime(2024, 1, 1)


def rows_like(seed, n=400):
    rng = random.Random(seed)
    times = {s: sorted(rng.sample(range(60 * 24 * 12), n // k)) for s, k in (("a", 1), ("b", 3), ("c", 40), (None, 9))}
    return [(i, s, START + timedelta(minutes=m), rng.random()) for i, (s, m) in enumerate((s, m) for s, ms in times.items() for m in ms)]


def table(spark, rows, path):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.date_format("t", "yyyyMMdd"))
    df.write.mode("overwrite").partitionBy("day").parquet(path)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))


def test_renewed_labels_equal_those_of_whole_histories(spark, tmp_path):
    rng, rows = random.Random(1), rows_like(1)
    day = lambda r: (r[2] - START).days
    changes = [
        [r for r in rows if day(r) < 9 and r[0] % 10],  # first run
        [r for r in rows if day(r) < 10],  # late rows, a new day
        [r for r in rows if day(r) not in (4, 5)],  # two days go, others come
        [r if day(r) != 8 else (*r[:3], rng.random()) for r in rows if day(r) not in (4,)],  # values change
    ]
    frozen = spark.createDataFrame([("a", 0.8, 0.95), ("b", 0.7, 0.9), ("c", 0.5, 0.6), (None, 0.5, 0.5)], "s string, p95 double, p99 double")
    out, replaced = str(tmp_path / "labels"), []
    before = renewal.fingerprints(table(spark, rows[:1], str(tmp_path / "none")).limit(0), "s", "day")
    for i, now in enumerate([*changes, changes[-1]]):
        df = table(spark, now, str(tmp_path / f"rows{i}"))
        replaced.append(renewal.renew_labels(df, before, out, "s", "t", "v", "day", frozen, [2, 7]))
        before = renewal.fingerprints(df, "s", "day")
        spark.catalog.refreshByPath(out)
        whole = labels.forward_labels(labels.attach_thresholds(df, frozen, "s", check=False), ["s"], "t", "v", {"p95": "p95", "p99": "p99"}, [2, 7])
        columns = ["id", "day", "target_geq_p95_2m", "target_geq_p99_7m"]
        got = spark.read.parquet(out).withColumn("day", F.col("day").cast("string")).select(*columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*columns).collect())), i
    assert replaced[-1] == [] and len(replaced[0]) == 9


def test_only_what_a_change_reaches_is_renewed(spark, tmp_path):
    rows = [(i, "a", START + timedelta(minutes=60 * i), 1.0) for i in range(24 * 10)]
    first = renewal.fingerprints(table(spark, rows[:200], str(tmp_path / "a")), "s", "day")
    now = renewal.fingerprints(table(spark, [(*r[:3], 2.0) if r[0] == 24 * 5 + 3 else r for r in rows[:200]], str(tmp_path / "b")), "s", "day")
    plan = {r.day: (r.renew, r.needed) for r in renewal.to_renew(now, first, "s", "day", 24).collect()}
    assert [d for d, (a, _) in sorted(plan.items()) if a] == ["20240105", "20240106"]
    assert [d for d, (_, b) in sorted(plan.items()) if b] == ["20240105", "20240106", "20240107"]


@pytest.mark.parametrize("chosen", [["2020"], ["2020", "2022"], ["2020", "2021", "2022"], ["2099"]])
def test_stored_thresholds_equal_those_of_raw_rows(spark, tmp_path, chosen):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["2020", "2021", "2022"]), rng.choice([None, rng.gauss(0, 50), float(rng.randrange(4))])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, y string, v double")
    path = str(tmp_path)
    for y in ("2020", "2021", "2022"):
        thresholds.store_counts(thresholds.value_counts(df.where(F.col("y") == y), ["k"], "v", "y"), path, "y")
    thresholds.store_counts(thresholds.value_counts(df.withColumn("v", F.lit(7.0)), ["k"], "v", "y"), path, "y")  # all there: kept
    got = thresholds.stored_thresholds(spark, path, ["k"], F.col("y").isin(*[int(c) for c in chosen])).collect()
    want = labels.group_thresholds(df.where(F.col("y").isin(*chosen)), ["k"], "v").collect()
    names = ["k", "n_samples", "min_value", "max_value", "median_value", "p95", "p99"]
    assert sorted(str([r[c] for c in names]) for r in got) == sorted(str([r[c] for c in names]) for r in want)


@pytest.mark.parametrize("n", [0, 1, 100, 333, 10_000])
def test_stratified_cap(spark, n):
    rows = [(i, "big" if i % 3 else (None if i % 2 else f"s{i % 5}")) for i in range(1500)]
    want, total = set(), len(rows)
    groups = {}
    for i, s in rows:
        groups.setdefault(s, []).append((hashlib.md5(f"{i}|42".encode()).hexdigest(), i))
    quota = {s: len(g) * n // total for s, g in groups.items()}
    order = sorted(groups, key=lambda s: (-(len(groups[s]) * n % total), s is not None, s or ""))
    for s in order[: min(n, total) - sum(quota.values())]:
        quota[s] += 1
    for s, g in groups.items():
        want |= {i for _, i in sorted(g)[: len(g) if n >= total else quota[s]]}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "mark int, quota string").repartition(parts)
        assert {r.mark for r in splits.stratified_cap(df, "quota", ["mark"], n).collect()} == want and len(want) == min(n, total)


def test_dropping_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    feeds.write_partitions(df, str(tmp_path / "t"), ["p"])
    feeds.drop_partitions(spark, str(tmp_path / "t"), "p", ["a", "gone"])
    spark.catalog.refreshByPath(str(tmp_path / "t"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [2]


def test_partitions_whose_labels_vanish_go_and_stored_fingerprints_serve(spark, tmp_path):
    rows = [(d * 10 + i, "a", START + timedelta(days=d, minutes=i), 1.0) for d in range(3) for i in range(4)]
    frozen = spark.createDataFrame([("a", 0.8, 0.95)], "s string, p95 double, p99 double")
    out, before = str(tmp_path / "labels"), renewal.fingerprints(table(spark, rows, str(tmp_path / "none")).limit(0), "s", "day")
    left = []
    for i, now in enumerate((rows, rows[:8])):
        df = table(spark, now, str(tmp_path / f"rows{i}"))
        stored = str(tmp_path / f"marks{i}")
        renewal.fingerprints(df, "s", "day").write.parquet(stored)
        marks = spark.read.parquet(stored)
        renewal.renew_labels(df, before, out, "s", "t", "v", "day", frozen, [4], now=marks)
        before = marks
        spark.catalog.refreshByPath(out)
        left.append(sorted((str(r.day), r.id) for r in spark.read.parquet(out).collect()))
    assert [sorted({d for d, _ in x}) for x in left] == [["20240101", "20240102"], ["20240101"]] and [len(x) for x in left] == [8, 4]


def test_marks_are_sums_of_hashes_and_the_plan_is_dealt_by_station_once(spark, tmp_path):
    df = table(spark, rows_like(3), str(tmp_path / "rows"))
    plain = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))
    want = sorted(map(str, df.groupBy(F.col("day").cast("string").alias("day"), "s").agg(F.count("*").alias("n"), plain.alias("mark")).collect()))
    found = renewal.fingerprints(df, "s", "day")
    assert sorted(map(str, found.collect())) == want and dict(found.dtypes)["mark"] == "decimal(38,0)"
    found.write.parquet(str(tmp_path / "marks"))
    marks = spark.read.parquet(str(tmp_path / "marks"))
    plan = renewal.to_renew(marks, marks.where("day > '20240105'"), "s", "day", 3)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line and "s#" in line for line in plan.splitlines()) == 2  # once, read by two branches
