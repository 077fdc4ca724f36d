"""As-of joins, grids, resampling, dedupe, labels and lags on small frames with literal or brute-force results."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.functions.derived import INPUTS, add_derived
from tidemark.operators import asof, blocks, dedupe, labels, resample
from tidemark.plans import pipeline

T0 = datetime(2024, 1, 31, 23, 0)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_asof_bounds_and_null_matches(spark):
    left = spark.createDataFrame([(1, at(0)), (2, at(180)), (3, at(181)), (4, at(-1)), (5, None)], "id int, t timestamp")
    right = spark.createDataFrame([(at(0), None), (at(0), -1.0), (at(500), 9.0)], "rt timestamp, v double")
    got = {r.id: (r.v, r.x_freshness_min, r.x_missing) for r in asof.asof_join(left, right.where("v is null or v > 0"), "t", "rt", 180, ["v"], name="x").collect()}
    assert got == {1: (None, 0.0, False), 2: (None, 180.0, False), 3: (None, None, True), 4: (None, None, True), 5: (None, None, True)}
    none = asof.asof_join(left, asof.empty_source(right, ["v"], "rt"), "t", "rt", 180, ["v"], name="x").collect()
    assert len(none) == 5 and all(r.x_missing and r.v is None for r in none)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    left=st.lists(st.tuples(st.integers(0, 400), st.integers(0, 2)), max_size=25), right=st.lists(st.tuples(st.integers(0, 400), st.integers(0, 2)), max_size=25), tolerance=st.integers(1, 60)
)
def test_asof_property(spark, left, right, tolerance):
    a = spark.createDataFrame([(i, at(m), k) for i, (m, k) in enumerate(left)], "id int, t timestamp, k int")
    b = spark.createDataFrame([(at(m), k, m) for m, k in right], "rt timestamp, k int, v int")
    got = {r.id: r.v for r in asof.asof_join(a, b, "t", "rt", tolerance, ["v"], ["k"]).collect()}
    for i, (m, k) in enumerate(left):
        assert got[i] == max((x for x, y in right if y == k and m - tolerance <= x <= m), default=None)


def test_fusion_of_several_sources_keeps_all_rows(spark):
    base = spark.createDataFrame([("abc", at(m), float(m), 1.0) for m in (0, 1, 2, 2)], "station string, t timestamp, n double, e double")
    s1 = spark.createDataFrame([(at(1), 5.0)], "ts timestamp, a double")
    s2 = spark.createDataFrame([(at(-30), 7.0)], "ts timestamp, b double")
    out = pipeline.fuse_station_minutes(base, "station", "t", "n", "e", [asof.Source("one", s1, "ts", ["a"], 5), asof.Source("two", s2, "ts", ["b"], 31)])
    got = sorted((r.t, r.station, r.a, r.b, r.one_missing, r.two_missing) for r in out.collect())
    assert got == [(at(0), "ABC", None, 7.0, True, False), (at(1), "ABC", 5.0, 7.0, False, False), (at(2), "ABC", 5.0, None, False, True)]


def test_dedupe_breaks_ties_by_all_columns(spark):
    df = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "b", 0), (1, 4, "z", 9), (2, None, "q", 2)], "k int, t int, v string, p int")
    assert sorted(tuple(r) for r in dedupe.keep_last(df, ["k"], ["t"]).collect()) == [(1, 5, "b", 0), (2, None, "q", 2)]
    assert sorted(r.v for r in dedupe.keep_first(df, ["k"], ["t"]).collect()) == ["q", "z"]
    assert sorted(r.v for r in dedupe.keep_priority(df, ["k"], F.col("p"), "v").collect()) == ["q", "z"]
    assert dedupe.count_duplicates(df, ["k"]).first()[0] == 2 and dedupe.count_duplicates(df.where("false"), ["k"]).first()[0] == 0


def test_grids(spark):
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(3), 2.0), ("b", at(70), 3.0), ("c", None, 4.0)], "s string, t timestamp, v double")
    grid = resample.minute_grid(df, ["s"], "t").orderBy("s", "t").collect()
    assert [(r.s, r.t, r.v, r.has_observation) for r in grid] == [
        ("a", at(0), 1.0, True), ("a", at(1), None, False), ("a", at(2), None, False), ("a", at(3), 2.0, True), ("b", at(70), 3.0, True),
    ]
    months = resample.month_grid(df, ["s"], "t")
    assert {(r.s, r["count"]) for r in months.groupBy("s").count().collect()} == {("a", 31 * 1440), ("b", 29 * 1440)}
    assert resample.grid_gaps(months, ["s"], F.col("v").isNotNull()).where("s = 'a'").first().gaps == 31 * 1440 - 2


def test_resample_counts_fractions_and_circles(spark):
    df = spark.createDataFrame(
        [("x", at(0), 1.0, 359.0, None, 0), ("x", at(0) + timedelta(seconds=20), None, 1.0, "b", 3), ("x", at(0) + timedelta(seconds=40), 3.0, None, "a", 1), ("x", None, 9.0, 0.0, "q", 9)],
        "s string, t timestamp, v double, lon double, id string, flag int",
    )
    r = resample.resample_minutes(df, ["s"], "t", means=["v"], circular=["lon"], maxima=["flag"], firsts=["id"], components=["v", "lon"]).first()
    assert (r.n_points, r.v, r.n_v, r.flag, r.id, r.n_valid, round(r.v_missing_fraction, 6)) == (3, 2.0, 2, 3, "b", 1, round(1 / 3, 6)) and abs(r.lon) < 1e-9


def test_reduction_of_nulls(spark):
    df = spark.createDataFrame([(at(0), "a", None, None, None), (at(0), "b", 2.0, True, None), (at(1), "a", None, None, None)], "t timestamp, sat string, v double, ok boolean, n long")
    got = {r.t: (r.n_satellites, r.v, r.any_ok, r.n) for r in resample.reduce_satellites(df, "t", "sat", ["v"], ["ok"], ["n"]).collect()}
    assert got == {at(0): (2, 2.0, True, 0), at(1): (1, None, False, 0)}


def series(spark, n=50, block=None):
    rng = random.Random(1)
    rows = [(s, at(m), rng.choice([None, *map(float, range(6))])) for s in "ab" for m in range(n)]
    return rows, spark.createDataFrame(rows, "s string, t timestamp, v double")


@pytest.mark.parametrize("block_rows", [7, 100_000])
def test_frames_over_blocks_are_exact(spark, block_rows):
    rows, df = series(spark)
    made = lambda w: {"lag": F.lag("v", 3).over(w), "ahead": F.max("v").over(w.rowsBetween(1, 5)), "n": F.count("*").over(w.rowsBetween(1, 5))}
    got = {(r.s, r.t): (r.lag, r.ahead, r.n) for r in blocks.over_blocks(df, ["s"], "t", made, before=3, after=5, block_rows=block_rows).collect()}
    assert len(got) == len(rows)
    for s in "ab":
        v = [x for q, _, x in rows if q == s]
        for i in range(len(v)):
            ahead = [x for x in v[i + 1 : i + 6] if x is not None]
            assert got[(s, at(i))] == (v[i - 3] if i >= 3 else None, max(ahead, default=None), len(v[i + 1 : i + 6]))


def test_forward_labels(spark):
    rows, df = series(spark)
    out = labels.forward_labels(df.withColumn("p95", F.lit(4.0)), ["s"], "t", "v", {"p95": "p95"}, [2, 4])
    got = {(r.s, r.t): (r.target_geq_p95_2m, r.target_geq_p95_4m) for r in out.collect()}
    want = {}
    for s in "ab":
        v = [x for q, _, x in rows if q == s]
        for i in range(len(v) - 4):
            if None not in v[i + 1 : i + 5]:
                want[(s, at(i))] = (int(max(v[i + 1 : i + 3]) >= 4), int(max(v[i + 1 : i + 5]) >= 4))
    assert got == want and want


def test_change_starts_anew_each_month(spark):
    df = spark.createDataFrame([("a", at(59), 3.0, 4.0), ("a", at(60), 0.0, 1.0), ("a", at(61), 0.0, 3.0)], "s string, t timestamp, n double, e double")
    by = lambda reset: [r.abs_change for r in labels.magnitude_and_change(df, ["s"], "t", "n", "e", reset).orderBy("t").collect()]
    assert by("month") == [None, None, 2.0] and by(None) == [None, 4.0, 2.0]
    diff = labels.lagged_differences(df, ["s"], "t", {"d": ("e", 2)}).orderBy("t").collect()
    assert [r.d for r in diff] == [None, None, -1.0]


@pytest.mark.parametrize("n", [1, 2, 20, 101])
def test_quantiles(spark, n):
    df = spark.createDataFrame([("g", float(i)) for i in range(n)] + [("g", None)], "g string, v double")
    near = labels.quantiles_nearest(df, ["g"], "v", [0.5, 0.95]).first()
    assert (near.p50, near.p95) == (int((n - 1) * 0.5 + 0.5), int((n - 1) * 0.95 + 0.5))
    line = labels.group_thresholds(df, ["g"], "v", "linear").first()
    assert line.n_samples == n and abs(line.p95 - (n - 1) * 0.95) < 1e-9
    assert labels.group_thresholds(df, ["g"], "v", "approx").first().p99 == pytest.approx((n - 1) * 0.99, abs=1.01)


def test_thresholds_must_be_there(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "s string, v double")
    have = spark.createDataFrame([("a", 1.0, 2.0)], "s string, p95 double, p99 double")
    with pytest.raises(ValueError, match="b"):
        labels.attach_thresholds(df, have, "s")
    assert labels.bad_thresholds(have.withColumn("p95", F.lit(3.0))).count() == 1


def test_lookback_lengths(spark):
    df = spark.createDataFrame([("a", at(i), float(i)) for i in range(3)] + [("b", at(0), 9.0)], "s string, t timestamp, v double")
    assert [[x.v for x in r.sequence] for r in labels.lookback_sequences(df, ["s"], "t", ["v"], 3).collect()] == [[0.0, 1.0, 2.0]]
    assert labels.lookback_sequences(df, ["s"], "t", ["v"], 4).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(9999.99, 9999.0, "{'nez': 1.5, 'geo': None}", "7"), (1.0, 9999.99, "{'nez': nan}", "x"), (None, 2.0, "junk", None)], "a double, b double, d string, n string")
    got = C.null_sentinels(df, {"a": [9999.99], "b": [9999.0], "absent": [1.0]}).select("a", "b", C.nested_number("d", "nez").alias("z"), C.to_number("n").alias("n"), C.clip("b", 0.0, 10.0).alias("c"))
    assert [tuple(r) for r in got.collect()] == [(None, None, 1.5, 7.0, None), (1.0, 9999.99, None, None, 10.0), (None, 2.0, None, None, 2.0)]
    assert C.project_optional(df, {"a": "float", "zz": "string"}).dtypes == [("a", "float"), ("zz", "string")]
    assert [r[0] for r in df.select(C.first_present(df, ["none", "n", "d"])).collect()] == ["7", "x", "junk"]
    assert C.drop_all_null(df.withColumn("e", F.lit(None).cast("int")), ["a"]).columns == ["a", "b", "d", "n"]
    assert C.drop_named(df, ["a"], ["n"]).columns == ["b", "d"]
    with pytest.raises(ValueError, match="columns differ"):
        C.union_strict(df, df.drop("a"))
    assert C.union_strict(df, df.withColumn("a", F.lit(1))).count() == 6
    half = C.standardise(spark.createDataFrame([(2.5, 1), (3.5, 0)], "x double, f int"), counts=["x"], flags=["f"])
    assert [tuple(r) for r in half.collect()] == [(2, True), (4, False)]
    old = df.select(C.generation(df, ["zz"]).alias("g"), C.generation(df, ["a"]).alias("h"))
    assert [tuple(r) for r in old.collect()] == [("legacy", "goesr"), ("legacy", "goesr"), ("legacy", "legacy")]


def test_derived_families_need_their_inputs(spark):
    rows = [("a", at(i), *[float(i + k) for k in range(len(INPUTS["sun"]))]) for i in range(12)]
    df = spark.createDataFrame(rows, ["s", "t", *INPUTS["sun"]])
    out = blocks.own_rows(add_derived(blocks.blocked(df, ["s"], "t", before=15), blocks.lag(["s"])))
    made = [c for c in out.columns if c not in df.columns]
    assert made and all(c.startswith("sun_") for c in made)
    assert [r.sun_xrsb_diff_10m for r in out.orderBy("t").collect()] == [None] * 10 + [10.0, 10.0]


def test_residuals(spark):
    one = ", ".join(f"{v} as {p}_{c}" for c in ("north", "east", "centre") for p, v in (("tdep", 1.0), ("static", 2.0), ("gsm", 3.0), ("sm", 4.0)))
    model = spark.sql(f"select 1 as k, {one}")
    seen = spark.sql("select 1 as k, 20D as b_north, 20D as b_east, 20D as b_centre union all select 2, 1D, 1D, 1D")
    r = resample.attach_residuals(seen, model, ["k"]).collect()
    assert len(r) == 1 and (r[0].residual_total_east, r[0].residual_internal_east) == (10, 17)


def test_a_new_month_is_labelled_like_the_whole(spark, tmp_path):
    rng = random.Random(8)
    rows = [("a", at(m), rng.random()) for m in range(180)]
    df = spark.createDataFrame(rows, "s string, t timestamp, v double").withColumn("yyyymm", F.date_format("t", "yyyyMM"))
    df.write.partitionBy("yyyymm").parquet(str(tmp_path / "m"))
    thr = spark.createDataFrame([("a", 0.5, 0.9)], "s string, p95 double, p99 double")
    stored = spark.read.parquet(str(tmp_path / "m"))
    month = pipeline.label_new_month(stored, "202401", "s", "t", "v", thr, (5, 10))
    whole = labels.forward_labels(labels.attach_thresholds(df, thr, "s"), ["s"], "t", "v", {"p95": "p95", "p99": "p99"}, (5, 10)).where("yyyymm = '202401'")
    names = ["t", "target_geq_p95_5m", "target_geq_p99_10m"]
    assert sorted(month.select(names).collect()) == sorted(whole.select(names).collect()) and month.count() == 60


def test_label_stage_derives_features(spark):
    rows = [("a", at(m), float(m % 7), float(m), float(m + 1)) for m in range(60)]
    df = spark.createDataFrame(rows, ["s", "t", "v", *INPUTS["sun"]])
    out = pipeline.label_and_derive(df, "s", "t", "v", df, (3,))
    assert out.count() == 57 and "sun_xrsa_diff_10m" in out.columns and out.where("target_geq_p95_3m = 1").count() > 0
    tasks = pipeline.tasks(out, "t", ["s", "t"], ["target_geq_p95_3m"], {"train": ("2024-01-31", "2024-01-31"), "test": ("2024-02-01", "2024-02-02")})
    assert "v" in tasks["target_geq_p95_3m"].columns and not any("p99" in c for c in tasks["target_geq_p95_3m"].columns if c.startswith("target"))


def test_asof_keys_and_columns_of_any_name(spark):
    for name in ("t", "bucket", "side", "row", "salt", "until", "__t", "key_0", "match_0"):
        left = spark.createDataFrame([(1, 5, 0), (2, 9, 0), (1, 9, 1)], f"`{name}` int, at int, n int").withColumn("at", F.timestamp_seconds(F.col("at") * 60))
        right = spark.createDataFrame([(1, 4, "a"), (2, 1, "b")], f"`{name}` int, rt int, v string").withColumn("rt", F.timestamp_seconds(F.col("rt") * 60))
        for hot in (asof.HOT_ROWS, 1):
            got = asof.fuse(left, "at", [asof.Source("x", right, "rt", ["v"], 5, [name])], [name], hot).collect()
            assert sorted((r[name], r.n, r.v) for r in got) == [(1, 0, "a"), (1, 1, "a"), (2, 0, None)], name
    same = right.withColumnRenamed("v", "n")
    with pytest.raises(ValueError, match="more than once"):
        asof.fuse(left, "at", [asof.Source("x", same, "rt", ["n"], 5)])
    with pytest.raises(ValueError, match="x_missing"):
        asof.fuse(left, "at", [asof.Source("x", right, "rt", ["v"], 5), asof.Source("x", right.select("rt", F.col("v").alias("u")), "rt", ["u"], 5)])


def test_a_hot_bucket_is_spread_over_tasks(spark):
    minutes = lambda c: F.timestamp_seconds(c.cast("long") * 60)
    base = spark.range(20_000).select(F.col("id").alias("station"), minutes(F.col("id") % 50).alias("t"))
    source = spark.range(30).select(minutes(F.col("id") * 2).alias("rt"), F.col("id").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = lambda hot: asof.fuse(base, "t", [asof.Source("x", source, "rt", ["v"], 60)], hot_rows=hot)
        share = lambda df: max(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("v")).collect())
        assert share(rows(10**6)) == 20_000 and share(rows(200)) < 12_000
        key = lambda df: sorted(map(tuple, df.select("station", "v", "x_missing").collect()))
        assert key(rows(200)) == key(rows(10**6)) == [(i, min((i % 50) // 2, 29), False) for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_grids_and_summaries_with_names_of_their_own(spark):
    from tidemark.operators import metrics, splits

    names = ["lo", "hi", "day", "at", "seen", "minute", "__minute", "__seen"]
    for name in names:
        df = spark.createDataFrame([(1, at(0), 5.0), (1, at(3), 6.0)], f"`{name}` int, t timestamp, v double")
        assert resample.minute_grid(df, [name], "t").count() == 4
        assert resample.resample_minutes(df, [name], "t", ["v"]).count() == 2
        assert resample.left_on_minute(df, df.withColumnRenamed("v", "w"), [name], "t").count() == 2
    df = spark.createDataFrame([(k, i % 2, i / 10, i % 2) for k in "ab" for i in range(10)], "__s string, y_true int, y_prob double, __p int")
    assert metrics.ranking_metrics(df, ["__s"]).count() == 2 and metrics.select_threshold(df, ["__s"]).count() == 2
    assert metrics.ranking_metrics(df.withColumnRenamed("__s", "__n"), ["__n"]).count() == 2 and metrics.threshold_scan(df, ["__p"]).count() == 38
    table = spark.createDataFrame([("x", at(0), "train", 1), ("z", at(1), "val", 0)], "y string, target timestamp, split string, a int")
    assert {(r.split, r.rows) for r in splits.task_summary(table, ["a"], "y", "target").collect()} == {("train", 1), ("val", 1), ("test", 0)}


def test_series_within_a_block_take_one_shuffle_and_longer_ones_are_cut(spark):
    """Lags of short and long series, null keys among them, equal plain ones; without long series the rows move once."""
    df = spark.createDataFrame([(k, at(400 * i), float(i * i % 17)) for k, n in (("a", 30), ("b", 4), (None, 25), ("c", 5)) for i in range(n)], "s string, t timestamp, v double")
    made = lambda w: {"lag": F.lag("v", 3).over(w), "ahead": F.max("v").over(w.rowsBetween(1, 2))}
    whole = Window.partitionBy("s").orderBy("t")
    want = sorted(map(str, df.withColumns(made(whole)).collect()))
    shuffles = {}
    for size in (1000, 5):
        out = blocks.over_blocks(df, ["s"], "t", made, before=3, after=2, block_rows=size)
        assert out.columns == [*df.columns, "lag", "ahead"] and sorted(map(str, out.collect())) == want
        shuffles[size] = out._jdf.queryExecution().sparkPlan().toString().count("Window")
    assert shuffles[1000] == 1 < shuffles[5]
