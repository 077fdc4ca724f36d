"""Readers, sinks, streaming forms, and the registry of queries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators.splits import split_by_dates
from tidemark.sources import feeds
from tidemark.streaming.minutes import stream_minutes, stream_unique

T0 = datetime(2024, 1, 30)


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(s, T0 + timedelta(days=d), float(d)) for s in "ab" for d in range(40)], "s string, t timestamp, v double").withColumn("yyyymm", F.date_format("t", "yyyyMM"))


def test_partitions_are_pruned_and_kept(spark, table, tmp_path):
    path = str(tmp_path / "t")
    feeds.write_partitions(table, path, order=["s", "t"])
    rows = feeds.read_months(spark, path, "2024-02-01", "2024-02-29")
    assert rows.count() == 58 and "PartitionFilters: [isnotnull" in rows._jdf.queryExecution().toString()
    assert feeds.read_months(spark, path, "2024-02-01", "2024-02-29", 1).count() == 62
    more = table.withColumn("v", F.lit(-1.0)).unionByName(table.limit(1).withColumn("yyyymm", F.lit("209901")))
    assert feeds.write_partitions(more, path).count() == 1
    assert spark.read.parquet(path).where("v = -1").count() == 0
    feeds.write_partitions(more.where("yyyymm = '202402'"), path, force=True)
    back = spark.read.parquet(path)
    assert back.where("v = -1").count() == 58 and back.count() == 81
    assert feeds.only(back, s=["a"], yyyymm=[]).where("s = 'b'").count() == 0
    assert feeds.read_training_years(spark, path, 2024, 2024, [1]).count() == 4
    with pytest.raises(ValueError, match="no rows"):
        feeds.read_training_years(spark, path, 1990, 1991)


def test_positional_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("YYYY header\n 2024  60  1 5  " + " ".join(["9"] * 17) + " bad\n\n2024 1 0 0 1\n")
    rows = feeds.read_positional_text(spark, str(tmp_path / "a.txt")).orderBy("timestamp").collect()
    assert [r.timestamp for r in rows] == [datetime(2024, 1, 1), datetime(2024, 2, 29, 1, 5)]
    assert rows[1].flow_pressure_nPa is None and rows[1].bt_nT == 9 and rows[0].speed_km_s is None and rows[0].source_file == "a.txt"


def test_compaction_takes_the_first_file(spark):
    daily = spark.createDataFrame([("s", T0, 1, "x_20240130_b.nc"), ("s", T0, 2, "x_20240130_a.nc"), ("s", T0, 3, "nothing")], "s string, t timestamp, v int, source_file string")
    assert [(r.v, r.yyyymm) for r in feeds.compact_daily(daily, "s", "t").collect()] == [(2, "202401")]


def test_small_csv_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "s string, p95 double")
    feeds.write_small_csv(df, str(tmp_path / "c"))
    assert feeds.read_small_csv(spark, str(tmp_path / "c"), "s string, p95 double", ["s"]).count() == 2
    with pytest.raises(ValueError, match="p95"):
        feeds.read_small_csv(spark, str(tmp_path / "c"), "s string, p95 double", ["p95"])
    out = spark.createDataFrame([(1, "val", 1, 0.5, 1)], "id int, split string, y_true int, y_prob double, y_pred int")
    feeds.write_predictions(out, str(tmp_path / "p"), "m", "t", ["id"], F.lit(0.4))
    rows, missing = feeds.prediction_registry(spark, str(tmp_path / "p"), ["m", "n"], ["t"], ["val"])
    assert rows.count() == 1 and [r.model for r in missing.collect()] == ["n"]


def test_tasks(spark, table, tmp_path):
    rows = split_by_dates(table, "t", {"train": ("2024-01-01", "2024-02-10"), "test": ("2024-02-11", "2024-03-30")}).withColumn("y", F.when(F.col("v") > 3, 1))
    feeds.write_tasks(rows, str(tmp_path), ["y"], ["s", "t"], ["v"], ["s", "t"])
    back = spark.read.parquet(str(tmp_path / "y"))
    assert {r.split for r in back.select("split").distinct().collect()} == {"train", "test"} and back.count() == 72


def test_streams(spark, tmp_path):
    rows = [("a", T0 + timedelta(seconds=20 * i), float(i)) for i in range(9)] + [("a", T0, 100.0)]
    spark.createDataFrame(rows, "s string, t timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, t timestamp, v double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("minutes", stream_minutes(stream, ["s"], "t", ["v"]), "complete"), ("unique", stream_unique(stream, ["s", "t"], "t"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
    got = {r.t: (r.n_points, r.v) for r in spark.table("minutes").collect()}
    assert got[T0] == (4, 25.75) and got[T0 + timedelta(minutes=1)] == (3, 4.0) and spark.table("unique").count() == 9


def test_registry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60
    assert __spark_entry__.entry(spark).count() > 0
