"""Queries of sources and sinks, coercions and stage summaries, in the registry of ``queries``.

What a source or a sink does is shown by a round trip: a given table is written to a scratch table in the shared folder and
read back by the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import labels, metrics, ranking, splits
from ..operators import thresholds as T
from ..sources import feeds
from ..sources.shared import materialise, new_path
from . import pipeline, renewal
from .queries import NEAREST, PREDICTIONS, SQL, YEAR_SPLIT, _ahead, _by_year, _tasks, events, predictions, query, read, rounded, us

def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return new_path(spark, name)


# ------------------------------------------------------------------------------------------------------ sources and sinks


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.calendar(read(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "yyyymm")


def _months(spark: SparkSession, sf_dir: str) -> str:
    """Orders as a table partitioned by month."""
    path = scratch(spark, "months")
    feeds.write_partitions(_orders(spark, sf_dir), path, order=["o_orderkey"])
    return path


def _by_month(rows: DataFrame) -> DataFrame:
    month = F.col("yyyymm").cast("string").alias("yyyymm")
    return rows.groupBy(month).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


MONTHS = "SELECT strftime(o_orderdate, '%Y%m') AS yyyymm, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders"


@query(f"{MONTHS} WHERE strftime(o_orderdate, '%Y%m') BETWEEN '199602' AND '199605' GROUP BY 1")
def month_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 March to 20 May 1996 with a month of lookback."""
    return _by_month(feeds.read_months(spark, _months(spark, sf_dir), "1996-03-10", "1996-05-20", 1))


@query(f"{MONTHS} WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_month(feeds.only(_orders(spark, sf_dir), o_orderstatus=["O", "P"], o_orderpriority=[]))


@query(f"{MONTHS} WHERE year(o_orderdate) IN (1996, 1997) AND month(o_orderdate) <= 3 GROUP BY 1")
def training_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_month(feeds.read_training_years(spark, _months(spark, sf_dir), 1996, 1997, [1, 2, 3]))


@query("""SELECT 'orders' AS source_type, year(o_orderdate)::INT AS source_year, count(*) AS n, true AS named FROM orders GROUP BY 2""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in folders by year, read back with what their paths say."""
    root, rows = scratch(spark, "years"), _orders(spark, sf_dir)
    years = [r[0] for r in rows.select(F.substring("yyyymm", 1, 4)).distinct().collect()]
    for year in years:
        rows.where(F.col("yyyymm").startswith(year)).write.parquet(f"{root}/{year}/daily")
    read_back = feeds.with_provenance(spark.read.parquet(*[f"{root}/{year}/daily" for year in years]), "orders")
    return read_back.groupBy("source_type", "source_year").agg(F.count("*").alias("n"), F.min(F.col("source_file").endswith(".parquet")).alias("named"))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y%m') AS yyyymm, o_totalprice AS p FROM orders)
SELECT yyyymm, count(*) AS n, round(sum(CASE WHEN right(yyyymm, 2) = '03' THEN 0 WHEN right(yyyymm, 2) = '02' THEN p + 1 ELSE p END), 2) AS price FROM o GROUP BY 1""")
def partition_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months but March are written; then zeros for all, of which only March is new and taken; then February again, forced."""
    path, rows = scratch(spark, "sink"), _orders(spark, sf_dir)
    month = F.substring("yyyymm", 5, 2)
    feeds.write_partitions(rows.where(month != "03"), path)
    feeds.write_partitions(rows.withColumn("o_totalprice", F.lit(0.0)), path)
    feeds.write_partitions(rows.where(month == "02").withColumn("o_totalprice", F.col("o_totalprice") + 1), path, force=True)
    return _by_month(spark.read.parquet(path))


@query("""SELECT user_id::VARCHAR AS station, count(*) AS n, max(value) AS high FROM events GROUP BY 1""")
def small_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    feeds.write_small_csv(events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("station")).agg(F.count("*").alias("n"), F.max("value").alias("high")), path)
    return feeds.read_small_csv(spark, path, "station string, n bigint, high double", ["station", "n"])


@query(f"""{PREDICTIONS} f AS (SELECT model, CASE WHEN station = 'en' THEN 'train' ELSE 'test' END AS split, count(*) AS n, round(sum(y_prob), 6) AS prob, sum(y_pred)::BIGINT AS predicted FROM p GROUP BY ALL),
e AS (SELECT * FROM (VALUES ('a'), ('b'), ('c')) m(model), (VALUES ('train'), ('val'), ('test')) s(split))
SELECT model, split, coalesce(n, 0) AS n, coalesce(prob, 0) AS prob, coalesce(predicted, 0) AS predicted, n IS NULL AS missing FROM e LEFT JOIN f USING (model, split)""")
def prediction_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction tables of two models written and found again; what was expected and is not there is listed."""
    path = scratch(spark, "predictions")
    rows = predictions(spark, sf_dir).withColumn("split", F.when(F.col("station") == "en", "train").otherwise("test"))
    for model, cut in (("a", 0.4), ("b", 0.5)):
        feeds.write_predictions(rows.where(F.col("model") == model).drop("model"), path, model, "quality", ["station"], F.lit(cut))
    found, missing = feeds.prediction_registry(spark, path, ["a", "b", "c"], ["quality"], ["train", "val", "test"])
    out = found.groupBy("model", "split").agg(F.count("*").alias("n"), F.round(F.sum("y_prob"), 6).alias("prob"), F.sum("y_pred").alias("predicted"))
    none = missing.select("model", "split", F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("prob"), F.lit(0).cast("bigint").alias("predicted"), F.lit(True).alias("missing"))
    return out.withColumn("missing", F.lit(False)).unionByName(none)


# ------------------------------------------------------------------------------------------------ coercion and projection


@query("""SELECT event_id, epoch_us(ts) AS text_us, epoch_us(date_trunc('second', ts)) AS epoch_us, epoch_us(ts) AS time_us FROM events WHERE event_id % 7 != 0""")
def time_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from text, epoch seconds and timestamps; rows of bad text go."""
    text = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows = events(spark, sf_dir).select("event_id", "ts", text.alias("text"), F.unix_seconds("ts").cast("string").alias("epoch"))
    made = rows.select("event_id", C.to_time("text").alias("a"), C.to_time("epoch", "epoch").alias("b"), C.to_time("ts").alias("c")).dropna(subset=["a"])
    return made.select("event_id", us("a").alias("text_us"), us("b").alias("epoch_us"), us("c").alias("time_us"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment) AS station, c_nationkey::BIGINT AS quality_summary, NULL::BIGINT AS absent FROM customer""")
def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several columns that is there and holds a value."""
    rows = read(spark, sf_dir, "customer").withColumns({"iaga": F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), "quality": F.col("c_nationkey").cast("string")})
    return rows.select(
        "c_custkey", C.first_present(rows, ["tval", "iaga", "c_mktsegment"]).alias("station"), C.first_present(rows, ["b_quality", "quality"], "bigint").alias("quality_summary"),
        C.first_present(rows, ["b_quality"], "bigint").alias("absent"),
    )


@query("""SELECT CASE WHEN event_type = 'click' THEN 'goesr' ELSE 'legacy' END AS generation, 'legacy' AS unmarked, count(*) AS n FROM events GROUP BY 1, 2""")
def generation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("marker", F.when(F.col("event_type") == "click", F.lit(1)))
    return rows.select(C.generation(rows, ["marker", "absent"]).alias("generation"), C.generation(rows, ["absent"]).alias("unmarked")).groupBy("generation", "unmarked").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size, NULL::INT AS guarded FROM part")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without any value go, but for guarded ones; then those of a list or a suffix."""
    nothing = F.lit(None).cast("int")
    rows = read(spark, sf_dir, "part").withColumns({"empty": nothing, "guarded": nothing, "x_nez_nt": F.col("p_size"), "y_geo_nt": F.col("p_size")})
    return C.drop_named(C.drop_all_null(rows, ["guarded"]), ["p_name", "p_brand", "p_type", "p_retailprice"], ["_nez_nt", "_geo_nt"])


@query("SELECT l_orderkey, l_linenumber, -l_discount AS north, l_quantity AS east, -l_tax AS centre FROM lineitem")
def nec_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *C.to_nec(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")))


@query("""SELECT o_orderkey, o_totalprice::DECIMAL(14, 2)::DOUBLE AS price FROM orders UNION ALL SELECT l_orderkey, l_quantity::DECIMAL(14, 2)::DOUBLE FROM lineitem""")
def union_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same columns in another order and of other types, under the first frame's types."""
    first = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    second = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("price"), F.col("l_orderkey").cast("string").alias("o_orderkey"))
    return C.union_strict(first, second).withColumn("price", F.col("price").cast("double"))


@query("""SELECT name, value::INT AS value FROM (SELECT DISTINCT 'quality' AS name, quality AS value FROM labels UNION ALL SELECT DISTINCT 'toxic', toxic FROM labels) WHERE value IS NOT NULL""")
def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct labels of two columns that must be binary."""
    rows = read(spark, sf_dir, "labels")
    return spark.createDataFrame([(c, int(v)) for c in ("quality", "toxic") for v in metrics.check_binary(rows, c)], "name string, value int")


# -------------------------------------------------------------------------------------------------- summaries and stages


@query(f"""{YEAR_SPLIT} SELECT o_orderstatus AS station, split, count(*) AS rows, round(avg((o_totalprice > 300000)::INT), 8) AS event_rate,
  round(avg(o_totalprice), 4) AS source_mean, round(stddev_samp(o_totalprice), 4) AS source_std FROM o GROUP BY ALL""")
def station_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.station_summary(_tasks(spark, sf_dir).withColumnRenamed("o_orderstatus", "station"), "station", "top", "o_totalprice")
    return rounded(rounded(out, ["event_rate"]), ["source_mean", "source_std"], 4)


@query("""
SELECT event_id, round(value - lag(value, 10) OVER w, 6) AS diff_10, round(value - lag(value, 15) OVER w, 6) AS diff_15 FROM events
WINDOW w AS (PARTITION BY user_id % 10, date_trunc('week', ts) ORDER BY ts, event_id)
""")
def lag_diff_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags that start anew with each period (weeks here, as the events are of one month)."""
    rows = events(spark, sf_dir).withColumn("station", F.col("user_id") % 10)
    out = labels.lagged_differences(rows, ["station"], "ts", {"diff_10": ("value", 10), "diff_15": ("value", 15)}, "week", ["event_id"])
    return rounded(out.select("event_id", "diff_10", "diff_15"), ["diff_10", "diff_15"], 6)


@query(f"""{NEAREST}, l AS (SELECT event_id, user_id, ts, value, (event_id % 97)::DOUBLE + 1 AS b, {', '.join(_ahead(h) for h in (3, 6))} FROM events JOIN t USING (user_id)),
k AS (SELECT * FROM l WHERE {' AND '.join(f'target_geq_{p}_{h}m IS NOT NULL' for h in (3, 6) for p in ('p95', 'p99'))})
SELECT event_id, target_geq_p95_3m, target_geq_p99_6m, round(b / (abs(value) + 1e-12), 6) AS sun_xrs_hardness_proxy, b + value AS sun_xrs_sum_flux,
  b - lag(b, 10) OVER w AS sun_xrsb_diff_10m, round(value - lag(value, 10) OVER w, 6) AS sun_xrsa_diff_10m
FROM k WINDOW w AS (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts)""")
def label_and_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelling stage as a whole: frozen thresholds, labels, and features whose lags start anew each month."""
    rows = events(spark, sf_dir).withColumn("b", (F.col("event_id") % 97).cast("double") + 1)
    out = pipeline.label_and_derive(rows, "user_id", "ts", "value", rows, (3, 6), {"sun": ["b", "value"]})
    kept = ["event_id", "target_geq_p95_3m", "target_geq_p99_6m", "sun_xrs_hardness_proxy", "sun_xrs_sum_flux", "sun_xrsb_diff_10m", "sun_xrsa_diff_10m"]
    return rounded(out.select(*kept), ["sun_xrs_hardness_proxy", "sun_xrsa_diff_10m"], 6)


def _edges(c: str) -> str:
    return ", ".join(f"quantile_cont({c}, {k / 10})" for k in range(1, 10))


@query(f"""{YEAR_SPLIT}, a AS (SELECT 'price' AS feature, o_totalprice AS v, (o_orderstatus = 'F')::INT AS y, split FROM o WHERE o_orderkey % 11 != 0
  UNION ALL SELECT 'customer', (o_custkey % 50)::DOUBLE, (o_orderstatus = 'F')::INT, split FROM o),
f AS (SELECT * FROM a WHERE split = 'train'),
q AS (SELECT feature, list_distinct([{_edges('v')}]) AS e FROM f GROUP BY feature),
j AS (SELECT feature, len(list_filter(e, lambda x: v >= x)) AS b, y, count(*)::DOUBLE AS c FROM f JOIN q USING (feature) GROUP BY ALL),
w AS (SELECT feature, c / sum(c) OVER (PARTITION BY feature) * ln(c * sum(c) OVER (PARTITION BY feature) / (sum(c) OVER (PARTITION BY feature, b) * sum(c) OVER (PARTITION BY feature, y))) AS m FROM j)
SELECT feature, round(sum(m), 8) AS mutual_info FROM w GROUP BY feature""")
def quantile_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information in ten quantile bins that are fitted on the training rows."""
    rows = _by_year(spark, sf_dir).select(
        "split", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("price"), (F.col("o_custkey") % 50).cast("double").alias("customer"), (F.col("o_orderstatus") == "F").cast("int").alias("y")
    )
    return rounded(ranking.quantile_mutual_information(rows, ["price", "customer"], "y"), ["mutual_info"])


# ----------------------------------------------------------------------------------------------- kept up to date by partitions


YEARS = """
WITH o AS (SELECT y.years, o_orderpriority, o_totalprice AS v FROM orders, (VALUES ('all', 0, 9999), ('1996-1998', 1996, 1998)) y(years, a, b) WHERE year(o_orderdate) BETWEEN a AND b),
r AS (SELECT *, row_number() OVER (PARTITION BY years, o_orderpriority ORDER BY v) AS i, count(*) OVER (PARTITION BY years, o_orderpriority) AS n FROM o)
SELECT years, o_orderpriority, max(n) AS n_samples, min(v) AS min_value, max(v) AS max_value, round(quantile_cont(v, 0.5), 6) AS median_value,
  max(v) FILTER (WHERE i = floor((n - 1) * 0.95 + 0.5) + 1) AS p95, max(v) FILTER (WHERE i = floor((n - 1) * 0.99 + 0.5) + 1) AS p99
FROM r GROUP BY years, o_orderpriority
"""


@query(YEARS)
def stored_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds over all years and over three of them from counts stored by year."""
    path = scratch(spark, "counts")
    orders = read(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    T.store_counts(T.value_counts(orders, ["o_orderpriority"], "o_totalprice", "year"), path, "year")
    sets = {"all": None, "1996-1998": F.col("year").between(1996, 1998)}
    parts = [T.stored_thresholds(spark, path, ["o_orderpriority"], years).withColumn("years", F.lit(name)) for name, years in sets.items()]
    return parts[0].unionByName(parts[1]).withColumn("median_value", F.round("median_value", 6))


@query("""
WITH m AS (SELECT *, md5(o_orderkey || '|42') AS m FROM orders), s AS (SELECT o_orderpriority, count(*) AS c FROM orders GROUP BY 1), t AS (SELECT count(*) AS n FROM orders),
q AS (SELECT o_orderpriority, c, c * 1000 // n AS base, row_number() OVER (ORDER BY c * 1000 % n DESC, o_orderpriority) AS i, least(1000, n) - sum(c * 1000 // n) OVER () AS spare, n FROM s, t),
k AS (SELECT o_orderpriority, CASE WHEN n <= 1000 THEN c ELSE base + (i <= spare)::INT END AS quota FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m, o_orderkey) AS i FROM m)
SELECT o_orderkey, r.o_orderpriority, o_totalprice FROM r JOIN k USING (o_orderpriority) WHERE i <= quota
""")
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand orders, shared by priority."""
    return splits.stratified_cap(read(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"], 1000).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(SQL["labels_by_day"])
def renewed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by day, first made without the last two days and without each user's late rows, then renewed with them."""
    path, made = scratch(spark, "days"), scratch(spark, "labels")
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts", "value", F.date_format("ts", "yyyyMMdd").alias("day"))
    frozen = materialise(labels.quantiles_nearest(rows, ["user_id"], "value", [0.95, 0.99]), "thresholds")
    late = (F.col("day") >= "20240129") | ((F.col("day") == "20240110") & (F.hour("ts") == 7))
    feeds.write_partitions(rows.where(~late), path, ["day"])
    first = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    none = renewal.fingerprints(first.limit(0), "user_id", "day")
    known = materialise(renewal.fingerprints(first, "user_id", "day"), "fingerprints")
    renewal.renew_labels(first, none, made, "user_id", "ts", "value", "day", frozen, [3, 6], now=known)
    feeds.write_partitions(rows, path, ["day"], force=True)
    spark.catalog.refreshByPath(path)
    again = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    renewal.renew_labels(again, known, made, "user_id", "ts", "value", "day", frozen, [3, 6])
    spark.catalog.refreshByPath(made)
    out = spark.read.parquet(made)
    return out.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("target_geq_p95_3m").alias("p95_3"), F.sum("target_geq_p99_6m").alias("p99_6"))
