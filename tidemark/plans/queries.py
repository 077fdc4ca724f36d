"""Queries over the given tables, one or more for each operator, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.derived import derived_columns
from ..operators import asof, blocks, dedupe, labels, metrics, models, neighbours, ranking, resample, sequences, splits
from ..sources import feeds
from . import pipeline, report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table with its times as UTC timestamps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def us(c: str) -> Column:
    return F.unix_micros(F.col(c))


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    df = read(spark, sf_dir, "events")
    return df.where(F.col("event_type") == kind) if kind else df


# ------------------------------------------------------------------------------------------------ as-of joins and fusion

DAY = 86_400_000_000


@query(f"""
SELECT p.event_id, p.user_id, p.value, CASE WHEN epoch_us(p.ts) - epoch_us(c.ts) <= {DAY} THEN c.value END AS click_value,
  CASE WHEN epoch_us(p.ts) - epoch_us(c.ts) <= {DAY} THEN epoch_us(p.ts) - epoch_us(c.ts) END AS age_us,
  coalesce(epoch_us(p.ts) - epoch_us(c.ts) > {DAY}, true) AS click_missing
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts
""")
def asof_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the same user's latest click of the day before."""
    clicks = events(spark, sf_dir, "click").withColumnRenamed("value", "click_value")
    out = asof.asof_join(events(spark, sf_dir, "purchase"), clicks, "ts", "ts", 1440, ["click_value"], ["user_id"], "click")
    return out.select("event_id", "user_id", "value", "click_value", (us("ts") - us("click_timestamp")).alias("age_us"), "click_missing")


def _multi(name: str, tolerance: int) -> str:
    return f"""{name} AS (
  SELECT b.event_id, CASE WHEN epoch_us(b.ts) - epoch_us(s.ts) <= {tolerance * 60_000_000} THEN s.value END AS v,
    coalesce(epoch_us(b.ts) - epoch_us(s.ts) > {tolerance * 60_000_000}, true) AS missing
  FROM b ASOF LEFT JOIN (SELECT ts, value FROM events WHERE event_type = '{name}') s ON b.ts >= s.ts)"""


@query(f"""
WITH b AS (SELECT * FROM events WHERE event_type = 'purchase'), {_multi('click', 10)}, {_multi('view', 10)}, {_multi('error', 30)}
SELECT b.event_id, click.v AS click_value, click.missing AS click_missing, view.v AS view_value, view.missing AS view_missing,
  error.v AS error_value, error.missing AS error_missing
FROM b JOIN click USING (event_id) JOIN view USING (event_id) JOIN error USING (event_id)
""")
def asof_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources of different tolerances in one union and one window."""
    sources = [
        asof.Source(k, events(spark, sf_dir, k).withColumnRenamed("value", f"{k}_value"), "ts", [f"{k}_value"], m) for k, m in (("click", 10), ("view", 10), ("error", 30))
    ]
    out = asof.fuse(events(spark, sf_dir, "purchase"), "ts", sources)
    return out.select("event_id", *[f"{k}_{c}" for k in ("click", "view", "error") for c in ("value", "missing")])


@query(f"""
WITH j AS (
  SELECT p.user_id, epoch_us(p.ts) - epoch_us(c.ts) AS age FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts)
SELECT user_id, count(*) AS purchases, count(CASE WHEN age <= {DAY} THEN 1 END) AS matched,
  round(avg(CASE WHEN age <= {DAY} THEN age / 60000000.0::DOUBLE END), 4) AS mean_age_min
FROM j GROUP BY user_id
""")
def freshness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asof_fuse(spark, sf_dir)
    return rows.groupBy("user_id").agg(
        F.count("*").alias("purchases"), F.count("age_us").alias("matched"), F.round(F.avg(F.col("age_us") / 60000000.0), 4).alias("mean_age_min")
    )


@query("""
WITH r AS (SELECT user_id, date_trunc('minute', ts) AS m, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT c.event_id, r.v AS view_value FROM events c LEFT JOIN r ON c.user_id = r.user_id AND date_trunc('minute', c.ts) = r.m WHERE c.event_type = 'click'
""")
def minute_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = events(spark, sf_dir, "view").groupBy("user_id", F.date_trunc("minute", "ts").alias("ts")).agg(F.max("value").alias("view_value"))
    return resample.left_on_minute(events(spark, sf_dir, "click"), views, ["user_id"], "ts").select("event_id", "view_value")


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity - (p_size + p_retailprice / 100 + p_size * 2 + p_retailprice / 50), 4) AS residual_total,
  round(l_quantity - (p_size + p_retailprice / 100), 4) AS residual_internal FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def residual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("b_north"))
    part = read(spark, sf_dir, "part")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    model = part.select("p_partkey", size.alias("tdep_north"), (price / 100).alias("static_north"), (size * 2).alias("gsm_north"), (price / 50).alias("sm_north"))
    out = resample.attach_residuals(observed, model, ["p_partkey"], ["north"])
    return out.select("l_orderkey", "l_linenumber", F.round("residual_total_north", 4).alias("residual_total"), F.round("residual_internal_north", 4).alias("residual_internal"))


# ------------------------------------------------------------------------------------------------------------- dedupe


@query("""SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.keep_last(events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.keep_first(events(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("""
SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (
  PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END DESC, event_id) = 1""")
def dedupe_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return dedupe.keep_priority(events(spark, sf_dir), ["user_id"], priority, "event_id").select("user_id", "event_type", "event_id")


@query("SELECT (count(*) - count(DISTINCT (user_id, date_trunc('hour', ts))))::BIGINT AS duplicates FROM events")
def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.count_duplicates(events(spark, sf_dir).withColumn("h", F.date_trunc("hour", "ts")), ["user_id", "h"])


# ----------------------------------------------------------------------------------------------- resampling and grids


@query("""
WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, CASE WHEN value > 50 THEN 1 ELSE 0 END AS flag FROM events)
SELECT user_id, epoch_us(date_trunc('minute', ts)) AS minute_us, count(*) AS n_points, round(avg(v), 6) AS v, count(v) AS n_v,
  round(1 - count(v) / count(*)::DOUBLE, 6) AS v_missing_fraction, max(flag) AS flag,
  arg_min(event_type, (ts, event_type)) AS event_type, count(CASE WHEN v IS NOT NULL AND value IS NOT NULL THEN 1 END) AS n_valid
FROM e GROUP BY user_id, date_trunc('minute', ts)
""")
def minute_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumns({"v": F.when(F.col("event_type") != "error", F.col("value")), "flag": (F.col("value") > 50).cast("int")})
    out = resample.resample_minutes(rows, ["user_id"], "ts", means=["v"], maxima=["flag"], firsts=["event_type"], components=["v", "value"])
    return out.select("user_id", us("ts").alias("minute_us"), "n_points", F.round("v", 6).alias("v"), "n_v", F.round("v_missing_fraction", 6).alias("v_missing_fraction"), "flag", "event_type", "n_valid")


@query("""SELECT user_id, round(degrees(atan2(avg(sin(radians(value * 3.6))), avg(cos(radians(value * 3.6))))), 5) AS direction FROM events GROUP BY user_id""")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(C.circular_mean(F.col("value") * 3.6), 5).alias("direction"))


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))


@query("""
WITH h AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS t FROM events),
b AS (SELECT user_id, min(t) AS lo, max(t) AS hi, count(*) AS n FROM h GROUP BY user_id)
SELECT user_id, (date_diff('hour', lo, hi) + 1)::BIGINT AS rows, (date_diff('hour', lo, hi) + 1 - n)::BIGINT AS gaps FROM b
""")
def minute_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gapless hourly grid of every user, counted."""
    grid = resample.minute_grid(_hourly(spark, sf_dir), ["user_id"], "ts", "hour")
    return resample.grid_gaps(grid, ["user_id"], F.col("has_observation"))


@query("""
WITH h AS (SELECT user_id, date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1, 2),
m AS (SELECT user_id, date_trunc('month', t) AS m, count(v) AS n FROM h GROUP BY 1, 2)
SELECT user_id, sum(date_diff('hour', m, m + INTERVAL 1 MONTH))::BIGINT AS rows, sum(date_diff('hour', m, m + INTERVAL 1 MONTH) - n)::BIGINT AS gaps
FROM m GROUP BY user_id
""")
def month_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = resample.month_grid(_hourly(spark, sf_dir), ["user_id"], "ts", "hour")
    return resample.grid_gaps(grid, ["user_id"], F.col("value").isNotNull())


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM e
""")
def fill_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return resample.fill_both_ways(rows, ["user_id"], "ts", "v").select("event_id", "v")


@query("""
SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, count(DISTINCT user_id % 4) AS n_satellites, round(avg(value), 6) AS value,
  bool_or(event_type = 'error') AS any_bad, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS n_high FROM events GROUP BY date_trunc('hour', ts)
""")
def sat_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumns(
        {"hour": F.date_trunc("hour", "ts"), "sat": F.col("user_id") % 4, "bad": F.col("event_type") == "error", "n_high": (F.col("value") > 50).cast("long")}
    )
    out = resample.reduce_satellites(rows, "hour", "sat", ["value"], ["bad"], ["n_high"])
    return out.select(us("hour").alias("hour_us"), "n_satellites", F.round("value", 6).alias("value"), "any_bad", "n_high")


# ----------------------------------------------------------------------------------------------------------- cleaning


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount NOT IN (0.0, 0.1) THEN l_discount END AS l_discount, CASE WHEN l_tax NOT IN (0.08) THEN l_tax END AS l_tax,
  CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS quantity FROM lineitem
""")
def sentinel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.null_sentinels(read(spark, sf_dir, "lineitem"), {"l_discount": [0.0, 0.1], "l_tax": [0.08]})
    return rows.select("l_orderkey", "l_linenumber", "l_discount", "l_tax", C.null_outside("l_quantity", 5, 45).alias("quantity"))


@query("""
WITH l AS (SELECT *, CASE WHEN l_discount != 0.0 THEN l_discount END AS d, CASE WHEN l_tax != 0.0 THEN l_tax END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, d IS NOT NULL AND t IS NOT NULL AS all_valid, d IS NOT NULL OR t IS NOT NULL AS any_valid, coalesce(d <= 0.05, false) AS low,
  coalesce(d IS NOT NULL AND CASE l_returnflag WHEN 'R' THEN l_linenumber IN (0, 1, 2) ELSE l_linenumber IN (0, 1) END, false) AS flag_valid,
  d IS NOT NULL AS has_discount, CASE WHEN d > 0 AND t > 0 THEN t / d END AS ratio, CASE WHEN d IS NOT NULL THEN d ELSE t END AS preferred,
  CASE WHEN d IS NOT NULL THEN 'nez' WHEN t IS NOT NULL THEN 'geo' END AS frame FROM l
""")
def validity_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumns({"d": F.when(F.col("l_discount") != 0.0, F.col("l_discount")), "t": F.when(F.col("l_tax") != 0.0, F.col("l_tax"))})
    d, t = F.col("d"), F.col("t")
    rows = rows.withColumn("marker", F.when(F.col("l_returnflag") == "R", F.lit(1)))
    generation = C.generation(rows, ["marker"])
    return rows.select(
        "l_orderkey", "l_linenumber", C.all_present(["d", "t"]).alias("all_valid"), C.any_present(["d", "t"]).alias("any_valid"), C.at_most(rows, "d", 0.05).alias("low"),
        C.flag_valid(d, F.col("l_linenumber"), generation, {"legacy": [0, 1], "goesr": [0, 1, 2]}).alias("flag_valid"), d.isNotNull().alias("has_discount"),
        C.guarded_ratio(t, d).alias("ratio"), C.prefer(d.isNotNull(), d, t).alias("preferred"), C.preferred_frame(d.isNotNull(), t.isNotNull()).alias("frame"),
    )


@query("""
SELECT event_id, json_extract(props, '$.n')::DOUBLE AS n, ((json_extract(props, '$.n')::DOUBLE % 7) + 0.5)::DOUBLE AS half,
  round_even(((json_extract(props, '$.n')::DOUBLE % 7) + 0.5), 0)::BIGINT AS rounded, NULL::DOUBLE AS absent FROM events
""")
def nested_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", C.nested_number("props", "n").alias("n")).withColumn("half", F.col("n") % 7 + 0.5)
    rows = C.standardise(rows.withColumn("rounded", F.col("half")), counts=["rounded"])
    return C.project_optional(rows, {"event_id": "bigint", "n": "double", "half": "double", "rounded": "bigint", "absent": "double"})


@query("SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings")
def vector_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", *C.vector_columns("embedding", "xyz"))
    return rows.select("vec_id", *[F.col(c).cast("double") for c in "xyz"])


@query("""
SELECT upper(c_mktsegment) AS station, CASE WHEN c_name LIKE 'Customer#0000%' THEN 'low' WHEN c_name LIKE 'Customer#' || '%' THEN 'high' ELSE 'other' END AS family,
  count(*) AS n, round(sum(greatest(least(c_acctbal, 5000), 0)), 2) AS clipped, count(try_cast(right(c_name, 5) AS DOUBLE)) AS numbers, count(try_cast(c_name AS DOUBLE)) AS junk
FROM customer GROUP BY 1, 2
""")
def key_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised keys, families by prefix, clipping and number coercion."""
    rows = C.rename_present(read(spark, sf_dir, "customer"), {"c_mktsegment": "station", "absent": "never"})
    rows = rows.select(
        F.upper("station").alias("station"), C.family(F.col("c_name"), {"Customer#0000": "low", "Customer#": "high"}).alias("family"), C.clip("c_acctbal", 0.0, 5000.0).alias("v"),
        C.to_number(F.right("c_name", F.lit(5))).alias("number"), C.to_number("c_name").alias("text"),
    )
    return rows.groupBy("station", "family").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("clipped"), F.count("number").alias("numbers"), F.count("text").alias("junk"))


@query("""
SELECT 'target_geq_p' || p || '_' || h || 'm' AS target, p / 100.0::DOUBLE AS quantile, h::INT AS minutes, count(*) AS n
FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 95 ELSE 99 END AS p, CASE WHEN event_id % 3 = 0 THEN 30 WHEN event_id % 3 = 1 THEN 60 ELSE 120 END AS h FROM events)
GROUP BY p, h
""")
def target_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("user_id") % 2 == 0, "95").otherwise("99")
    h = F.when(F.col("event_id") % 3 == 0, "30").when(F.col("event_id") % 3 == 1, "60").otherwise("120")
    rows = events(spark, sf_dir).select(F.concat(F.lit("target_geq_p"), p, F.lit("_"), h, F.lit("m")).alias("target"))
    quantile, minutes = C.target_spec(F.col("target"))
    return rows.groupBy("target", quantile.alias("quantile"), minutes.alias("minutes")).agg(F.count("*").alias("n"))


@query("""
SELECT year(ts)::SMALLINT AS year, month(ts)::TINYINT AS month, strftime(ts, '%Y%m') AS yyyymm, count(*) AS n,
  count(CASE WHEN ts BETWEEN TIMESTAMP '2024-01-08' + INTERVAL 1 HOUR AND TIMESTAMP '2024-01-10' OR ts + INTERVAL 2 HOUR BETWEEN TIMESTAMP '2024-01-08' + INTERVAL 1 HOUR AND TIMESTAMP '2024-01-10' OR (ts <= TIMESTAMP '2024-01-08 01:00:00' AND ts + INTERVAL 2 HOUR >= TIMESTAMP '2024-01-10') THEN 1 END) AS meets
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1, 2, 3
""")
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar columns of an inclusive range of days, and spans that meet another."""
    rows = C.calendar(events(spark, sf_dir).where(C.in_days("ts", "2024-01-05", "2024-01-20")), "ts")
    meets = C.overlaps(F.col("ts"), F.col("ts") + F.expr("interval 2 hour"), F.lit("2024-01-08 01:00:00").cast("timestamp"), F.lit("2024-01-10").cast("timestamp"))
    return rows.groupBy("year", "month", "yyyymm").agg(F.count("*").alias("n"), F.count(F.when(meets, 1)).alias("meets"))


@query("""
SELECT event_id, epoch_us(date_trunc('minute', ts)) AS time_us, CASE WHEN event_type != 'error' THEN round(value, 3) END AS v FROM events WHERE event_type != 'signup'
""")
def positional_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as positional text lines and read back; lines without a year are headers."""
    year = F.when(F.col("event_type") == "signup", F.lit("YEAR")).otherwise(F.date_format("ts", "yyyy"))
    value = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.round("value", 3).cast("string"))
    line = F.concat_ws("   ", F.concat(F.lit(" "), year), F.dayofyear("ts"), F.hour("ts"), F.minute("ts"), value)
    rows = feeds.positional_text(events(spark, sf_dir).select("event_id", line.alias("value")), ["year", "doy", "hour", "minute", "v"])
    return rows.select("event_id", us("timestamp").alias("time_us"), "v")


@query("""
WITH d AS (SELECT *, 'feed_' || strftime(ts, '%Y%m%d') || '.txt' AS source_file, date_trunc('hour', ts) AS h FROM events),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id, h ORDER BY source_file, event_id) = 1)
SELECT user_id, strftime(h, '%Y%m') AS yyyymm, count(*) AS n, sum(event_id)::BIGINT AS ids FROM f GROUP BY 1, 2
""")
def compact_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", F.date_trunc("hour", "ts").alias("h"), F.concat(F.lit("feed_"), F.date_format("ts", "yyyyMMdd"), F.lit(".txt")).alias("source_file"))
    return feeds.compact_daily(rows, "user_id", "h").groupBy("user_id", "yyyymm").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""
SELECT key, sum(v) AS v, count(o) AS o, count(p) AS p FROM (
  SELECT c_nationkey AS key, round(c_acctbal) AS v, 1 AS o, NULL AS p FROM customer UNION ALL SELECT s_nationkey, round(s_acctbal), NULL, 1 FROM supplier) GROUP BY key
""")
def union_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.round("c_acctbal").alias("v"), F.lit(1).alias("o"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.round("s_acctbal").alias("v"), F.lit(1).alias("p"))
    return C.union_outer(a, b).groupBy("key").agg(F.sum("v").alias("v"), F.count("o").alias("o"), F.count("p").alias("p"))


@query("SELECT r_name, count(*) AS n, sum(CASE WHEN r_name = 'ASIA' THEN 1 WHEN r_name = 'EUROPE' THEN 2 ELSE 3 END)::BIGINT AS place FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = C.by_custom_order(F.col("r_name"), ["ASIA", "EUROPE"])
    return rows.groupBy("r_name").agg(F.count("*").alias("n"), F.sum(place[0]).cast("long").alias("place")).orderBy(*C.by_custom_order(F.col("r_name"), ["ASIA", "EUROPE"]))


# ------------------------------------------------------------------------------------- windows, thresholds and labels


@query("""
WITH m AS (SELECT event_id, user_id, ts, sqrt(value * value + (value - 50) * (value - 50))::FLOAT AS magnitude FROM events)
SELECT event_id, round(abs(magnitude - lag(magnitude) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts))::DOUBLE, 2) AS abs_change FROM m
""")
def abs_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("east", F.col("value") - 50)
    out = labels.magnitude_and_change(rows, ["user_id"], "ts", "value", "east")
    return out.select("event_id", F.round(F.col("abs_change").cast("double"), 2).alias("abs_change"))


@query("""
SELECT user_id, count(*) AS n_samples, min(value) AS min_value, round(quantile_cont(value, 0.5), 6) AS median_value, max(value) AS max_value,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY user_id
""")
def thresholds_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.group_thresholds(events(spark, sf_dir), ["user_id"], "value", "linear")
    return out.withColumns({c: F.round(c, 6) for c in ("median_value", "p95", "p99")})


NEAREST = """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY user_id) - 1 AS n FROM events),
t AS (SELECT user_id, max(CASE WHEN k = floor(n * 0.95::DOUBLE + 0.5) THEN value END) AS p95, max(CASE WHEN k = floor(n * 0.99::DOUBLE + 0.5) THEN value END) AS p99 FROM r GROUP BY user_id)
"""


@query(f"""{NEAREST}
SELECT user_id, count(*) AS n_samples, min(value) AS min_value, round(quantile_cont(value, 0.5), 6) AS median_value, max(value) AS max_value, any_value(p95) AS p95, any_value(p99) AS p99
FROM events JOIN t USING (user_id) GROUP BY user_id
""")
def thresholds_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.group_thresholds(events(spark, sf_dir), ["user_id"], "value")
    return out.withColumn("median_value", F.round("median_value", 6))


@query("SELECT round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events")
def global_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return rounded(labels.quantile(rows, "value", 0.95, "p95"), ["p95"], 6).crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))


def _ahead(h: int) -> str:
    w = f"OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return ", ".join(f"CASE WHEN count(value) {w} = {h} THEN (max(value) {w} >= {p})::TINYINT END AS target_geq_{p}_{h}m" for p in ("p95", "p99"))


@query(f"""{NEAREST}, l AS (SELECT event_id, {', '.join(_ahead(h) for h in (3, 6, 12))} FROM events JOIN t USING (user_id))
SELECT * FROM l WHERE {' AND '.join(f'target_geq_{p}_{h}m IS NOT NULL' for h in (3, 6, 12) for p in ('p95', 'p99'))}
""")
def forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    rows = labels.attach_thresholds(rows, labels.quantiles_nearest(rows, ["user_id"], "value", [0.95, 0.99]), "user_id", check=False)
    out = labels.forward_labels(rows, ["user_id"], "ts", "value", {"p95": "p95", "p99": "p99"}, [3, 6, 12])
    return out.select("event_id", *[f"target_geq_{p}_{h}m" for h in (3, 6, 12) for p in ("p95", "p99")])


@query("""
SELECT event_id, round(value - lag(value, 10) OVER w, 6) AS diff_10, round(value - lag(value, 15) OVER w, 6) AS diff_15 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
""")
def lag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.lagged_differences(events(spark, sf_dir), ["user_id"], "ts", {"diff_10": ("value", 10), "diff_15": ("value", 15)})
    return out.select("event_id", F.round("diff_10", 6).alias("diff_10"), F.round("diff_15", 6).alias("diff_15"))


@query("""
SELECT event_id, round(list_sum(list(value) OVER w), 5) AS total, len(list(value) OVER w)::INT AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) QUALIFY len(list(value) OVER w) = 8
""")
def lookback_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.lookback_sequences(events(spark, sf_dir), ["user_id"], "ts", ["value"], 8)
    total = F.aggregate("sequence", F.lit(0.0), lambda s, x: s + x["value"])
    return out.select("event_id", F.round(total, 5).alias("total"), F.size("sequence").alias("n"))


@query(f"""
SELECT event_id, round(value, 5) AS last, round(list_avg(list(value) OVER w), 5) AS mean, round(list_max(list(value) OVER w), 5) AS top FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) QUALIFY len(list(value) OVER w) = 24
""")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 24 events, packed by blocks and sliced in the tasks that read them."""
    packed = sequences.packed_sequences(events(spark, sf_dir), ["user_id"], "ts", ["value"], 24, ["event_id"])

    def made(windows, rows):
        values = windows[:, :, 0]
        return rows.assign(last=values[:, -1], mean=values.mean(axis=1), top=values.max(axis=1))

    out = sequences.over_sequences(packed, 1, 24, ["event_id"], made, "event_id long, last double, mean double, top double")
    return rounded(out, ["last", "mean", "top"], 5)


DERIVED = {
    "sun": ["l_extendedprice", "l_quantity"],
    "l1": ["l_discount", "l_tax", "l_quantity", "l_extendedprice", "l_tax"],
    "geo": ["l_discount", "l_tax", "l_quantity", "l_extendedprice"],
    "leo": ["l_quantity", "l_tax", "l_discount", "l_extendedprice", "l_quantity"],
}


@query("""
WITH l AS (
  SELECT *, lag(l_extendedprice, 10) OVER w AS e10, lag(l_quantity, 10) OVER w AS q10, lag(l_quantity, 15) OVER w AS q15, lag(l_extendedprice, 15) OVER w AS e15
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))
SELECT l_orderkey, l_linenumber, round(ln(abs(l_extendedprice) + 1e-12) - ln(abs(l_quantity) + 1e-12), 5) AS sun_log_flux_ratio, round(l_extendedprice - e10, 5) AS sun_xrsb_diff_10m,
  round(l_quantity - q10, 5) AS sun_xrsa_diff_10m, round(l_extendedprice + l_quantity, 5) AS sun_xrs_sum_flux, round(l_extendedprice / (abs(l_quantity) + 1e-12), 4) AS sun_xrs_hardness_proxy,
  round(atan2(l_discount, l_tax), 5) AS l1_clock_angle_rad,
  round(pow(greatest(l_extendedprice, 0), 4.0::DOUBLE / 3) * pow(sqrt(l_discount * l_discount + l_tax * l_tax), 2.0::DOUBLE / 3) * pow(abs(sin(abs(atan2(l_discount, l_tax)) / 2)), 8.0::DOUBLE / 3), 2) AS l1_newell_like,
  round(l_tax * l_extendedprice, 5) AS l1_dynamic_pressure_speed, round(l_quantity / (abs(l_tax) + 1e-12), 0) AS l1_bmag_pressure_ratio, round(l_extendedprice * abs(l_tax), 5) AS l1_electric_field_proxy,
  round(l_quantity - l_extendedprice, 5) AS geo_bz_minus_vdh, round(sqrt(l_discount * l_discount + l_tax * l_tax), 5) AS geo_b_transverse_gsm,
  round(abs(l_quantity) + abs(l_extendedprice), 5) AS geo_b_transverse_vdh_proxy, round(l_quantity - q15, 5) AS geo_bz_gsm_diff_15m, round(l_extendedprice - e15, 5) AS geo_bz_vdh_diff_15m,
  round(l_quantity / (1 + abs(l_extendedprice)), 8) AS leo_fac_cond_proxy, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 5) AS leo_residual_horizontal_mag,
  round(abs(l_discount) / (abs(sqrt(l_quantity * l_quantity + l_tax * l_tax)) + 1e-12), 7) AS leo_residual_vertical_to_horizontal_ratio, round(l_quantity - q10, 5) AS leo_north_diff_10m,
  round(l_quantity / (1 + abs(l_quantity)), 6) AS leo_freshness_weighted_residual
FROM l
""")
def derived_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = {"sun_xrs_hardness_proxy": 4, "l1_newell_like": 2, "l1_bmag_pressure_ratio": 0, "leo_fac_cond_proxy": 8, "leo_residual_vertical_to_horizontal_ratio": 7, "leo_freshness_weighted_residual": 6}
    rows = read(spark, sf_dir, "lineitem")
    made = lambda w: derived_columns(rows.columns, lambda c, k: F.lag(c, k).over(w), DERIVED)
    out = blocks.over_blocks(rows, ["l_suppkey"], "l_shipdate", made, before=15, ties=["l_orderkey", "l_linenumber"])
    made = [c for c in out.columns if c not in rows.columns]
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, places.get(c, 5)).alias(c) for c in made])


# --------------------------------------------------------------------------------------------------------------- splits

YEAR_SPLIT = """
WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), r AS (SELECT y, row_number() OVER (ORDER BY y DESC) AS k, count(*) OVER () AS n FROM y),
m AS (SELECT y, CASE WHEN n >= 3 THEN CASE k WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END WHEN n = 2 AND k = 1 THEN 'test' ELSE 'train' END AS split FROM r),
o AS (SELECT orders.*, split FROM orders JOIN m ON year(o_orderdate) = y)
"""


def _by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_by_years(read(spark, sf_dir, "orders"), "o_orderdate")


@query(f"{YEAR_SPLIT} SELECT split, year(o_orderdate)::INT AS year, count(*) AS n FROM o GROUP BY 1, 2")
def split_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_year(spark, sf_dir).groupBy("split", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN o_orderdate::DATE BETWEEN '1995-01-01' AND '1998-12-31' THEN 'train' WHEN o_orderdate::DATE BETWEEN '1999-01-01' AND '1999-12-31' THEN 'val' ELSE 'test' END AS split,
  count(*) AS n, epoch_us(min(o_orderdate)) AS first_us FROM orders WHERE o_orderdate::DATE BETWEEN '1995-01-01' AND '2000-06-30' GROUP BY 1
""")
def split_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = {"train": ("1995-01-01", "1998-12-31"), "val": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2000-06-30")}
    rows = splits.split_by_dates(read(spark, sf_dir, "orders"), "o_orderdate", ranges)
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.unix_micros(F.min("o_orderdate")).alias("first_us"))


@query(f"""{YEAR_SPLIT}, g AS (SELECT split, count(*) AS n, min(o_orderdate) AS a, max(o_orderdate) AS b FROM o GROUP BY split),
s(place, split) AS (VALUES (0, 'train'), (1, 'val'), (2, 'test'))
SELECT place, s.split, coalesce(n, 0) AS rows, epoch_us(a) AS first_us, epoch_us(b) AS last_us, CASE WHEN coalesce(n, 0) = 0 THEN 'warn'
  WHEN a <= (SELECT max(g2.b) FROM g g2 JOIN s s2 USING (split) WHERE s2.place < s.place) THEN 'fail' ELSE 'pass' END AS status
FROM s LEFT JOIN g USING (split)
""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.split_report(_by_year(spark, sf_dir), "o_orderdate")
    return out.select("place", "split", "rows", us("first").alias("first_us"), us("last").alias("last_us"), "status")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    rows = _by_year(spark, sf_dir)
    return rows.withColumns({"high": F.when(F.col("o_orderstatus") != "P", (price > 200000).cast("byte")), "top": (price > 300000).cast("byte")})


@query(f"""{YEAR_SPLIT}, t AS (
  SELECT 'high' AS target, split, o_custkey, o_orderdate, (o_totalprice > 200000)::INT AS y FROM o WHERE o_orderstatus != 'P' UNION ALL
  SELECT 'top', split, o_custkey, o_orderdate, (o_totalprice > 300000)::INT FROM o),
n AS (SELECT * FROM (VALUES ('high'), ('top')) a(target), (VALUES ('train'), ('val'), ('test')) b(split)),
g AS (SELECT target, split, count(*) AS n, count(DISTINCT o_custkey) AS s, min(o_orderdate) AS a, max(o_orderdate) AS b, round(avg(y), 8) AS r FROM t GROUP BY 1, 2),
k AS (SELECT target, split, y, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY target, split) AS n FROM t WINDOW w AS (PARTITION BY target, split ORDER BY y)),
h AS (SELECT target, split, max(y)::DOUBLE AS h FROM k WHERE k = floor((n - 1) * 0.95::DOUBLE + 0.5) GROUP BY ALL)
SELECT target, split, coalesce(n, 0) AS rows, coalesce(s, 0) AS stations, epoch_us(a) AS first_us, epoch_us(b) AS last_us, r AS event_rate, r AS target_mean, h AS target_p95
FROM n LEFT JOIN h USING (target, split) LEFT JOIN g USING (target, split)
""")
def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.task_summary(_tasks(spark, sf_dir), ["high", "top"], "o_custkey", "o_orderdate")
    return out.select("target", "split", "rows", "stations", us("first").alias("first_us"), us("last").alias("last_us"), *[F.round(c, 8).alias(c) for c in ("event_rate", "target_mean", "target_p95")])


@query("""
SELECT count(*) AS rows, count(DISTINCT o_custkey) AS stations, round(avg((o_totalprice > 200000)::INT) FILTER (o_orderstatus != 'P'), 8) AS high_rate, round(avg((o_totalprice > 300000)::INT), 8) AS top_rate FROM orders
""")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.label_summary(_tasks(spark, sf_dir), ["high", "top"], "o_custkey")
    return out.withColumns({c: F.round(c, 8) for c in ("high_rate", "top_rate")})


@query(f"{YEAR_SPLIT} SELECT split, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM o WHERE o_orderstatus != 'P' GROUP BY split")
def task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tasks(spark, sf_dir)
    found = splits.feature_columns(rows, ["o_orderkey", "o_custkey", "o_orderdate", "split"], ["high", "top"])
    task = splits.task_table(rows, "high", ["o_orderkey", "o_custkey", "o_orderdate"], found)
    return task.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum(found[0]), 2).alias("price"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1000")
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.head_rows(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], 1000).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR || '|42'), o_orderkey LIMIT 1000")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.seeded_sample(read(spark, sf_dir, "orders"), ["o_orderkey"], 1000).select("o_orderkey", "o_totalprice")


# --------------------------------------------------------------------------------------------------------- verification

PREDICTIONS = """
WITH p AS (
  SELECT lang AS station, 'a' AS model, quality AS y_true, (n_chars % 101) / 100.0::DOUBLE AS y_prob, ((n_chars % 101) / 100.0::DOUBLE >= 0.4)::INT AS y_pred FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT lang, 'b', quality, (n_chars % 89) / 88.0::DOUBLE, ((n_chars % 89) / 88.0::DOUBLE >= 0.5)::INT FROM documents JOIN labels USING (doc_id)),
"""
COUNTS = """c AS (
  SELECT model, station, count(*) AS rows, sum(y_true)::BIGINT AS n_positive, sum(((1 - y_true) * (1 - y_pred))::BIGINT)::BIGINT AS tn, sum(((1 - y_true) * y_pred)::BIGINT)::BIGINT AS fp,
    sum((y_true * (1 - y_pred))::BIGINT)::BIGINT AS fn, sum((y_true * y_pred)::BIGINT)::BIGINT AS tp, avg(pow(y_prob - y_true, 2)) AS brier FROM p GROUP BY ALL)"""


def _scores(ratio: str = "round({}, 8)") -> str:
    parts = {
        "precision": "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END",
        "recall": "CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END",
        "f1": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END",
        "f2": "CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp)::DOUBLE ELSE 0 END",
        "balanced_accuracy": "(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END) / ((tp + fn > 0)::INT + (tn + fp > 0)::INT)",
        "event_rate": "(tp + fn) / (tp + fp + fn + tn)::DOUBLE",
        "predicted_rate": "(tp + fp) / (tp + fp + fn + tn)::DOUBLE",
        "hss": "CASE WHEN (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn) != 0 THEN 2 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))::DOUBLE END",
    }
    return ", ".join(f"{ratio.format(v)}::DOUBLE AS \"{k}\"" for k, v in parts.items())


SCORES = ["precision", "recall", "f1", "f2", "balanced_accuracy", "event_rate", "predicted_rate", "hss"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    made = []
    for model, mod, cut in (("a", 101, 0.4), ("b", 89, 0.5)):
        prob = (F.col("n_chars") % mod) / (100.0 if model == "a" else 88.0)
        made.append(docs.select(F.col("lang").alias("station"), F.lit(model).alias("model"), F.col("quality").alias("y_true"), prob.alias("y_prob"), (prob >= cut).cast("int").alias("y_pred")))
    return metrics.normalise_predictions(made[0].unionByName(made[1]))


def rounded(df: DataFrame, names: list[str], places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names if c in df.columns})


KEYS = ["model", "station"]


@query(f"{PREDICTIONS} {COUNTS} SELECT model, station, tn, fp, fn, tp, {_scores()} FROM c")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion_metrics(predictions(spark, sf_dir), KEYS), SCORES)


RANKED = """s AS (SELECT model, station, y_prob, sum(y_true)::DOUBLE AS a, sum(1 - y_true)::DOUBLE AS b FROM p GROUP BY ALL),
k AS (SELECT *, sum(a) OVER w AS tp, sum(b) OVER w AS fp FROM s WINDOW w AS (PARTITION BY model, station ORDER BY y_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (
  SELECT model, station, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN round(sum(a * tp / (tp + fp)) / sum(a), 8) END AS pr_auc,
    CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN round(sum(b * (tp - a / 2)) / (sum(a) * sum(b)), 8) END AS roc_auc FROM k GROUP BY ALL)"""


@query(f"{PREDICTIONS} {RANKED} SELECT * FROM r")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ranking_metrics(predictions(spark, sf_dir), KEYS), ["pr_auc", "roc_auc"])


@query(f"""{PREDICTIONS} q AS (SELECT *, greatest(least(y_prob, 1 - 1e-9), 1e-9) AS z FROM p)
SELECT model, station, round(avg(pow(y_prob - y_true, 2)), 8) AS brier, round(avg(-(y_true * ln(z) + (1 - y_true) * ln(1 - z))), 6) AS log_loss FROM q GROUP BY ALL""")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.calibration_metrics(predictions(spark, sf_dir), KEYS)
    return out.select(*KEYS, F.round("brier", 8).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


SCAN = f"""g AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in metrics.GRID)}]) AS threshold),
c AS (
  SELECT model, station, threshold, count(*) FILTER (y_true = 0 AND y_prob < threshold) AS tn, count(*) FILTER (y_true = 0 AND y_prob >= threshold) AS fp,
    count(*) FILTER (y_true = 1 AND y_prob < threshold) AS fn, count(*) FILTER (y_true = 1 AND y_prob >= threshold) AS tp FROM p, g GROUP BY ALL)"""


@query(f"{PREDICTIONS} {SCAN} SELECT model, station, threshold, tn, fp, fn, tp, {_scores()} FROM c")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.threshold_scan(predictions(spark, sf_dir), KEYS), SCORES)


@query(f"""{PREDICTIONS} {SCAN}, v AS (SELECT model, station, threshold, tn, fp, fn, tp, {_scores('{}')} FROM c)
SELECT model, station, threshold, tp, round(f2, 8) AS f2 FROM v QUALIFY row_number() OVER (PARTITION BY model, station ORDER BY f2 DESC, recall DESC, threshold) = 1""")
def select_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.select_threshold(predictions(spark, sf_dir), KEYS).select(*KEYS, "threshold", "tp", F.round("f2", 8).alias("f2"))


INFERRED = """i AS (
  SELECT model, station, min(y_prob) FILTER (y_pred = 1) AS yes, max(y_prob) FILTER (y_pred = 0) AS no FROM p GROUP BY ALL),
h AS (SELECT model, station, CASE WHEN yes IS NULL THEN 1 WHEN yes < no THEN (yes + no) / 2 ELSE yes END AS threshold FROM i)"""


@query(f"{PREDICTIONS} {INFERRED} SELECT model, station, round(threshold, 8) AS threshold FROM h")
def infer_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.infer_threshold(predictions(spark, sf_dir), KEYS), ["threshold"])


@query(f"""{PREDICTIONS} {COUNTS}, {RANKED}, {INFERRED}
SELECT model, station, rows, n_positive, tn, fp, fn, tp, {_scores()}, round(brier, 8) AS brier, pr_auc, roc_auc, round(threshold, 8) AS threshold
FROM c JOIN r USING (model, station) JOIN h USING (model, station) WHERE rows >= 20 AND n_positive >= 5""")
def group_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.metrics_long(predictions(spark, sf_dir), KEYS, 20, 5), [*SCORES, "brier", "pr_auc", "roc_auc", "threshold"])


@query(f"""{PREDICTIONS} {COUNTS}, v AS (SELECT model, station, {_scores()} FROM c)
SELECT station, max(f2) FILTER (model = 'a') AS f2__a, max(f2) FILTER (model = 'b') AS f2__b, max(hss) FILTER (model = 'a') AS hss__a, max(hss) FILTER (model = 'b') AS hss__b FROM v GROUP BY station""")
def metrics_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pivot_metrics(confusion_metrics(spark, sf_dir), ["station"], ["model"], ["f2", "hss"], [["a"], ["b"]])


@query(f"""{PREDICTIONS} {COUNTS}, v AS (SELECT model, station, {_scores('{}')} FROM c)
SELECT a.station, round(a.f2 - b.f2, 8) AS f2_diff FROM v a JOIN v b ON a.station = b.station AND a.model = 'a' AND b.model = 'b' WHERE a.f2 IS NOT NULL AND b.f2 IS NOT NULL""")
def model_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.model_difference(metrics.confusion_metrics(predictions(spark, sf_dir), KEYS), ["station"], "f2", "a", "b"), ["f2_diff"])


@query(f"""{PREDICTIONS} {COUNTS}, v AS (SELECT model, station, {_scores('{}')} FROM c), m AS (SELECT model, avg(f2) AS m FROM v GROUP BY model)
SELECT model, round(m, 8) AS mean_f2, m = max(m) OVER () AS best FROM m""")
def mean_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted mean over stations, the best model marked."""
    long = metrics.confusion_metrics(predictions(spark, sf_dir), KEYS)
    mean = long.groupBy("model").agg(F.avg("f2").alias("m"))
    best = mean.agg(F.max("m").alias("top"))
    return mean.crossJoin(F.broadcast(best)).select("model", F.round("m", 8).alias("mean_f2"), (F.col("m") == F.col("top")).alias("best"))


def _range_sql(metric: str) -> str:
    base = f"""{PREDICTIONS} {COUNTS}, v AS (SELECT model, station, brier, {_scores('{}')} FROM c),
q AS (SELECT model, quantile_cont({metric}, 0.05) AS lo, quantile_cont({metric}, 0.95) AS hi, min({metric}) AS a, max({metric}) AS b FROM v GROUP BY model)"""
    if metric == "hss":
        return f"{base} SELECT model, round(-greatest(abs(least(lo, 0)), abs(greatest(hi, 0)), 0.05::DOUBLE), 8) AS low, round(greatest(abs(least(lo, 0)), abs(greatest(hi, 0)), 0.05::DOUBLE), 8) AS high FROM q"
    return f"""{base} SELECT model, round(CASE WHEN lo != hi THEN lo WHEN a != b THEN a ELSE greatest(a - 0.01, 0) END, 8) AS low,
  round(CASE WHEN lo != hi THEN hi WHEN a != b THEN b ELSE least(b + 0.01, 1) END, 8) AS high FROM q"""


def _range(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    long = metrics.metrics_long(p, KEYS)
    return rounded(metrics.robust_range(long, metric, metric, ["model"]), ["low", "high"])


@query(_range_sql("hss"))
def robust_range_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _range(spark, sf_dir, "hss")


@query(_range_sql("brier"))
def robust_range_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _range(spark, sf_dir, "brier")


@query("""SELECT round(greatest(coalesce(quantile_cont(abs(value - 50) / 1000, 0.95), 0.05::DOUBLE), 0.05::DOUBLE), 8) AS "limit", count(*) AS n FROM events""")
def difference_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("d", (F.col("value") - 50) / 1000)
    n = rows.agg(F.count("*").alias("n"))
    return rounded(metrics.difference_limit(rows, "d"), ["limit"]).crossJoin(n)


# ---------------------------------------------------------------------------------------------- baselines and importance

LABELLED = f"{YEAR_SPLIT}, l AS (SELECT o_orderkey, split, o_totalprice AS x, o_custkey % 1000 AS z, (o_totalprice > 250000)::INT AS label FROM o)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return _by_year(spark, sf_dir).select("o_orderkey", "split", price.alias("x"), (F.col("o_custkey") % 1000).cast("double").alias("z"), (price > 250000).cast("int").alias("label"))


@query(f"""{LABELLED}, e AS (SELECT avg(label) AS p FROM l WHERE split = 'train'),
g AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in metrics.GRID)}]) AS t),
v AS (SELECT t, count(*) FILTER (label = 1 AND p >= t) AS tp, count(*) FILTER (label = 0 AND p >= t) AS fp, count(*) FILTER (label = 1 AND p < t) AS fn FROM l, e, g WHERE split = 'val' GROUP BY t),
b AS (SELECT t FROM v ORDER BY CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp)::DOUBLE ELSE 0 END DESC, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END DESC, t LIMIT 1)
SELECT split, count(*) AS n, sum(label)::BIGINT AS events, round(any_value(p), 8) AS rate, any_value(t) AS threshold, sum((p >= t)::INT)::BIGINT AS predicted FROM l, e, b WHERE split != 'train' GROUP BY split""")
def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.climatology(labelled(spark, sf_dir), "label")
    return out.groupBy("split").agg(
        F.count("*").alias("n"), F.sum("y_true").alias("events"), F.round(F.max("y_prob"), 8).alias("rate"), F.max("threshold").alias("threshold"), F.sum("y_pred").alias("predicted")
    )


@query(f"""{LABELLED}, s AS (SELECT *, sqrt(x * x + z * z) AS m FROM l), q AS (SELECT quantile_cont(m, 0.95) AS q FROM s WHERE split = 'train')
SELECT split, count(*) AS n, sum((m >= q)::INT)::BIGINT AS predicted, sum((m >= q)::INT * label)::BIGINT AS tp FROM s, q GROUP BY split""")
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.persistence(labelled(spark, sf_dir), "label", "x", "z", 0.95)
    return out.groupBy("split").agg(F.count("*").alias("n"), F.sum("y_pred").alias("predicted"), F.sum(F.col("y_pred") * F.col("y_true")).alias("tp"))


@query(f"""{LABELLED}, f AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE x END AS v FROM l), d AS (SELECT quantile_cont(v, 0.5) AS m FROM f WHERE split = 'train'),
i AS (SELECT split, o_orderkey, coalesce(v, m) AS v FROM f, d), s AS (SELECT avg(v) AS a, stddev_pop(v) AS d FROM i WHERE split = 'train')
SELECT o_orderkey, round((v - a) / d, 6) AS v FROM i, s""")
def impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("v", F.when(F.col("o_orderkey") % 10 != 0, F.col("x")))
    return models.impute_and_scale(rows, ["v"]).select("o_orderkey", F.round("v", 6).alias("v"))


@query(f"""{LABELLED}, c AS (SELECT count(*) AS n, sum(label) AS p FROM l)
SELECT label, count(*) AS n, round(max(CASE WHEN label = 1 THEN n / (2 * p)::DOUBLE ELSE n / (2 * (n - p))::DOUBLE END), 8) AS weight FROM l, c GROUP BY label""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.class_weights(labelled(spark, sf_dir), "label")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("weight"), 8).alias("weight"))


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Labelled documents with a few plain features and a split by id, for the estimators."""
    text = F.col("text")
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))
    measured = read(spark, sf_dir, "documents").select(  # before the join, which then moves numbers and no texts
        "doc_id", F.log1p(F.length(text)).alias("size"), share("[A-Z]").alias("upper"), share("[#$%&*|!]").alias("marks"), share(" ").alias("blank"),
    )
    rows = measured.join(read(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), "size", "upper", "marks", "blank",
        F.when(F.col("doc_id") % 5 < 3, "train").when(F.col("doc_id") % 5 == 3, "val").otherwise("test").alias("split"),
    )
    return rows, ["size", "upper", "marks", "blank"]


def _quality(out: DataFrame) -> DataFrame:
    table = models.metrics_of(out.select("split", "y_true", F.round("y_prob", 4).alias("y_prob"), "y_pred"))
    return table.select("split", "tn", "fp", "fn", "tp", F.round("f2", 4).alias("f2"), F.round("roc_auc", 4).alias("roc_auc"))


@query()
def logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _documents(spark, sf_dir)
    return _quality(models.logistic_grid(rows, features, "label")[2])


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _documents(spark, sf_dir)
    return _quality(models.boosted_trees(rows, features, "label")[2])


@query()
def leafwise_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _documents(spark, sf_dir)
    return _quality(models.leafwise_grid(rows, features, "label")[2])


@query()
def tuned_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _documents(spark, sf_dir)
    return _quality(models.tuned_trees(rows, features, "label")[2])


SPEARMAN = """
WITH r AS (
  SELECT l_returnflag, (rank() OVER x + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0) AS a,
    (rank() OVER y + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0) AS b FROM lineitem
  WINDOW x AS (PARTITION BY l_returnflag ORDER BY l_quantity), y AS (PARTITION BY l_returnflag ORDER BY l_discount))
SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY l_returnflag
"""


@query(SPEARMAN)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.spearman(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount"), ["spearman"], 6)


@query("""
WITH j AS (SELECT l_linestatus, (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT + (l_quantity >= 40)::INT AS b, l_returnflag AS y, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL),
m AS (SELECT l_linestatus, c / sum(c) OVER (PARTITION BY l_linestatus) * ln(c * sum(c) OVER (PARTITION BY l_linestatus) / (sum(c) OVER (PARTITION BY l_linestatus, b) * sum(c) OVER (PARTITION BY l_linestatus, y))) AS m FROM j)
SELECT l_linestatus, round(sum(m), 8) AS mutual_info FROM m GROUP BY l_linestatus
""")
def binned_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.binned_mutual_information(read(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", "l_returnflag", [10, 20, 30, 40]), ["mutual_info"])


SHAPES = """
WITH d AS (SELECT doc_id, quality AS y, n_chars AS size, len(text) - len(replace(text, ' ', '')) AS blanks, n_chars % 97 AS rest FROM documents JOIN labels USING (doc_id)),
s AS (UNPIVOT d ON size, blanks, rest INTO NAME feature VALUE x)
"""


def shapes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Labelled documents with three whole numbers."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    return docs.select("doc_id", F.col("quality").alias("y"), F.col("n_chars").alias("size"), blanks.alias("blanks"), (F.col("n_chars") % 97).alias("rest")), ["size", "blanks", "rest"]


@query(f"""{SHAPES}, n AS (SELECT feature, y, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT s.doc_id, s.feature, s.x, s.y, n.n, least(3, n.n - 1) AS k FROM s JOIN n USING (feature, y) WHERE n.n > 1),
r AS (SELECT a.doc_id, a.feature, a.x, a.n, a.k, list_sort(list(abs(b.x - a.x)))[any_value(a.k)] AS r FROM c a JOIN c b ON a.feature = b.feature AND a.y = b.y AND a.doc_id != b.doc_id GROUP BY a.doc_id, a.feature, a.x, a.n, a.k),
m AS (SELECT r.doc_id, r.feature, any_value(r.n) AS n, any_value(r.k) AS k, count(*) AS m FROM r JOIN c ON c.feature = r.feature AND (abs(c.x - r.x) < r.r OR c.x = r.x) GROUP BY r.doc_id, r.feature),
h AS (SELECT 1::BIGINT AS i, 0.0::DOUBLE AS h UNION ALL SELECT i + 1, sum(1.0 / i) OVER (ORDER BY i) FROM range(1, 200000) t(i))
SELECT m.feature, round(greatest(0, any_value(w.h) + avg(k.h) - avg(n.h) - avg(q.h)), 7) AS mutual_info
FROM m JOIN (SELECT feature, count(*) AS whole FROM m GROUP BY feature) z USING (feature)
JOIN h k ON k.i = m.k JOIN h n ON n.i = m.n JOIN h q ON q.i = m.m JOIN h w ON w.i = z.whole GROUP BY m.feature""")
def neighbour_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = shapes(spark, sf_dir)
    return rounded(neighbours.neighbour_information(ranking.stacked(rows, features, "y"), ["feature"], "x", "y"), ["mutual_info"], 7)


@query(f"""{SHAPES}, r AS (SELECT feature, rank() OVER a + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER b + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM s
  WINDOW a AS (PARTITION BY feature ORDER BY x), b AS (PARTITION BY feature ORDER BY y))
SELECT feature, round(abs(corr(rx, ry)), 7) AS abs_spearman FROM r GROUP BY feature""")
def feature_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = shapes(spark, sf_dir)
    return rounded(ranking.abs_spearman(rows, features, "y"), ["abs_spearman"], 7)


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _documents(spark, sf_dir)
    out = models.feature_importance(rows, features, "label")
    parts = ["mutual_info", "abs_spearman", "split_importance", "gain_share", "importance_score", "event_rate"]
    return rounded(out.select("feature", "train_rows_used", *parts), parts, 6)


IMPORTANCE = """
WITH f AS (SELECT DISTINCT p_brand AS feature FROM part),
s AS (SELECT p_brand AS feature, avg(p_retailprice) AS mutual_info, avg(p_size) AS abs_spearman, count(*)::DOUBLE AS split_importance, CASE WHEN p_brand != 'Brand#11' THEN max(p_retailprice) END AS gain_importance FROM part GROUP BY p_brand),
n AS (SELECT feature, mutual_info / max(mutual_info) OVER () AS a, abs_spearman / max(abs_spearman) OVER () AS b, split_importance / max(split_importance) OVER () AS c, coalesce(gain_importance, 0) / max(gain_importance) OVER () AS d FROM f LEFT JOIN s USING (feature))
SELECT feature, round(0.20 * a + 0.15 * b + 0.20 * c + 0.45 * d, 8) AS importance_score FROM n
"""


@query(IMPORTANCE)
def importance_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumnRenamed("p_brand", "feature")
    by = part.groupBy("feature")
    gain = by.agg(F.max("p_retailprice").alias("gain_importance")).where("feature != 'Brand#11'")
    tables = [by.agg(F.avg("p_retailprice").alias("mutual_info")), by.agg(F.avg("p_size").alias("abs_spearman")), by.agg(F.count("*").cast("double").alias("split_importance")), gain]
    out = ranking.importance_ensemble(tables, part.select("feature").distinct())
    return out.select("feature", F.round("importance_score", 8).alias("importance_score"))


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(
        F.concat_ws("|", "p_type", "p_brand").alias("feature"), F.col("p_brand").alias("family"), "p_retailprice", F.floor(F.col("p_retailprice") / 200).alias("score"), F.col("p_size").alias("gain")
    )
    return ranking.global_ranking(part, "feature", "family", "score", ["gain", "p_retailprice"], "gain")


GLOBAL = """
WITH t AS (SELECT p_type || '|' || p_brand AS feature, p_brand AS family, count(*) AS n_targets, avg(floor(p_retailprice / 200)) AS mean_score, quantile_cont(floor(p_retailprice / 200), 0.5) AS median_score, max(floor(p_retailprice / 200))::BIGINT AS max_score,
  avg(p_size) AS mean_gain, avg(p_retailprice) AS mean_p_retailprice FROM part GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (ORDER BY mean_score DESC, mean_gain DESC, feature) AS rank FROM t)
"""


@query(f"{GLOBAL} SELECT feature, family, n_targets, round(mean_score, 5) AS mean_score, round(median_score, 5) AS median_score, max_score, round(mean_gain, 5) AS mean_gain, round(mean_p_retailprice, 5) AS mean_p_retailprice, rank::INT AS rank FROM k")
def global_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ranking(spark, sf_dir), ["mean_score", "median_score", "mean_gain", "mean_p_retailprice"], 5)


@query(f"{GLOBAL} SELECT family, count(*) AS n_features, round(avg(mean_score), 5) AS mean_score, round(max(mean_score), 5) AS best_score, min(rank)::INT AS best_rank FROM k GROUP BY family")
def family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.family_summary(_ranking(spark, sf_dir), "family"), ["mean_score", "best_score"], 5)


@query(f"""{GLOBAL}, f AS (SELECT feature, family, rank, row_number() OVER (PARTITION BY family ORDER BY rank) AS family_rank FROM k)
SELECT feature, family, rank::INT AS rank, family_rank::INT AS family_rank FROM f WHERE family_rank <= 6 ORDER BY rank LIMIT 24""")
def rank_topk_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_per_family(_ranking(spark, sf_dir), "family", 6, 24).select("feature", "family", "rank", "family_rank")


# -------------------------------------------------------------------------------------------------------------- reports


@query(f"""{YEAR_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT o_custkey) AS stations, (min(o_orderdate)::DATE - DATE '1970-01-01')::INT AS first_day, (max(o_orderdate)::DATE - DATE '1970-01-01')::INT AS last_day,
  round((avg((o_totalprice > 200000)::INT) FILTER (o_orderstatus != 'P') + avg((o_totalprice > 300000)::INT)) / 2, 8) AS mean_rate FROM o GROUP BY split""")
def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.dataset_table(_tasks(spark, sf_dir), "o_custkey", "o_orderdate", {"mean": ["high", "top"]})
    return rounded(out.withColumns({c: F.unix_date(c) for c in ("first_day", "last_day")}), ["mean_rate"])


@query(f"""{PREDICTIONS} {COUNTS}, v AS (SELECT model, station, {_scores()} FROM c),
w AS (SELECT station, max(f2) FILTER (model = 'a') AS a, max(f2) FILTER (model = 'b') AS b FROM v GROUP BY station)
SELECT station, a, b, CASE WHEN a = greatest(a, b) THEN 'a' WHEN b = greatest(a, b) THEN 'b' END AS best FROM w""")
def results_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.results_matrix(confusion_metrics(spark, sf_dir), "station", "model", "f2", ["a", "b"], ["en", "de"])


@query(f"{PREDICTIONS} {COUNTS}, v AS (SELECT model, station, {_scores()} FROM c) SELECT station, \"precision\", recall, f2, hss FROM v WHERE model = 'b'")
def model_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.model_details(confusion_metrics(spark, sf_dir), "b", ["precision", "recall", "f2", "hss"], "station", order=["en"])


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25")
def top_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_rows(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 25)


@query(f"""{NEAREST}, l AS (
  SELECT event_id, strftime(ts, '%Y%m%d') AS day, {', '.join(_ahead(h) for h in (3, 6))} FROM events JOIN t USING (user_id))
SELECT day, count(*) AS n, sum(target_geq_p95_3m)::BIGINT AS p95_3, sum(target_geq_p99_6m)::BIGINT AS p99_6 FROM l
WHERE {' AND '.join(f'target_geq_{p}_{h}m IS NOT NULL' for h in (3, 6) for p in ('p95', 'p99'))} GROUP BY day
""")
def labels_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of whole histories, counted by the day that a later run would add."""
    rows = events(spark, sf_dir)
    rows = labels.attach_thresholds(rows, labels.quantiles_nearest(rows, ["user_id"], "value", [0.95, 0.99]), "user_id", check=False)
    out = labels.forward_labels(rows, ["user_id"], "ts", "value", {"p95": "p95", "p99": "p99"}, [3, 6])
    return out.groupBy(F.date_format("ts", "yyyyMMdd").alias("day")).agg(
        F.count("*").alias("n"), F.sum("target_geq_p95_3m").alias("p95_3"), F.sum("target_geq_p99_6m").alias("p99_6")
    )


@query(f"""
WITH m AS (SELECT user_id, event_id, ts, sqrt(value * value + 1)::FLOAT AS magnitude FROM events WHERE event_type = 'purchase'),
d AS (SELECT *, abs(magnitude - lag(magnitude) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts)) AS c FROM m)
SELECT d.event_id, round(d.c::DOUBLE, 2) AS abs_change, CASE WHEN epoch_us(d.ts) - epoch_us(s.ts) <= {DAY // 24} THEN s.value END AS click_value,
  coalesce(epoch_us(d.ts) - epoch_us(s.ts) > {DAY // 24}, true) AS click_missing
FROM d ASOF LEFT JOIN (SELECT ts, value FROM events WHERE event_type = 'click') s ON d.ts >= s.ts
""")
def fusion_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fusion stage as a whole: deduplicated stations, change, an attached source, calendar columns."""
    base = events(spark, sf_dir, "purchase").select(F.col("user_id").cast("string").alias("station"), "event_id", "ts", "value", F.lit(1.0).alias("east"))
    clicks = events(spark, sf_dir, "click").withColumnRenamed("value", "click_value")
    out = pipeline.fuse_station_minutes(base, "station", "ts", "value", "east", [asof.Source("click", clicks, "ts", ["click_value"], 60)])
    return out.select("event_id", F.round(F.col("abs_change").cast("double"), 2).alias("abs_change"), "click_value", "click_missing")
