"""Readers and writers of feeds and stage tables: partitioned Parquet, positional text, small CSV, compaction, registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day_of_year_time, fresh
from ..operators.dedupe import keep_first

#: Columns of the positional L1 text feed, in order.
L1_COLUMNS = (
    "year doy hour minute imf_spacecraft_id plasma_spacecraft_id n_points_imf_avg n_points_plasma_avg percent_interpolation "
    "timeshift_sec time_between_obs_sec bt_nT bx_gse_gsm_nT by_gsm_nT bz_gsm_nT speed_km_s vx_gse_km_s vy_gse_km_s vz_gse_km_s "
    "proton_density_n_cc proton_temperature_K flow_pressure_nPa"
).split()


def read_months(spark: SparkSession, root: str, start: str, end: str, lookback_months: int = 0) -> DataFrame:
    """A table partitioned by ``yyyymm``: only the partitions of [start, end] (and as many months before) are read."""
    first = F.date_format(F.add_months(F.lit(start).cast("date"), -lookback_months), "yyyyMM")
    last = F.date_format(F.lit(end).cast("date"), "yyyyMM")
    return spark.read.parquet(root).where(F.col("yyyymm").cast("string").between(first, last))


def only(df: DataFrame, **wanted: Sequence) -> DataFrame:
    """Rows whose columns hold one of the listed values; an empty or None list asks for all."""
    for column, values in wanted.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def read_training_years(spark: SparkSession, root: str, first: int, last: int, months: Sequence[int] = ()) -> DataFrame:
    """Partitions of whole years (optionally of some months); raises if there is no row."""
    year, month = F.substring(F.col("yyyymm").cast("string"), 1, 4).cast("int"), F.substring(F.col("yyyymm").cast("string"), 5, 2).cast("int")
    rows = spark.read.parquet(root).where(year.between(first, last))
    rows = rows.where(month.isin(*months)) if months else rows
    if rows.isEmpty():
        raise ValueError(f"no rows of {first} to {last} in {root}")
    return rows


def positional_text(lines: DataFrame, columns: Sequence[str] = L1_COLUMNS, line: str = "value") -> DataFrame:
    """Whitespace-separated columns of text rows that start with a four-digit year, as numbers (null where they are none),
    with a timestamp from year, day of the year, hour and minute."""
    (parts,) = fresh([*lines.columns, *columns], "parts")
    rows = lines.withColumn(parts, F.split(F.trim(F.col(line)), r"\s+")).where(F.get(parts, F.lit(0)).rlike(r"^\d{4}$"))
    rows = rows.select(*[c for c in lines.columns if c != line], *[F.get(parts, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(columns)])
    time = day_of_year_time(F.col("year"), F.col("doy"), F.col("hour"), F.col("minute"))
    return rows.withColumn("timestamp", time)


def read_positional_text(spark: SparkSession, path: str, columns: Sequence[str] = L1_COLUMNS) -> DataFrame:
    """``positional_text`` of files, with the name of the file each row came from."""
    return positional_text(spark.read.text(path).withColumn("source_file", F.col("_metadata.file_name")), columns)


def with_provenance(df: DataFrame, kind: str) -> DataFrame:
    """File name, type of source and the year found in the file's path, of a frame read from files."""
    path = F.col("_metadata.file_path")
    year = F.nullif(F.regexp_extract(path, r"/(\d{4})/", 1), F.lit("")).cast("int")
    return df.withColumns({"source_file": F.col("_metadata.file_name"), "source_type": F.lit(kind), "source_year": year})


def compact_daily(daily: DataFrame, entity: str, time: str, file_name: str = "source_file", keep_days: bool = False) -> DataFrame:
    """Daily files as months: the day is read from the file's name (yyyymmdd), rows of one entity and time count once (the
    first by file name), and ``yyyymm`` (or ``yyyymmdd``) is added for the partitioned sink."""
    day = F.regexp_extract(F.col(file_name), r"(\d{8})", 1)
    rows = daily.where(day != "").withColumn("yyyymmdd" if keep_days else "yyyymm", day if keep_days else F.substring(day, 1, 6))
    return keep_first(rows, [entity, time], [file_name])


def write_partitions(df: DataFrame, path: str, by: Sequence[str] = ("yyyymm",), force: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Write a table by partitions and return what was written: those already there are left as they are unless forced, and
    forcing replaces only those that the new rows touch. Rows are dealt by partition and a hash of the row, so that a large
    partition has many writers."""
    spark = df.sparkSession
    rows = df
    if not force:
        try:
            there = spark.read.parquet(path).select(*[F.col(c).cast("string").alias(c) for c in by]).distinct()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        else:
            new = df.select(*by).distinct().alias("n").join(there.alias("t"), [F.col(f"n.{c}").cast("string") == F.col(f"t.{c}") for c in by], "left_anti")
            rows = df.join(new.select(*[F.col(f"n.{c}") for c in by]), list(by), "left_semi")
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(16))
    dealt = rows.repartition(*by, salt).sortWithinPartitions(*by, *order)
    dealt.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)
    return rows


def drop_partitions(spark: SparkSession, path: str, by: str, values: Sequence[str]) -> None:
    """Delete partitions of a table that no row is left for, which overwriting by partitions does not touch."""
    for value in values:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_small_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """A small table with a declared schema; nulls in a required column raise."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    if required:
        bad = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in required]).first()
        if any(bad[c] for c in required):
            raise ValueError(f"nulls in {[c for c in required if bad[c]]} of {path}")
    return df


def write_small_csv(df: DataFrame, path: str) -> None:
    """One file, for tables of a row per group."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def prediction_registry(spark: SparkSession, path: str, models: Sequence[str], targets: Sequence[str], splits: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(predictions, missing)``: rows of the expected model, target and split partitions, and the combinations without."""
    rows = spark.read.parquet(path).where(F.col("model").isin(*models) & F.col("target").isin(*targets) & F.col("split").isin(*splits))
    expected = spark.createDataFrame([(m, t, s) for m in models for t in targets for s in splits], "model string, target string, split string")
    return rows, expected.join(rows.select("model", "target", "split").distinct(), ["model", "target", "split"], "left_anti")


def write_predictions(df: DataFrame, path: str, model: str, target: str, ids: Sequence[str], threshold: Column) -> None:
    """Ids, y_true, y_prob, y_pred and threshold under ``model=/target=/split=``."""
    rows = df.select(*ids, "split", "y_true", "y_prob", "y_pred", threshold.alias("threshold"), F.lit(model).alias("model"), F.lit(target).alias("target"))
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("model", "target", "split").parquet(path)


def write_tasks(df: DataFrame, root: str, targets: Sequence[str], metadata: Sequence[str], features: Sequence[str], order: Sequence[str]) -> None:
    """One table per target, partitioned by split, sorted within its files; rows without the target are left out."""
    for target in targets:
        rows = df.where(F.col(target).isNotNull()).select(*metadata, *features, target, "split")
        rows.repartitionByRange("split", *order).sortWithinPartitions("split", *order).write.mode("overwrite").partitionBy("split").parquet(f"{root}/{target}")
