"""The stages chained: fuse sources, label and derive, split into tasks, verify predictions. Each is one lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import calendar, fresh
from ..functions.derived import derived_columns
from ..operators import blocks, labels, metrics, splits
from ..operators.asof import Source, fuse
from ..operators.dedupe import keep_last


def fuse_station_minutes(base: DataFrame, station: str, time: str, north: str, east: str, sources: Sequence[Source]) -> DataFrame:
    """Deduplicated base rows with magnitude and change, all sources attached, and calendar columns."""
    rows = base.withColumn(station, F.upper(F.col(station))).where(F.col(time).isNotNull())
    rows = labels.magnitude_and_change(keep_last(rows, [station, time]), [station], time, north, east)
    return calendar(fuse(rows, time, sources), time)


def label_and_derive(fused: DataFrame, station: str, time: str, value: str, training: DataFrame, horizons: Sequence[int] = (30, 60, 120), inputs: dict | None = None) -> DataFrame:
    """Thresholds frozen on the training rows, forward labels, and the derived families that the columns allow; the lags of
    these start anew each month, over the rows that kept their labels."""
    frozen = labels.group_thresholds(training, [station], value)
    rows = labels.attach_thresholds(fused, frozen, station)
    rows = labels.forward_labels(rows, [station], time, value, {"p95": "p95", "p99": "p99"}, horizons)
    (month,) = fresh(rows.columns, "month")
    rows = rows.drop("p95", "p99").withColumn(month, F.date_trunc("month", F.col(time)))
    made = lambda w: derived_columns(rows.columns, lambda c, k: F.lag(c, k).over(w), inputs)
    return blocks.over_blocks(rows, [station, month], time, made, before=15).drop(month)


def tasks(labelled: DataFrame, time: str, metadata: Sequence[str], targets: Sequence[str], ranges: dict | None = None) -> dict[str, DataFrame]:
    """Task tables by target, on checked chronological splits (by dates if given, else by year)."""
    rows = splits.split_by_dates(labelled, time, ranges) if ranges else splits.split_by_years(labelled, time)
    splits.check_splits(rows, time)
    features = splits.feature_columns(rows, metadata, targets)
    return {t: splits.task_table(rows, t, metadata, features) for t in targets}


def verify(predictions: DataFrame, keys: Sequence[str] = ("model", "target", "split", "station"), min_rows: int = 0, min_positives: int = 0) -> DataFrame:
    """The long metric table of a prediction table."""
    return metrics.metrics_long(metrics.normalise_predictions(predictions), keys, min_rows, min_positives)


def label_new_month(rows: DataFrame, month: str, station: str, time: str, value: str, thresholds: DataFrame, horizons: Sequence[int] = (30, 60, 120)) -> DataFrame:
    """Labels of one ``yyyymm`` of a table partitioned by it, for incremental runs: only that month and as many rows of the
    next as windows reach are read, and only the month's rows are returned."""
    first = F.to_timestamp(F.lit(month), "yyyyMM")
    after = F.add_months(first, 1).cast("timestamp")
    reach = F.date_format(after, "yyyyMM")
    near = rows.where(F.col("yyyymm").cast("string").isin(month) | ((F.col("yyyymm").cast("string") == reach) & (F.col(time) < after + F.make_dt_interval(mins=F.lit(max(horizons))))))
    near = labels.attach_thresholds(near, thresholds, station)
    return labels.forward_labels(near, [station], time, value, {"p95": "p95", "p99": "p99"}, horizons).where(F.col("yyyymm").cast("string") == month)
