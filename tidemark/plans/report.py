"""Report tables: dataset overview, result matrix with the best model of each row marked, and details of one model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_custom_order


def dataset_table(df: DataFrame, station: str, time: str, rates: dict[str, Sequence[str]]) -> DataFrame:
    """Per split: rows, stations, first and last day, and for each name the mean event rate over its targets."""
    aggs = [F.count("*").alias("rows"), F.countDistinct(station).alias("stations"), F.to_date(F.min(time)).alias("first_day"), F.to_date(F.max(time)).alias("last_day")]
    for name, targets in rates.items():
        aggs.append((sum((F.avg(t) for t in targets), F.lit(0.0)) / len(targets)).alias(f"{name}_rate"))
    return df.groupBy("split").agg(*aggs)


def results_matrix(long: DataFrame, index: str, model: str, metric: str, models: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per index in a custom order, a column per model, and ``best``: the first model of the largest value."""
    cells = [F.max(F.when(F.col(model) == m, F.col(metric))).alias(m) for m in models]
    table = long.groupBy(index).agg(*cells)
    top = F.greatest(*[F.col(m) for m in models]) if len(models) > 1 else F.col(models[0])
    best = F.lit(None).cast("string")
    for m in reversed(models):
        best = F.when(F.col(m) == top, F.lit(m)).otherwise(best)
    return table.withColumn("best", best).orderBy(*by_custom_order(F.col(index), list(order)))


def model_details(long: DataFrame, chosen: str, metrics: Sequence[str], index: str, model: str = "model", order: Sequence[str] = ()) -> DataFrame:
    """The rows of one model with the listed metrics, in a custom order."""
    return long.where(F.col(model) == chosen).select(index, *metrics).orderBy(*by_custom_order(F.col(index), list(order)))


def top_rows(df: DataFrame, score: str, name: str, n: int) -> DataFrame:
    """The n rows of the largest score, nulls last, then by name."""
    return df.orderBy(F.desc_nulls_last(score), name).limit(n)
