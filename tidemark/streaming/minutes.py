"""The minute resampling and deduplication of the batch side on Structured Streaming, with bounded state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_minutes(stream: DataFrame, keys: Sequence[str], time: str, means: Sequence[str], late: str = "5 minutes") -> DataFrame:
    """Means and counts per key and minute; rows later than ``late`` are dropped and finished minutes leave the state."""
    aggs = [F.count("*").alias("n_points")] + [x for c in means for x in (F.avg(c).alias(c), F.count(c).alias(f"n_{c}"))]
    out = stream.withWatermark(time, late).groupBy(*keys, F.window(time, "1 minute")).agg(*aggs)
    return out.select(*keys, F.col("window.start").alias(time), *[c for c in out.columns if c not in {*keys, "window"}])


def stream_unique(stream: DataFrame, keys: Sequence[str], time: str, late: str = "5 minutes") -> DataFrame:
    """The first row to arrive for each key, remembered for as long as rows may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
