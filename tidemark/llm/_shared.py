"""Shared storage and lineage cuts for multi-stage operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, forget_all, forget_since, materialise, new_path, shared_dir, written

__all__ = ["forget", "forget_all", "forget_since", "hashed_sample", "materialise", "new_path", "shared_dir", "written"]


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest hashes of ``key`` (not quite so where the hashes crowd): the same
    whatever the partitioning. A first cut by hash keeps tasks from sending ``rows`` rows each to the last one."""
    total = df.count()
    if total > 2 * rows:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(10**9)) < int(10**9 * 1.5 * rows / total))
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(10**9)), key).limit(rows)
