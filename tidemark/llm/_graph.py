"""Connected components by alternating large-star and small-star rounds in DataFrames, the last of a small graph in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, materialise

#: A graph of at most so many edges (of 16 bytes) is finished by one task.
SMALL_EDGES = 100_000
#: Hubs, at most so many, are joined by a broadcast in place of a shuffle by key.
HUBS, LEAST_HUB = 4096, 1000


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of linked positions; a label is the smallest position of its class."""
    while len(i):
        a, b = label[i], label[j]
        d = a != b
        i, j, a, b = i[d], j[d], a[d], b[d]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([b.column(k).to_numpy() for k in (0, 1)]) for b in batches if b.num_rows]
    if parts:
        ids, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        u, v = at.reshape(2, -1)
        label = np.arange(len(ids))
        hook(label, u, v)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["v", "root"])


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a table of a row a key, whose column n says how many of the ``total`` rows have that key.

    Keys of more than ``LEAST_HUB`` and a ``HUBS``-th part of all rows, so at most ``HUBS`` of them, are joined by a broadcast;
    those left have few rows each, so no task of the shuffled join holds more than a sliver of all.
    """
    hub = max(LEAST_HUB, total // HUBS)
    hubs = F.broadcast(counted.where(F.col("n") > hub))
    rest = rows.join(hubs.select(key), key, "left_anti").join(counted.where(F.col("n") <= hub), key)
    return rows.join(hubs, key).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges``; root is the smallest vertex reachable.

    A round only takes minima per vertex (combined before the shuffle) and joins them back, hubs by a broadcast of their minima,
    so a hub with a third of all edges is never gathered. Each round is written to the shared folder; vertices without edges do
    not appear. Once there are no more than ``SMALL_EDGES`` edges, one task finishes them.
    """
    spark = edges.sparkSession
    e = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] <= SMALL_EDGES:
            return e.coalesce(1).mapInArrow(_finish, "v long, root long")
        if mark == seen:
            break
        seen = mark
        minima = lambda rows: rows.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both).select("u", "n", F.least("u", "m").alias("m"))
        large = join_counted(both, low, "u", 2 * mark["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = minima(large)
        small = (
            join_counted(large, low, "u", mark["n"])
            .where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, e = e, materialise(small, "edges")
        forget(spark, before)
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("v"), F.col("v").alias("root")).distinct()
    )
