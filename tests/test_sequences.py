"""Packed lookback sequences: the same windows as the plain operator, at a fraction of its bytes."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels, sequences

SCHEMA = "k string, t timestamp, a double, b double, id int, block string, ends int"


def rows_like(seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    sizes = {"long": 700, "exact": 5, "short": 4, "one": 1, None: 40}
    rows = [(k, start + timedelta(minutes=37 * i), rng.random(), None if i % 9 == 4 else float(i), 0, "x", 1) for k, n in sizes.items() for i in range(n)]
    return [(*r[:4], i, *r[5:]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [5, 64, 10_000])
def test_same_windows_as_the_plain_operator(spark, block):
    df = spark.createDataFrame(rows_like(1), SCHEMA).repartition(4)
    packed = sequences.packed_sequences(df, ["k"], "t", ["a", "b"], 5, ["id", "t"], block_rows=block)

    def made(windows, rows):
        assert windows.shape[1:] == (5, 2) and len(windows) == len(rows) and set(rows.columns) == {"id", "t"}
        return pd.DataFrame({"id": rows["id"], "flat": [w.ravel().tolist() for w in windows]})

    got = {r.id: r.flat for r in sequences.over_sequences(packed, 2, 5, ["id", "t"], made, "id int, flat array<double>").collect()}
    plain = labels.lookback_sequences(df, ["k"], "t", ["a", "b"], 5).select("id", "sequence").collect()
    want = {r.id: [x for s in r.sequence for x in (s.a, s.b)] for r in plain}
    assert set(got) == set(want) and len(want) == 696 + 1 + 36
    for i, v in want.items():
        assert np.allclose(np.array(got[i], float), np.array(v, float), equal_nan=True)


def test_bytes_are_near_the_inputs(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    size = lambda name, frame: (frame.coalesce(1).write.parquet(f"{tmp_path}/{name}"), sum(f.stat().st_size for f in Path(f"{tmp_path}/{name}").rglob("*.parquet")))[1]
    rows = size("rows", df.select("a", "b", "c"))
    packed = size("packed", sequences.packed_sequences(df, ["k"], "t", ["a", "b", "c"], 60))
    assert packed < 1.4 * rows


def test_nothing(spark):
    assert sequences.packed_sequences(spark.createDataFrame([], SCHEMA), ["k"], "t", ["a"], 3, ["id"]).count() == 0
