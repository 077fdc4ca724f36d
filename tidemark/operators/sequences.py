"""Lookback sequences, packed: a block of a series once, with the rows that end a sequence, sliced where they are used.

``labels.lookback_sequences`` writes every row ``length`` times. Here a block is one row that holds its values in one flat array
and, beside it, where sequences end and what belongs to those ends; windows of it are views, made inside the task that reads
them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fresh
from .blocks import blocked

BLOCK_ROWS = 10_000


def packed_sequences(
    df: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], length: int, carried: Sequence[str] = (), ties: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per block of a series: the keys, ``block``, ``values`` (row after row, the features of each, as doubles), ``ends``
    (positions in the block of rows that end a run of ``length`` rows) and, for each column to be carried, its values at these
    ends. Blocks without such a row are left out, and so are series shorter than ``length``. Feature nulls stay nulls."""
    n, block, own, item, rows = fresh([*df.columns, "block", "values", "ends"], "n", "block", "own", "item", "rows")
    dealt = blocked(df.select(*dict.fromkeys([*keys, time, *ties, *features, *carried])), keys, time, before=length - 1, block_rows=block_rows, ties=ties, names=(n, block, own))
    one = F.struct(n, own, F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.struct(*carried).alias("c") if carried else F.lit(0).alias("c"))
    whole = dealt.groupBy(*keys, block).agg(F.array_sort(F.collect_list(one), lambda a, b: F.signum(a[n] - b[n]).cast("int")).alias(rows))
    ends = F.filter(F.transform(rows, lambda r, i: F.when(r[own] & (i >= length - 1), i)), lambda i: i.isNotNull())
    at = whole.select(*keys, F.col(block).alias("block"), rows, ends.alias("ends")).where(F.size("ends") > 0)
    there = lambda c: F.transform("ends", lambda i: F.element_at(rows, i + 1)["c"][c]).alias(c)
    return at.select(*keys, "block", F.flatten(F.transform(rows, lambda r: r["x"])).alias("values"), "ends", *[there(c) for c in carried])


def over_sequences(packed: DataFrame, features: int, length: int, carried: Sequence[str], made: Callable[[np.ndarray, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``made(windows, rows)`` for each block: windows is a view of shape (sequences, length, features), rows the carried columns
    of the rows that end them; what it returns is the result's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                flat = lambda name, row=row: row.column(name).flatten()
                values = flat("values").to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, features)
                windows = np.lib.stride_tricks.sliding_window_view(values, length, axis=0).transpose(0, 2, 1)
                ends = flat("ends").to_numpy() - (length - 1)
                # ends follow one another, so their windows are one slice
                out = made(windows[ends[0] : ends[-1] + 1], pd.DataFrame({c: flat(c).to_pandas() for c in carried}))
                kind = kind or pa.schema([(f.name, f.type) for f in pa.Table.from_pandas(out, preserve_index=False).schema])
                yield from pa.Table.from_pandas(out, schema=kind, preserve_index=False).to_batches()

    return packed.mapInArrow(work, schema)
