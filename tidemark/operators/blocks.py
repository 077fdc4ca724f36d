"""Row-based frames over long series without one task for a whole series.

A window partitioned by station alone puts a station's whole history into one task. Here each row gets its number in its
series from counts per day (combined before the shuffle), series are cut into blocks of ``block_rows`` rows, and each block
also holds the few rows before and after it that frames reach into. Frames of at most that reach are then exact. Series that are
no longer than a block need none of this: ``over_blocks`` takes them as they are, with one shuffle of their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.columns import fresh
from .ranks import join_null_safe

NUMBER, BLOCK, OWN = "__n", "__block", "__own"


def number_rows(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = (), number: str | None = None) -> DataFrame:
    """Adds each row's number (from 0) in its series, ordered by time and ties. Without a name of its own the frame may have
    none of the names that ``series`` and ``own_rows`` go by."""
    if number is None:
        if taken := {BLOCK, OWN} & set(df.columns):
            raise ValueError(f"the frame has columns {sorted(taken)}; give the number another name")
        number = NUMBER
    if number in df.columns:
        raise ValueError(f"the frame has a column {number}; give the number another name")
    day, count, before_day, place = fresh([*df.columns, number], "day", "count", "before", "place")
    rows = df.withColumn(day, F.date_trunc("day", F.col(time)))
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, day).agg(F.count("*").alias(count))
    counts = counts.select(*keys, day, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(before_day))
    inside = Window.partitionBy(*keys, day).orderBy(time, *ties)
    joined = join_null_safe(rows.withColumn(place, F.row_number().over(inside) - 1), counts, [*keys, day])
    return joined.withColumn(number, F.col(before_day) + F.col(place)).drop(day, place, before_day)


def blocked(df: DataFrame, keys: Sequence[str], time: str, before: int = 0, after: int = 0, block_rows: int = 100_000, ties: Sequence[str] = (), names: Sequence[str] = (NUMBER, BLOCK, OWN)) -> DataFrame:
    """Rows dealt to blocks, with copies of those that the next or the previous block's frames need. ``names`` are those of the
    row's number, its block and whether it is the block's own."""
    number, block, own = names
    if taken := {block, own} & set(df.columns):
        raise ValueError(f"the frame has columns {sorted(taken)}; give block and own other names")
    if max(before, after) > block_rows:
        raise ValueError("frames may not reach beyond a neighbouring block")
    rows = number_rows(df, keys, time, ties, number)
    home, place = F.floor(F.col(number) / block_rows), F.col(number) % block_rows
    where = [F.struct(home.alias("b"), F.lit(True).alias("own"))]
    if before:
        where.append(F.when(place >= block_rows - before, F.struct((home + 1).alias("b"), F.lit(False).alias("own"))))
    if after:
        where.append(F.when((place < after) & (home > 0), F.struct((home - 1).alias("b"), F.lit(False).alias("own"))))
    (spot,) = fresh(rows.columns, "spot")
    dealt = rows.withColumn(spot, F.explode(F.filter(F.array(*where), lambda x: x.isNotNull())))
    return dealt.withColumns({block: F.col(f"{spot}.b"), own: F.col(f"{spot}.own")}).drop(spot)


def series(keys: Sequence[str]) -> WindowSpec:
    """The window of a block's rows in order."""
    return Window.partitionBy(*keys, BLOCK).orderBy(NUMBER)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(NUMBER, BLOCK, OWN)


def lag(keys: Sequence[str]):
    """``lag(column, rows)`` within blocks."""
    w = series(keys)
    return lambda c, k: F.lag(c, k).over(w)


def over_blocks(df: DataFrame, keys: Sequence[str], time: str, columns, before: int = 0, after: int = 0, ties: Sequence[str] = (), block_rows: int = 100_000, longest: int | None = None) -> DataFrame:
    """``df`` with the columns that ``columns(window)`` gives, frames reaching ``before`` and ``after`` rows at most. Columns of
    ``df`` may have any names. Only series of more than ``block_rows`` rows are cut into blocks; whether there are any is asked
    at once, by counts per series, unless ``longest``, a bound on the rows of a series, says that there are none."""
    if max(before, after) > block_rows:
        raise ValueError("frames may not reach beyond a neighbouring block")
    if not keys:
        return _cut(df, keys, time, columns, before, after, ties, block_rows)
    count, long = fresh(df.columns, "count", "long")
    sizes = df.groupBy(*keys).agg(F.count("*").alias(count)).where(F.col(count) > block_rows).select(*keys, F.lit(True).alias(long))
    whole = lambda rows: rows.withColumns(columns(Window.partitionBy(*keys).orderBy(time, *ties)))
    if (longest is not None and longest <= block_rows) or sizes.isEmpty():
        return whole(df)
    marked = join_null_safe(df, F.broadcast(sizes), keys, "left")  # a row for each block_rows rows of df at most
    short, cut = marked.where(F.col(long).isNull()).drop(long), marked.where(long).drop(long)
    return whole(short).unionByName(_cut(cut, keys, time, columns, before, after, ties, block_rows))


def _cut(df: DataFrame, keys: Sequence[str], time: str, columns, before: int, after: int, ties: Sequence[str], block_rows: int) -> DataFrame:
    names = fresh(df.columns, "n", "block", "own")
    made: dict[str, Column] = columns(Window.partitionBy(*keys, names[1]).orderBy(names[0]))
    return blocked(df, keys, time, before, after, block_rows, ties, names).withColumns(made).where(names[2]).drop(*names)
