"""One row for each key: last, first, or by priority. Aggregations combine before the shuffle, so copies never gather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fresh


def _pick(df: DataFrame, keys: Sequence[str], order: Column, first: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    (row,) = fresh(df.columns, "row")
    pick = F.min_by if first else F.max_by
    whole = pick(F.struct(*rest), F.struct(order, *_ties(df, rest))) if rest else F.lit(None)
    picked = df.groupBy(*keys).agg(whole.alias(row))
    return picked.select(*[F.col(c) if c in keys else F.col(f"{row}.{c}").alias(c) for c in df.columns])


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return _orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def _ties(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Columns as they break ties: a map by its entries in order; what has no order at all breaks none."""
    out = []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.MapType) and _orderable(kind.keyType) and _orderable(kind.valueType):
            out.append(F.array_sort(F.map_entries(c)))
        elif _orderable(kind):
            out.append(F.col(c))
    return out


def _order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]) if order else F.lit(0)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """The row of each key that comes last in the order; all other columns, in turn, break ties."""
    return _pick(df, list(keys), _order(df, keys, order), first=False)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """The row of each key that comes first in the order; all other columns, in turn, break ties."""
    return _pick(df, list(keys), _order(df, keys, order), first=True)


def keep_priority(df: DataFrame, keys: Sequence[str], priority: Column, name: str) -> DataFrame:
    """The row of each key of the highest priority, then of the least name."""
    (place,) = fresh(df.columns, "priority")
    return keep_first(df.withColumn(place, -priority), keys, [place, name]).drop(place)


def count_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: duplicates, the rows beyond the first of each key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates"))
