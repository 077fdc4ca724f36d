"""Column helpers of the cleaning stages. All are built-in expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for columns of the caller's own: those wanted, with underscores before them until none is taken."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


# ---- projection and schema


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename those columns that are there."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def project_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The listed ``name: type`` columns in order; an absent one is a typed null."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def first_present(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """The first non-null of those named columns that are there; a typed null if none is."""
    found = [F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def drop_named(df: DataFrame, names: Iterable[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    """Drop listed columns and those with one of the suffixes."""
    gone = set(names) | {c for c in df.columns if any(c.endswith(s) for s in suffixes)}
    return df.drop(*gone)


def drop_all_null(df: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """Drop columns that hold no value at all: one aggregation over all candidates, explicit because it reads the data."""
    asked = [c for c in df.columns if c not in protected]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in asked]).first() if asked else {}
    return df.drop(*[c for c in asked if counts[c] == 0])


def union_outer(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def union_strict(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of frames of the same columns, cast to the first one's types; other columns raise."""
    for df in more:
        if set(df.columns) != set(first.columns):
            raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(first.columns))}")
        first = first.unionByName(df.select(*[F.col(f.name).cast(f.dataType) for f in first.schema.fields]))
    return first


# ---- coercion


def to_number(c: str | Column, kind: str = "double") -> Column:
    """Text to number, null where it is none (ANSI casts would raise)."""
    return _col(c).try_cast(kind)


def to_time(c: str | Column, kind: str = "timestamp") -> Column:
    """Timestamps from timestamps, epoch seconds (``kind='epoch'``) or text; null where there is none."""
    if kind == "epoch":
        return F.timestamp_seconds(_col(c).try_cast("double"))
    return _col(c).try_cast("timestamp")


def day_of_year_time(year: Column, day: Column, hour: Column, minute: Column) -> Column:
    """Timestamp from year, day of the year, hour and minute."""
    start = F.make_date(year.cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
    return start + F.make_dt_interval(day.cast("int") - 1, hour.cast("int"), minute.cast("int"))


def standardise(df: DataFrame, floats: Sequence[str] = (), counts: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """Columns that are there, as float, bigint (rounded half to even first) and boolean."""
    casts = {c: F.col(c).cast("float") for c in floats if c in df.columns}
    casts |= {c: F.rint(F.col(c).cast("double")).cast("bigint") for c in counts if c in df.columns}
    casts |= {c: F.col(c).cast("boolean") for c in flags if c in df.columns}
    return df.withColumns(casts)


# ---- cleaning


def null_sentinels(df: DataFrame, fills: dict[str, Sequence[float]]) -> DataFrame:
    """Fill values to null, each column with a list of its own."""
    return df.withColumns({c: F.when(~F.col(c).isin(*v), F.col(c)) for c, v in fills.items() if c in df.columns})


def null_outside(c: str | Column, low: float, high: float) -> Column:
    """The value inside [low, high], else null."""
    return F.when(_col(c).between(low, high), _col(c))


def all_present(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def any_present(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNotNull()
    return out


def at_most(df: DataFrame, column: str, limit: float) -> Column:
    """True where the column is at most the limit; false for null, and everywhere if there is no such column."""
    return F.coalesce(F.col(column) <= limit, F.lit(False)) if column in df.columns else F.lit(False)


def flag_valid(value: Column, flag: Column, generation: Column, allowed: dict[str, Sequence[int]]) -> Column:
    """The value is there and its flag is one of those allowed for its generation; unknown generations are invalid."""
    ok = F.lit(False)
    for name, flags in allowed.items():
        ok = F.when(generation == name, flag.isin(*flags)).otherwise(ok)
    return F.coalesce(ok & value.isNotNull(), F.lit(False))


def generation(df: DataFrame, markers: Sequence[str], new: str = "goesr", old: str = "legacy") -> Column:
    """``new`` where one of the marker columns holds a value, else ``old``."""
    present = [c for c in markers if c in df.columns]
    return F.when(any_present(present), F.lit(new)).otherwise(F.lit(old)) if present else F.lit(old)


def prefer(choice: Column, first: Column, second: Column) -> Column:
    """``first`` where the choice holds, else ``second``."""
    return F.when(choice, first).otherwise(second)


def preferred_frame(nez_valid: Column, geo_valid: Column) -> Column:
    """'nez', else 'geo', else null."""
    return F.when(nez_valid, "nez").when(geo_valid, "geo")


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom where both are positive."""
    return F.when((top > 0) & (bottom > 0), top / bottom)


def nested_number(c: str | Column, key: str) -> Column:
    """A number under ``key`` in JSON text or a text dict with single quotes and None; bad text gives null."""
    text = F.regexp_replace(_col(c), r"\bNone\b", "null")
    return F.from_json(text, T.StructType([T.StructField(key, T.DoubleType())]))[key]


def vector_columns(c: str, names: Sequence[str]) -> list[Column]:
    """Elements of an array as columns; missing ones are null."""
    return [F.get(F.col(c), F.lit(i)).alias(n) for i, n in enumerate(names)]


def clip(c: str | Column, low: float, high: float) -> Column:
    """Into [low, high]; null stays null (greatest and least alone would skip it)."""
    return F.when(_col(c).isNotNull(), F.least(F.greatest(_col(c), F.lit(low)), F.lit(high)))


# ---- keys, calendar, ranges


def calendar(df: DataFrame, time: str, month_text: bool = False) -> DataFrame:
    """year, month (number, or 'YYYY-MM') and yyyymm of a time column."""
    t = F.col(time)
    month = F.date_format(t, "yyyy-MM") if month_text else F.month(t).cast("byte")
    return df.withColumns({"year": F.year(t).cast("short"), "month": month, "yyyymm": F.date_format(t, "yyyyMM")})


def in_days(time: str, start: str, end: str) -> Column:
    """Inclusive days: from the start day's first instant to the end day's last microsecond."""
    t = F.col(time)
    return (t >= F.lit(start).cast("timestamp")) & (t < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """The span [start, end] meets [low, high]."""
    return (start <= high) & (end >= low)


def family(feature: Column, prefixes: dict[str, str], other: str = "other") -> Column:
    """Family of a feature name by its first matching prefix."""
    out = F.lit(other)
    for prefix, name in reversed(prefixes.items()):
        out = F.when(feature.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def target_spec(name: Column) -> tuple[Column, Column]:
    """(quantile, minutes) of names such as target_geq_p95_30m."""
    pattern = r"^target_geq_p(\d+)_(\d+)m$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit("")).cast("int")
    return part(1) / 100, part(2)


def to_nec(b_r: Column, b_theta: Column, b_phi: Column) -> list[Column]:
    """Spherical components as north, east and centre."""
    return [(-b_theta).alias("north"), b_phi.alias("east"), (-b_r).alias("centre")]


def circular_mean(degrees: Column) -> Column:
    """Aggregate: mean direction in degrees, from -180 to 180."""
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))))


def by_custom_order(c: Column, order: Sequence[str]) -> list[Column]:
    """Sort keys: place in ``order``, unknown values last, then the value."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), c)
    return [F.when(place > 0, place).otherwise(len(order) + 1), c]
