"""Labels kept up to date by partitions: what changed is found by fingerprints, and only what a change can reach is made anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import labels
from ..operators.ranks import join_null_safe
from ..sources.feeds import drop_partitions, write_partitions


def fingerprints(rows: DataFrame, station: str, part: str) -> DataFrame:
    """``(part, station, n, mark)``: number of rows and a sum of their hashes, to be stored beside what was made of them."""
    h = F.xxhash64(*sorted(rows.columns))  # summed by halves: sums of longs are much cheaper than of decimals
    high, low = F.sum(F.shiftright(h, 32)).cast("decimal(20,0)"), F.sum(h.bitwiseAND(F.lit(2**32 - 1))).cast("decimal(20,0)")
    mark = (high * F.lit(2**32).cast("decimal(10,0)") + low).cast("decimal(38,0)")
    return rows.groupBy(F.col(part).cast("string").alias(part), station).agg(F.count("*").alias("n"), mark.alias("mark"))


def to_renew(now: DataFrame, before: DataFrame, station: str, part: str, reach: int) -> DataFrame:
    """``(part, station, renew, needed, end)``: which partitions have to be made anew, and which of a station are to be read for it.

    Anew are those where a station's fingerprint changed, came or went, and those before them whose last row has fewer than
    ``reach`` rows of its station between itself and a changed partition. Read are these, and those after them that their windows reach into.
    ``end`` counts the station's rows up to and with the partition. Partitions sort as their names do; a station's partitions are rows of one small window.
    """
    key, empty = [part, station], {"n": F.lit(0).cast("long"), "mark": F.lit(None).cast("decimal(38,0)"), "old_n": F.lit(None).cast("long"), "old_mark": F.lit(None).cast("decimal(38,0)")}
    side = lambda df, **have: df.select(*key, *[F.col(have[c]).alias(c) if c in have else x.alias(c) for c, x in empty.items()])
    sides = side(now, n="n", mark="mark").unionByName(side(before, old_n="n", old_mark="mark"))
    # dealt by station once: the groups and windows below need no further shuffle
    both = sides.repartition(station).groupBy(*key).agg(*[F.max(c).alias(c) for c in empty])
    changed = ~(F.col("n").eqNullSafe(F.col("old_n")) & F.col("mark").eqNullSafe(F.col("old_mark")))
    line = Window.partitionBy(station).orderBy(part)
    end = F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumns({"changed": changed, "end": end})
    rows = rows.withColumn("start", F.col("end") - F.col("n"))
    back = Window.partitionBy(station).orderBy(F.desc(part))  # a frame to a window's end is added up anew for each row, one from its start is not
    following = F.last(F.when(F.col("changed"), F.col("start")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("renew", F.col("changed") | F.coalesce(following - F.col("end") < reach, F.lit(False)))
    whole = rows.groupBy(part).agg(F.max("renew").alias("renew"))  # a partition is replaced for all its stations
    rows = join_null_safe(rows.drop("renew"), F.broadcast(whole), [part])  # a row a partition
    last = F.last(F.when(F.col("renew"), F.col("end")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(*key, "renew", (F.col("renew") | F.coalesce(F.col("start") - last < reach, F.lit(False))).alias("needed"), "end")


def renew_labels(
    rows: DataFrame, before: DataFrame, path: str, station: str, time: str, value: str, part: str, thresholds: DataFrame, horizons: Sequence[int] = (30, 60, 120), ties: Sequence[str] = (),
    now: DataFrame | None = None,
) -> list[str]:
    """Bring the labels under ``path``, partitioned by ``part``, to what whole histories of ``rows`` (a table partitioned by it)
    would give, and return the partitions that were replaced. ``before`` has the fingerprints of the rows that the labels were
    last made of, ``thresholds`` p95 and p99 of a station, which stay frozen, and ``now`` the fingerprints of
    ``rows`` if they are stored already. Both are read more than once. Partitions that no row is left for are deleted."""
    plan = to_renew(fingerprints(rows, station, part) if now is None else now, before, station, part, max(horizons)).groupBy(part)
    plan = plan.agg(F.max("renew").alias("renew"), F.max("needed").alias("needed"), F.max("end").alias("end")).where("needed").orderBy(part).collect()  # a row a partition
    renew, needed = [r[part] for r in plan if r["renew"]], [r[part] for r in plan]
    if not renew:
        return []
    name = F.col(part).cast("string")
    near = labels.attach_thresholds(rows.where(name.isin(needed)), thresholds, station, check=False)  # read by pruned partitions
    made = labels.forward_labels(near, [station], time, value, {"p95": "p95", "p99": "p99"}, horizons, ties=ties, longest=max(r["end"] for r in plan)).where(name.isin(renew))
    spark = rows.sparkSession
    old = _files(spark, path, part, renew)
    write_partitions(made, path, [part], force=True, order=[station, time])
    left = old & _files(spark, path, part, renew) if old else set()  # writing gives a partition's files new names
    drop_partitions(spark, path, part, sorted({p for p, _ in left}))
    return renew


def _files(spark: SparkSession, path: str, part: str, values: Sequence[str]) -> set[tuple[str, str]]:
    """``(partition, file)`` of the table under ``path``, of the given partitions; none if there is no table."""
    spark.catalog.refreshByPath(path)
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return set()
    name = F.col(part).cast("string")
    return {tuple(r) for r in table.where(name.isin(values)).select(name, F.col("_metadata.file_path")).distinct().collect()}  # a row a file
