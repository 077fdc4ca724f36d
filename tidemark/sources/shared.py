"""The folder that the driver and every executor share, and tables stored there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    Read from ``spark.checkpoint.dir``; only where that is unset and all is one process (tests) is a temporary folder chosen,
    the same one for all calls of an application. On a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        _own[app] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of ``materialise`` that no later step reads."""
    for uri in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark, uri)


def written(spark: SparkSession) -> int:
    """How many tables this application has written here so far: a mark for ``forget_since``."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def forget_since(spark: SparkSession, mark: int, kept: DataFrame) -> None:
    """Delete the tables written since a mark, but for the one that ``kept`` reads: for the end of a stage whose result is
    stored."""
    have = {f.rpartition("/")[0].rpartition("/")[2] for f in kept.inputFiles()}
    paths = _written.get(spark.sparkContext.applicationId, [])
    for uri in [p for p in paths[mark:] if have and p.rpartition("/")[2] not in have]:  # a table without files is not worth a search
        paths.remove(uri)
        _delete(spark, uri)


def forget_all(spark: SparkSession) -> None:
    """Delete every table that this application has written here: for a job's end, when all its results are stored."""
    for uri in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, uri)


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
