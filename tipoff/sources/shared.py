"""Tables that a query writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the checkpoint folder that was set.

    Only in local mode, where one machine is all there is, a temporary folder is made
    if neither is set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tipoff-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of a query's own, deleted by ``release``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """df from a table of its own that is written now: read often, computed once.

    It stays until ``release``, as what reads it is lazy.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df from a table bucketed and sorted by keys: joins and aggregates on these keys move
    only their other side.  Its files lie in the shared folder, not in the warehouse."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"tipoff_{uuid.uuid4().hex}", folder(spark, name)
    _TABLES.append((spark, table))
    dealt = df.repartition(buckets, *keys)  # a file a bucket
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def release() -> None:
    """Delete the tables written so far; to be called when results have been written."""
    while _TABLES:
        spark, table = _TABLES.pop()
        spark.sql(f"drop table if exists {table}")
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
