"""A ledger of stable ids: a key gets its number once and keeps it.

Each call writes one batch: the keys that no batch has yet, numbered by ranges after the
highest number so far.  Numbers are read from the ledger, never from the plan that made
them, so a task that runs again can't change them; a batch counts when it is complete, and
a call that died half way leaves none.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.operators.ordering import numbered


def batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of the complete batches, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(f"{path}/{n}" for n in found if fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger: its key columns and ``id``; none before the first batch."""
    found = batches(spark, path)
    return spark.read.parquet(*found) if found else None


def assign(keys: DataFrame, path: str, start: int = 0, name: str = "ledger_id") -> DataFrame:
    """Keys (each once, with null keys numbered like others) with their ids."""
    spark = keys.sparkSession
    columns = keys.columns
    known = read(spark, path)
    fresh = keys.distinct()
    top = start
    if known is not None:
        same = [fresh[c].eqNullSafe(known[c]) for c in columns]
        condition = same[0]
        for s in same[1:]:
            condition &= s
        fresh = fresh.join(known, condition, "left_anti")
        top = known.agg(F.max("id")).first()[0] or start
    number = len(batches(spark, path))
    placed = numbered(fresh, [], [F.col(c).asc_nulls_first() for c in columns], "place")
    # an unfinished batch of this number, if there is one, is written over
    placed.select(*columns, (F.col("place") + top).alias("id")).write.mode("overwrite").parquet(f"{path}/batch-{number:06d}")
    ledger = read(spark, path)
    asked = keys.distinct().select(*[F.col(c).alias(f"__{c}") for c in columns])
    condition = F.lit(True)
    for c in columns:
        condition &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return ledger.join(asked, condition, "left_semi").select(*columns, F.col("id").alias(name))
