"""Helpers shared by the operators: shared folder, batches, document keys."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.sources.shared import shared_dir

#: Rows of one Arrow batch.  Spark bounds its bytes too (spark.sql.execution.arrow.maxBytesPerBatch,
#: 64 MB unless set), so that very long texts come in batches of few.
BATCH_ROWS = 1000
#: Distinct strings that a worker's lookup cache may hold before it starts anew.
CACHE_ENTRIES = 600_000


_OPEN: list[Workspace] = []


class Workspace:
    """Tables of one operator call, in a folder of their own in the shared folder.

    A table that was written cuts the lineage: a lost executor costs the reread
    of a file, not the recomputation of what led to it.  An operator drops what it
    is done with; what its lazy result still reads stays until ``release``.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"  # told apart from tables of queries
        self.tables: list[str] = []
        _OPEN.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return it reread."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def rest(self) -> None:
        """Let Spark's cleaner remove the shuffle files of steps that are done."""
        gc.collect()
        self.spark._jvm.System.gc()

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """Write df as a table bucketed and sorted by key: later joins on the key move
        only their other side.  Its files lie in the workspace, not in the warehouse."""
        name = f"tipoff_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables.append(name)
        df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(name)
        return self.spark.table(name)

    def unbucket(self) -> None:
        """Drop the bucketed tables with their files."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
            self.drop(name)
        self.tables.clear()

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing will read again, or all of them."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def opened() -> list[Workspace]:
    """The workspaces that lazy results may still read."""
    return list(_OPEN)


def release(keep: Iterable[Workspace] = ()) -> None:
    """Delete what the operators called so far have left in shared folders, but for ``keep``.

    To be called when their results have been written; who runs operators of their own
    beside others keeps what was ``opened`` before.
    """
    kept = list(keep)
    for work in [w for w in _OPEN if w not in kept]:
        _OPEN.remove(work)
        work.unbucket()
        work.drop()


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's default Arrow batch (10,000 rows) so that long texts fit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name of our own that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def text_or_empty(col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key(col: str) -> Column:
    """128-bit key of a text: equal texts are one row of work wherever they lie."""
    return F.unhex(F.md5(F.encode(F.col(col), "utf-8")))


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's cycle collector: it would walk large caches of strings again and
    again, for work that makes no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def trimmed(cache: dict[str, object]) -> dict[str, object]:
    """A full cache, without the long strings: short ones come back most often."""
    kept = {k: v for k, v in cache.items() if len(k) <= 7}
    return kept if len(kept) <= CACHE_ENTRIES // 2 else {}
