"""Refresh of the partitions that a change touches, and of no others.

A table is a folder of ``key=value`` partitions.  The changed partitions are written beside
it, checked there, and each then takes the live one's place by two renames; a partition
that no changed row belongs to is neither read nor written, so its files stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.operators.quality import passed


class PartitionError(RuntimeError):
    """The checks found errors in what would change; the live table is as it was."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def leaves(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Relative paths of a table's partitions: a listing, no rows."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return []
    found = [""]
    for _ in range(depth):
        found = [f"{p}/{s.getPath().getName()}".lstrip("/") for p in found for s in fs.listStatus(_files(spark, f"{path}/{p}")[1]) if s.isDirectory() and "=" in s.getPath().getName()]
    return sorted(found)


def replace_partitions(frame: DataFrame, live: str, keys: list[str], checks: Callable[[DataFrame], DataFrame] | None = None) -> list[str]:
    """The partitions that ``frame`` has rows of are replaced by these rows.

    ``checks`` gives findings (severity, category, n) of the staged rows alone; an error among
    them stops the refresh before anything is live.  Returns the partitions that changed.
    A rename that fails puts its partition back; those before it stay changed, and the
    call can be made again.
    """
    spark = frame.sparkSession
    staged = f"{live.rstrip('/')}.staged-{uuid.uuid4().hex}"
    frame.write.partitionBy(*keys).parquet(staged)
    try:
        if checks is not None and not passed(checks(spark.read.parquet(staged))):
            raise PartitionError("the checks found errors in the changed partitions")
        changed = leaves(spark, staged, len(keys))
        for part in changed:
            _swap(spark, f"{staged}/{part}", f"{live}/{part}")
    finally:
        fs, at = _files(spark, staged)
        fs.delete(at, True)
    return changed


def _swap(spark: SparkSession, new: str, live: str) -> None:
    """A partition's files change places; the old ones go when the new ones are there."""
    fs, source = _files(spark, new)
    target, aside = _files(spark, live)[1], _files(spark, f"{live.rpartition('/')[0]}/.old-{uuid.uuid4().hex}")[1]
    fs.mkdirs(target.getParent())
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"{live} can't be moved aside")
    if not fs.rename(source, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"{new} can't take the place of {live}")
    fs.delete(aside, True)


def of_partitions(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the partitions that changes belong to: the filter prunes the scan."""
    touched = changes.select(*keys).distinct().collect()  # a row a partition
    condition = F.lit(False)
    for row in touched:
        one = F.lit(True)
        for k in keys:
            one &= F.col(k).eqNullSafe(F.lit(row[k]))
        condition |= one
    return table.filter(condition)


def upsert_partitions(changes: DataFrame, live: str, keys: list[str], row_key: list[str], checks: Callable[[DataFrame], DataFrame] | None = None) -> list[str]:
    """Rows of ``changes`` take the place of those with their key, or are added; only
    their partitions are read and written.  A key may not move between partitions."""
    spark = changes.sparkSession
    if not leaves(spark, live, len(keys)):
        return replace_partitions(changes, live, keys, checks)
    old = of_partitions(spark.read.parquet(live), changes, keys)
    whole = old.join(changes.select(*keys, *row_key), [*keys, *row_key], "left_anti").select(*changes.columns).unionByName(changes)
    return replace_partitions(whole, live, keys, checks)
