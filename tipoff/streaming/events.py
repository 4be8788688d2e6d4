"""Streaming extensions over an event feed; the batch semantics hold per micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tipoff.operators.quality import upsert
from tipoff.sources.shared import folder

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files: str = "*.parquet") -> DataFrame:
    """A folder's Parquet files as a stream."""
    return spark.readStream.schema(EVENT).option("pathGlobFilter", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its memory table (tests, small results)."""
    name = f"drained_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def drained(stream: DataFrame) -> DataFrame:
    """Run an appending stream over what is there; its rows come from files in the shared
    folder, so a result of any size passes the driver by."""
    spark = stream.sparkSession
    path = folder(spark, "drained")
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def once(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Seen events are dropped by id, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and sums of a day and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


STREAK = "user_id long, events long, best double"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, best = state.get if state.exists else (0, float("-inf"))
    for frame in frames:
        n, best = n + len(frame), max(best, float(frame["value"].max()))
    state.update((n, best))
    yield pd.DataFrame({"user_id": [key[0]], "events": [n], "best": [best]})


def running_best(events: DataFrame) -> DataFrame:
    """Custom state: events so far and the best value of each user."""
    return events.groupBy("user_id").applyInPandasWithState(_update, STREAK, "n long, best double", "update", GroupStateTimeout.NoTimeout)


def upsert_into(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """K32 for a stream: each micro-batch replaces the rows of its keys in a new version.

    Versions are folders by batch id, so a batch that is run again writes the same one.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
        before = f"{path}/v{number - 1}"
        whole = upsert(spark.read.parquet(before), new, keys) if number else new
        whole.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write
