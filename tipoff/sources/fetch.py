"""Fetching pages as a Spark data source: partitions are requests.

    spark.dataSource.register(Requests)
    spark.read.format("requests").option("urls", "\\n".join(urls)).load()
    fetch(spark, worklist, done)

A row comes of every request, with its body or with what went wrong; nothing but a bad option
fails the job.  ``fetch`` leaves out the urls that its table of answers has with a body, so a run
that was cut short goes on where it ended.
"""

from __future__ import annotations

import datetime
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, body binary, bytes long, tries int, error string, fetched_at timestamp"


@dataclass(frozen=True)
class Rules:
    """How long to try: waits grow with each try, three times as fast where a server says
    that it is asked too often, or as long as it says itself, up to ``longest``."""

    tries: int = 4
    wait: float = 2.0
    timeout: float = 20.0
    floor: int = 0
    longest: float = 60.0


def fetched(url: str, rules: Rules, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """One row of SCHEMA without the time: tries until a body of ``floor`` bytes comes."""
    status, error = None, None
    for tried in range(1, rules.tries + 1):
        pause = rules.wait * tried
        try:
            with urllib.request.urlopen(url, timeout=rules.timeout) as answer:
                status, body = answer.status, answer.read()
            if len(body) >= rules.floor:
                return url, status, body, len(body), tried, None
            error = f"{len(body)} bytes, {rules.floor} are the least"
        except urllib.error.HTTPError as e:
            status, error = e.code, f"status {e.code}"
            if e.code == 429:
                said = e.headers.get("Retry-After", "")
                pause = float(said) if said.isdigit() else 3 * pause
            elif 400 <= e.code < 500:
                return url, status, None, 0, tried, error  # asking again gives the same
        except (OSError, ValueError) as e:
            status, error = None, f"{type(e).__name__}: {e}"
            if isinstance(e, ValueError):
                return url, None, None, 0, tried, error
        if tried < rules.tries:
            sleep(min(pause, rules.longest))
    return url, status, None, 0, rules.tries, error


@dataclass
class Batch(InputPartition):
    urls: tuple[str, ...]


class Requests(DataSource):
    """Options: ``urls`` (one a line), ``partitions`` and the fields of ``Rules``."""

    @classmethod
    def name(cls) -> str:
        return "requests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        o = self.options
        rules = Rules(int(o.get("tries", 4)), float(o.get("wait", 2)), float(o.get("timeout", 20)), int(o.get("floor", 0)), float(o.get("longest", 60)))
        urls = list(dict.fromkeys(u.strip() for u in o.get("urls", "").splitlines() if u.strip()))
        return _Reader(urls, max(1, int(o.get("partitions", 8))), rules)


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], parts: int, rules: Rules) -> None:
        self.urls, self.parts, self.rules = urls, parts, rules

    def partitions(self) -> list[Batch]:
        return [Batch(tuple(part)) for i in range(self.parts) if (part := self.urls[i :: self.parts])] or [Batch(())]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for url in partition.urls:
            yield (*fetched(url, self.rules), datetime.datetime.now())


def fetch(spark: SparkSession, worklist: DataFrame, done: str, partitions: int = 8, **rules: object) -> DataFrame:
    """Asks what the worklist (url) has and ``done`` has not, adds the answers to
    ``done`` and returns its rows of the worklist, the last of each url.

    A worklist is the urls of one refresh, some thousands: the driver deals them out.
    """
    spark.dataSource.register(Requests)
    fs = spark._jvm.org.apache.hadoop.fs.Path(done)
    had = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    asked = worklist.select("url").filter("url is not null").distinct()
    left = asked.join(spark.read.schema(SCHEMA).parquet(done).filter("error is null").select("url"), "url", "left_anti") if had else asked
    urls = "\n".join(r.url for r in left.collect())
    answers = spark.read.format("requests").option("urls", urls).option("partitions", str(partitions)).options(**{k: str(v) for k, v in rules.items()}).load()
    answers.write.mode("append").parquet(done)
    rows = spark.read.schema(SCHEMA).parquet(done).join(asked, "url", "left_semi")
    return rows.groupBy("url").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "url"]), "fetched_at").alias("r")).select("url", "r.*")
