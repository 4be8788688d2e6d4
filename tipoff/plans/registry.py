"""Queries by name, with their DuckDB form where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tipoff.sources.star import ORACLE, Star

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: str = ORACLE, keep: bool = False) -> Callable[[Callable[[Star], DataFrame]], Callable[[Star], DataFrame]]:
    """Register a function of the star tables; ``sql`` goes on after the shared tables.

    With ``keep`` the lines are written first: for queries that read them more than
    once, or of one season only.
    """

    def add(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Star(spark, sf_dir).keep_lines() if keep else Star(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = base + sql
        return f

    return add
