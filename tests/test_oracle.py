"""Every query with a DuckDB form returns its rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def rows_only():

    llm = {"pipeline"} | {q for q in entry.queries() if q.startswith("op") and q[2].isdigit()}
    return sorted(set(entry.queries()) - set(entry.oracle_sql()) - llm)


@pytest.mark.parametrize("name", rows_only())
def test_rows_only_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
