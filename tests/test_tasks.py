"""Shares of a task that stay bounded when the tables grow."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from tipoff.sources import star


def test_lines_are_dealt_to_tasks_by_the_size_of_the_table(spark, monkeypatch):
    plain = star.Star(spark, SF)
    assert plain.tasks == 0  # few rows: Spark's own number
    want = sorted(map(tuple, plain.lines.collect()))
    monkeypatch.setattr(star, "ITEMS", 300)
    many = star.Star(spark, SF)
    assert many.tasks == -(-many.table("lineitem").count() // 300) > 12
    assert many.lines.select(F.spark_partition_id()).distinct().count() > 12
    assert sorted(map(tuple, many.lines.collect())) == want


@pytest.mark.parametrize("name", ["s11_men", "c05_radar"])
def test_items_are_dealt_to_suppliers_that_are_too_many_to_broadcast(spark, monkeypatch, name):
    want = sorted(map(str, entry.queries()[name](spark, SF).collect()))
    dealt = []
    real = star.Star.dealt
    monkeypatch.setattr(star.Star, "dealt", lambda s, frame, *keys: dealt.append(keys) or real(s, frame, *keys))
    monkeypatch.setattr(star, "ITEMS", 300)
    monkeypatch.setattr(star, "SUPPLIERS", 5, raising=False)
    assert sorted(map(str, entry.queries()[name](spark, SF).collect())) == want
    assert ("l_suppkey",) in dealt  # else Spark's own number of tasks sorts all items


@pytest.mark.parametrize("name", ["s11_schedules", "l03_old_cache"])
def test_items_are_scanned_in_as_many_tasks(spark, monkeypatch, name):
    conf, seen = "spark.sql.files.minPartitionNum", []
    before, real = spark.conf.get(conf, None), star.written
    monkeypatch.setattr(star, "ITEMS", 300)
    monkeypatch.setattr(star, "written", lambda *a: seen.append(spark.conf.get(conf, None)) or real(*a))
    entry.queries()[name](spark, SF)
    assert seen and all(int(s or 0) == star.Star(spark, SF).tasks for s in seen)
    assert spark.conf.get(conf, None) == before  # the session's setting is as it was


def test_items_are_scanned_in_as_many_tasks_for_a_query_that_keeps_no_lines(spark, monkeypatch):
    conf, seen = "spark.sql.files.minPartitionNum", []
    before, real = spark.conf.get(conf, None), star.written
    want = sorted(map(tuple, entry.queries()["c05_radar"](spark, SF).collect()))
    monkeypatch.setattr(star, "written", lambda *a: seen.append(spark.conf.get(conf, None)) or real(*a))
    entry.queries()["c05_radar"](spark, SF)
    assert not seen  # few rows: lazy, nothing is written
    monkeypatch.setattr(star, "ITEMS", 300)
    got = entry.queries()["c05_radar"](spark, SF)
    assert len(seen) == 1 and int(seen[0] or 0) == star.Star(spark, SF).tasks
    assert sorted(map(tuple, got.collect())) == want
    assert spark.conf.get(conf, None) == before


def test_literal_duplicates_are_dealt_too(spark, monkeypatch):
    want = sorted(map(tuple, entry.queries()["k13_literal"](spark, SF).collect()))
    monkeypatch.setattr(star, "ITEMS", 300)
    got = entry.queries()["k13_literal"](spark, SF)
    assert sorted(map(tuple, got.collect())) == want
    # the lines once more, from both halves of the union, by one exchange of their own
    assert got._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") >= 5


@pytest.mark.parametrize("name", ["k18_phantoms", "m08_season_scores", "l02_old_projection", "l06_single_fit", "c09_profile_bars"])
def test_written_lines_are_dealt_again(spark, monkeypatch, name):
    want = sorted(map(str, entry.queries()[name](spark, SF).collect()))
    monkeypatch.setattr(star, "ITEMS", 300)
    got = entry.queries()[name](spark, SF)
    assert sorted(map(str, got.collect())) == want
    # the step after the written lines isn't left to the session's number of tasks
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["s11_men", "s11_ratings", "s11_schedules", "c05_radar", "c06_totals", "c10_resort", "k20_ghost_rosters", "l01_old_roles", "l03_old_cache"])
def test_results_do_not_depend_on_the_number_of_tasks(spark, monkeypatch, name):
    want = sorted(map(str, entry.queries()[name](spark, SF).collect()))
    monkeypatch.setattr(star, "ITEMS", 300)
    assert sorted(map(str, entry.queries()[name](spark, SF).collect())) == want


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cross_team_lines_stay_where_the_lines_have_dealt_them(spark, monkeypatch):
    want = sorted(map(tuple, entry.queries()["k14_cross_team"](spark, SF).collect()))
    # few rows: by player once more
    assert exchanges(entry.queries()["k14_cross_team"](spark, SF)) <= exchanges(star.Star(spark, SF).lines) + 1
    written, real = [], star.written
    monkeypatch.setattr(star, "ITEMS", 300)
    monkeypatch.setattr(star, "written", lambda df, *a: written.append(df) or real(df, *a))
    got = entry.queries()["k14_cross_team"](spark, SF)
    assert sorted(map(tuple, got.collect())) == want
    assert exchanges(got) == 0 and len(written) == 1 and written[0].columns == got.columns  # no table of the lines
    assert exchanges(written[0]) == exchanges(star.Star(spark, SF).lines)


@pytest.mark.parametrize("items", [300, 500_000])
def test_cross_team_query_equals_sql_with_nulls_and_literal_duplicates(spark, monkeypatch, tmp_path, items):
    monkeypatch.setattr(star, "ITEMS", items)
    con = duckdb.connect()
    odd = {
        "lineitem": "select * replace (case when l_orderkey % 5 = 1 then null else l_quantity end as l_quantity, case when l_orderkey % 7 = 1 then null else l_tax end as l_tax) from {t} union all select * replace (l_orderkey + 1000000 as l_orderkey) from {t} where l_orderkey % 4 = 0",
        "orders": "select * replace (case when o_orderkey % 9 = 1 then null else o_orderdate end as o_orderdate) from {t} union all select * replace (o_orderkey + 1000000 as o_orderkey) from {t} where o_orderkey % 4 = 0",
    }
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.execute("copy (" + odd.get(t, "from {t}").format(t=f"read_parquet('{SF}/{t}.parquet')") + f") to '{tmp_path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as from read_parquet('{tmp_path}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()["k14_cross_team"]).fetchall()
    got = entry.queries()["k14_cross_team"](spark, str(tmp_path)).collect()
    assert any(None in r for r in want) and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
