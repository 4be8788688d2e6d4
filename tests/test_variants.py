"""Parameters, orders and round trips beyond what the registered queries fix."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tipoff.operators.projection import ProjectionError
from tipoff.plans import legacy, variants
from tipoff.sources import shared
from tipoff.sources import tables as S
from tipoff.sources.star import Star


@pytest.fixture(scope="module")
def star(spark):
    return Star(spark, SF).keep_lines()


def test_unknown_orders_and_statistics_are_errors(star):
    for call in (
        lambda: variants.list_teams(star, "rating; drop"), lambda: variants.list_players(star, "nothing"), lambda: variants.leaderboard(star, "salary"),
        lambda: variants.opponent_splits(star, 5, stat="luck"), lambda: variants.best_games(star, "noise"),
    ):
        with pytest.raises(ProjectionError):
            call()


def test_orders_are_kept(star):
    ratings = [r.rating for r in variants.list_teams(star, "rating").collect()]
    assert ratings == sorted(ratings, key=lambda x: (x is None, -(x or 0)))
    heights = [r.height_in for r in variants.list_players(star, "height", limit=200).collect()]
    assert heights == sorted(heights, reverse=True)
    low = [r.value for r in variants.leaderboard(star, "topg").collect()]
    assert low == sorted(low)


@pytest.mark.parametrize("stat", (*variants.RATES, "avg_minutes", *variants.SUMS, *variants.SHARES, "games_started"))
def test_every_statistic_has_a_board(star, stat):
    one = variants.leaderboard(star, stat, limit=10).select("player_id", "value").collect()
    many = variants.all_statistics(star).filter(F.col("stat") == stat).orderBy("place").select("player_id", "value").collect()
    assert one == many


def test_filters_are_conjunctive(star):
    rows = variants.list_players(star, position="G", class_year="SO", portal=False, least_height=70, limit=1000).collect()
    want = star.players.filter("position = 'G' and class_year = 'SO' and in_transfer_portal = false and height_in >= 70").count()
    assert len(rows) == want and {r.position for r in rows} <= {"G"}


def test_sample_is_seeded(star):
    from tipoff.plans import models

    rows = models.projected(star)
    one, again, other = (variants.sampled(rows, 5, seed).select("player_id").collect() for seed in (1, 1, 2))
    assert one == again and len(one) == len(other) == 5


def test_places_by_blocks(spark):
    rows = spark.range(997).select((F.col("id") * 7).alias("k"), F.when(F.col("id") % 5 > 0, (F.col("id") % 13).cast("int")).alias("v"))
    got = {r.k: (r.down, r.up) for r in legacy.places(rows, "v", "k", {"down": F.col("v").desc_nulls_last(), "up": F.col("v").asc_nulls_last()}, block=50).collect()}
    data = [(r.k, r.v) for r in rows.collect()]
    down = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    up = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {k: (down.index((k, v)) + 1, up.index((k, v)) + 1) for k, v in data}


def test_swap_keeps_the_last_table(spark, tmp_path):
    frame = lambda v: spark.createDataFrame([("k", v)], "key string, value string")
    live = str(tmp_path / "live")
    for v in ("1", "2", "3"):
        S.write_table(frame(v), str(tmp_path / v), "meta")
        S.swap(spark, str(tmp_path / v), live)
    assert S.read_table(spark, live, "meta").first().value == "3"
    assert S.read_table(spark, live + ".backup", "meta").first().value == "2"
    with pytest.raises(OSError):
        S.swap(spark, str(tmp_path / "none"), live, tries=1)
    assert S.read_table(spark, live, "meta").first().value == "3"


def test_written_tables_are_released(spark):
    got = shared.written(spark.range(10).selectExpr("id", "id % 2 as half"), "test", "half")
    assert got.columns == ["id", "half"] and got.count() == 10
    path = got.inputFiles()[0].split("/test-")[0]
    before = {f.getPath().getName() for f in spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))}
    assert any(n.startswith("test-") for n in before)
    keep = list(shared._WRITTEN)
    shared._WRITTEN[:] = [w for w in keep if "/test-" in w[1]]
    shared.release()
    shared._WRITTEN[:] = [w for w in keep if "/test-" not in w[1]]
    after = {f.getPath().getName() for f in spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))}
    assert not any(n.startswith("test-") for n in after)
