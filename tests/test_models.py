"""Literal values and invariants of the model functions."""

import math

import pytest
from pyspark.sql import functions as F

from tipoff.functions import model as M
from tipoff.functions import text as T
from tipoff.operators import projection as J


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lit(x):
    return F.lit(x).cast("double")


def test_weights_collapse():
    w = M.bucket_weights()
    assert w["GUARD"]["ast"] == pytest.approx(0.95)
    assert w["CENTER"]["reb"] == pytest.approx(0.825)
    assert w["ALL"]["pts"] == pytest.approx(1.0)


def test_close_game_weight(spark):
    got = one(spark, *[M.close_game_weight(lit(m)) for m in (0, 12, -12, 21, 60)], M.close_game_weight(F.lit(None).cast("double")))
    assert list(got) == [1.0, 1.0, 1.0, 0.5, 0.25, 1.0]


def test_bounds(spark):
    got = one(spark, M.reliability(lit(3)), M.reliability(lit(15)), M.per40_scale(lit(5)), M.opponent_factor(lit(100), lit(0), lit(1)), M.opponent_factor(F.lit(None).cast("double"), lit(2), lit(0)), M.clamp(F.lit(None).cast("double"), 0, 1))
    assert list(got) == [0.3, 1.0, 4.0, 1.6, 1.0, None]


def test_score_curve(spark):
    got = one(spark, M.score_curve(lit(0)), M.score_curve(lit(1.5)), M.score_curve(lit(-1.5)), M.shown(M.score_curve(lit(50))))
    assert got[0] == 60
    assert got[1] == pytest.approx(60 + 39 * math.tanh(1))
    assert got[2] == pytest.approx(60 - 30 * math.tanh(1))
    assert got[3] == 99.0


def test_spread_at_centres_and_between(spark):
    at, between, over = M.spread(lit(0.5)), M.spread(lit(0.25)), M.spread(lit(9))
    got = one(spark, at["median"], between["p25"], over["p90"])
    assert list(got) == pytest.approx([0.98, 0.82, 1.14])


def test_confidence_and_extreme(spark):
    c = lambda g, y, x: M.confidence(F.lit(g), F.lit(y), F.lit(x))
    got = one(spark, c(20, "JR", False), c(20, "JR", True), c(20, "FR", False), c(9, "SO", False), M.extreme(lit(1.3), F.lit("SO")), M.extreme(lit(1.3), F.lit("SR")))
    assert list(got) == ["High", "Medium", "Medium", "Low", True, False]


def test_trend_and_bucket(spark):
    got = one(spark, M.trend(lit(8)), M.trend(lit(-10)), M.trend(lit(-0.5)), M.trend(F.lit(None).cast("double")), M.gap_bucket(lit(0.25)), M.gap_bucket(lit(0.75)), M.gap_bucket(lit(9)))
    assert list(got) == ["Improving", "Declining", "Stable", "Insufficient data", 0.0, 1.0, 3.0]


def players(spark, target_ratings):
    base = "201L as player_id, 'JR' as class_year, 20 as games, 20.0d as avg_minutes, 26.5d as per40_pts, 9.0d as per40_reb, 4.0d as per40_ast, 1.0d as per40_blk, 2.0d as per40_stl, 3.0d as per40_tov, 0.55d as ts_pct, 0.45d as fg_pct, 0.35d as tfg_pct, 66.0d as score_raw, 66.0d as score, 0.0d as current_rating, 10.0d as std_rating, cast(null as double) as minutes_override"
    rows = spark.createDataFrame([(float(t),) for t in target_ratings], "target_rating double")
    return rows.crossJoin(spark.sql(f"select {base}"))


def test_projection_values(spark):
    up, same = J.project(players(spark, [10, 0])).orderBy(F.desc("target_rating")).collect()
    assert up.gap_in_std == 1.0 and up.proj_minutes == pytest.approx(round(20 * (1 - 1 / 6.4), 1))
    assert up.proj_ppg == pytest.approx(round(26.5 * (1.06 - 1 / 5.85) * 20 * (1 - 1 / 6.4) / 40, 1))
    assert same.proj_minutes == 20.0 and same.proj_score == 66.0 and up.proj_score == 64.8


def test_projection_invariants(spark):
    rows = J.project(players(spark, range(-40, 41, 4))).orderBy("target_rating").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.pf >= b.pf and a.proj_ppg >= b.proj_ppg
        assert a.proj_topg / max(a.proj_minutes, 1) <= b.proj_topg / max(b.proj_minutes, 1) + 0.01
    for r in rows:
        for s in J.COUNTS:
            assert r[f"{s}_wide_low"] <= r[f"{s}_likely_low"] + 0.05 and r[f"{s}_likely_high"] <= r[f"{s}_wide_high"] + 0.05
            assert r[f"{s}_likely_low"] - 0.05 <= r[f"proj_{s}"] <= r[f"{s}_likely_high"] + 0.05


def test_parameters_are_checked(spark):
    with pytest.raises(J.ProjectionError):
        J.check_minutes(45)
    with pytest.raises(J.ProjectionError):
        J.fits(J.project(players(spark, [0])), ["nonsense"], 3)


def test_text_functions(spark):
    s = F.lit
    made = T.made_attempted(s("7-9"))
    bad = T.made_attempted(s("7-x"))
    got = one(spark, T.normalize(s("  St. Mary's (CA)  U ")), T.narrow(s("Moorhead St.")), T.narrow(s("St. Cloud St.")), T.team_name(s("Post University")), T.name_key(s("Ervin, Mia")), T.without_parenthesis(s("Northwood (MI)")), *made, *bad, T.height_inches(s("5' 8\"")), T.height_inches(s("n/a")), T.normal_height(s("5-8")), T.normal_height(s(" ")), T.undoubled(s("Ann LeeAnn Lee")), T.season_label(s(2026)), T.int_or_zero(s("7.0")), T.plain_opponent(s("<b>at</b> Ohio &amp; Co")))
    assert list(got) == ["st marys ca u", "moorhead state", "st cloud state", "post", "ervin mia", "Northwood", 7, 9, 0, 0, 68, None, "5' 8\"", None, "Ann Lee", "2025-26", 0, "Ohio & Co"]


def test_name_index_keeps_collisions_out(spark):
    teams = spark.createDataFrame([(1, "Miami"), (2, "Miami (OH)"), (3, "Regis (CO)"), (4, "Regis (MA)"), (5, "Twin"), (6, "Twin")], "team_id long, name string")
    got = {r.key: r.team_id for r in T.name_index(teams).collect()}
    assert got["miami"] == 1 and got["miami oh"] == 2
    assert "regis" not in got and "twin" not in got
    asked = spark.createDataFrame([("Miami (OH)",), ("Regis",)], "opponent string")
    assert {r.opponent: r.team_id for r in T.resolve(asked, T.name_index(teams), "opponent").collect()} == {"Miami (OH)": 2, "Regis": None}


def test_histories_that_cannot_be_read(spark):
    frame = spark.createDataFrame([(1, "A (2021-2022) -> B (2023)"), (2, "A (2021) -> ?"), (3, "A (2001-2020)"), (4, None)], "player_id long, h string")
    assert {(r.player_id, r.team, r.season) for r in T.transfer_rows(frame, "h").collect()} == {(1, "A", 2021), (1, "A", 2022), (1, "B", 2023)}
