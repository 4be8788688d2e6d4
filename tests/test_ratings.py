"""The solver and Elo against plain loops, and the lineup's rules."""

import math
import time

import numpy as np
import pandas as pd
import pytest

from tipoff.operators import quality as K
from tipoff.operators import ratings as R
from tests.conftest import SF
from tipoff.operators import roles
from tipoff.operators.roles import _lineup
from tipoff.plans import models
from tipoff.sources.star import Star


def games(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "season int, home_team_id long, away_team_id long, home_score long, away_score long")


ROUND_ROBIN = [(1, 2, 70, 60), (1, 3, 65, 66), (1, 4, 80, 50), (2, 3, 71, 70), (2, 4, 60, 55), (3, 4, 90, 60)]


def plain(rows, passes, tolerance):
    side = {}
    for h, a, hs, as_ in rows:
        side.setdefault(h, []).append((a, hs, as_))
        side.setdefault(a, []).append((h, as_, hs))
    mean = lambda x: sum(x) / len(x)
    off = {t: mean([s for _, s, _ in g]) for t, g in side.items()}
    de = {t: mean([x for _, _, x in g]) for t, g in side.items()}
    for n in range(1, passes + 1):
        md, mo = mean(list(de.values())), mean(list(off.values()))
        new_off = {t: mean([s - de[o] for o, s, _ in g]) + md for t, g in side.items()}
        new_de = {t: mean([x - off[o] for o, _, x in g]) + mo for t, g in side.items()}
        change = max(max(abs(new_off[t] - off[t]), abs(new_de[t] - de[t])) for t in side)
        off, de = new_off, new_de
        if change < tolerance:
            break
    return {t: off[t] - de[t] for t in side}, n


def test_round_robin_converges(spark):
    got = R.solve_ratings(R.unpivot(games(spark, ROUND_ROBIN))).collect()
    want, passes = plain(ROUND_ROBIN, 200, 1e-4)
    assert {r.team_id: pytest.approx(r.rating) for r in got} == want
    assert {r.iterations for r in got} == {passes} and passes < 200


def test_bipartite_is_capped_and_told(spark):
    rows = [(1, 3, 70, 60), (1, 4, 65, 66), (2, 3, 80, 50), (2, 4, 71, 70)]
    got = R.solve_ratings(R.unpivot(games(spark, rows))).collect()
    assert {r.iterations for r in got} == {200} and got[0].max_change > 1
    assert {r.team_id: pytest.approx(r.rating) for r in got} == plain(rows, 200, 1e-4)[0]


def test_distributed_solver_agrees(spark):
    sides = R.unpivot(games(spark, ROUND_ROBIN))
    a = {r.team_id: r.rating for r in R.solve_ratings(sides, passes=4, tolerance=0.0).collect()}
    b = {r.team_id: r.rating for r in R.solve_distributed(sides, 4).collect()}
    assert a == pytest.approx(b)


def test_unpivot_leaves_self_play_out(spark):
    got = R.unpivot(games(spark, [(1, 1, 5, 5), (1, 2, 7, 6), (1, 3, None, 4)])).collect()
    assert sorted((r.team_id, r.scored, r.home) for r in got) == [(1, 7, True), (2, 6, False)]


def test_elo_is_sequential(spark):
    from pyspark.sql import functions as F

    frame = games(spark, ROUND_ROBIN).withColumn("game_order", F.col("home_team_id") * 10 + F.col("away_team_id"))
    rating = dict.fromkeys(range(1, 5), 1600.0)
    for epoch in range(1, 7):
        for h, a, hs, as_ in ROUND_ROBIN:
            expected = 1 / (1 + 10 ** ((rating[a] - rating[h]) / 400))
            change = 32 / epoch * (math.log(abs(hs - as_) + 1) + 1) * ((hs > as_) + 0.5 * (hs == as_) - expected)
            rating[h] += change
            rating[a] -= change
    assert {r.team_id: r.elo for r in R.elo(frame).collect()} == pytest.approx(rating)


def roster(**over):
    n = over.pop("n", 9)
    frame = pd.DataFrame({"team_id": 1, "player_id": range(n), "position": [("G", "F", "C")[i % 3] for i in range(n)], "games": 20, "games_started": [20 if i < 5 else 0 for i in range(n)], "team_games": 20, "avg_minutes": [30.0 - i for i in range(n)], "total_minutes": [600.0 - 20 * i for i in range(n)], "per40_pts": [20.0 - i for i in range(n)], "ppg_actual": [1.0] * n, "avg_production": [25.0 - i for i in range(n)], "score": [80.0 - i for i in range(n)]})
    return frame.assign(**over)


def test_lineup_balances_positions():
    got = _lineup(roster())
    five = got[got.role == "Starter"]
    assert len(five) == 5 and (five.position == "G").sum() >= 2 and (five.position == "F").sum() >= 2
    assert (got.role == "Sixth Man").sum() == 1 and got.minutes.sum() == pytest.approx(200, abs=1)


def test_lineup_without_forwards_and_thin_rosters():
    got = _lineup(roster(position=["G"] * 9))
    assert (got.role == "Starter").sum() == 5
    assert _lineup(roster(n=4)).empty


def test_lineup_relaxes_positions_for_points():
    got = _lineup(roster(ppg_actual=[99.0] * 9))
    assert set(got.tier) == {2}


def test_lineup_bans_who_rarely_played():
    got = _lineup(roster(games=[2] + [20] * 8))
    assert 0 not in set(got[got.role == "Starter"].player_id)


def test_cross_team_lines(spark):
    counts = ", ".join(f"0 as {c}" for c in K.COUNTS)
    base = f"player_id, 2001 as season, timestamp '2001-01-01' as game_ts, 10 as minutes, {counts}, team_id, game_id"
    lines = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12), (2, 2, 13), (3, 5, 14)], "player_id long, team_id long, game_id long").selectExpr(*base.split(", "))
    history = spark.createDataFrame([(1, 2001, 2)], "player_id long, season int, team_id long")
    kept, review = K.cross_team(lines, history)
    assert sorted(r.game_id for r in kept.collect()) == [11, 14]
    assert sorted(r.game_id for r in review.collect()) == [12, 13]


def test_cross_team_lines_without_counts(spark):
    """Null counts equal each other; a line of no team is no dispute, nor is one of a null day."""
    counts = ", ".join(f"cast(null as long) as {c}" for c in K.COUNTS)
    base = f"player_id, 2001 as season, game_ts, 10 as minutes, {counts}, team_id, game_id"
    rows = [(1, 1, 10, "2001-01-01"), (1, 2, 11, "2001-01-01"), (2, 1, 12, None), (2, 2, 13, None), (3, 5, 14, None), (4, None, 15, "2001-01-01"), (5, 1, 16, "2001-01-01"), (5, 2, 17, "2001-01-01")]
    lines = spark.createDataFrame(rows, "player_id long, team_id long, game_id long, game_ts string").selectExpr(*base.split(", "))
    history = spark.createDataFrame([(1, 2001, 2), (1, 2002, 1), (1, 2001, 2), (2, 2001, 1), (5, 2001, 1), (5, 2001, 2), (5, None, None)], "player_id long, season int, team_id long")
    kept, review = K.cross_team(lines, history)
    assert sorted(r.game_id for r in kept.collect()) == [11, 12, 14, 15]
    assert sorted(r.game_id for r in review.collect()) == [16, 17]


def plain_lineup(rows):
    """The search with loops over plain rows: {player: (role, score, minutes, ppg, tier, fallback)}."""
    if len(rows) < 5:
        return {}

    def z(name):
        values = [r[name] for r in rows]
        mean = sum(values) / len(values)
        deviation = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
        return [(v - mean) / (deviation or 1.0) for v in values]

    for r, a, b in zip(rows, z("avg_production"), z("score"), strict=True):
        r["opt"] = round(roles.PRODUCTION_SHARE * a + (1 - roles.PRODUCTION_SHARE) * b, 3)
    rows = sorted(rows, key=lambda r: (-r["opt"], r["player_id"]))
    games = int(rows[0]["team_games"] or 0)
    rates = [r["total_minutes"] / games if games else r["avg_minutes"] for r in rows]
    scale = 200.0 / sum(rates) if sum(rates) > 0 else 1.0
    for r, x in zip(rows, rates, strict=True):
        r["minutes"], r["ppg"] = round(x * scale, 1), round(r["per40_pts"] * x * scale / 40.0, 1)
    started = [r["ppg_actual"] for r in rows if r["games_started"] / max(1, games) >= roles.STARTER_SHARE]

    def beaten(r, bench):
        if games > 0 and r["games"] / games < roles.LEAST_GAMES:
            return roles.OUT_MINUTED + 1
        n = len([q for q in bench if q["avg_minutes"] > r["avg_minutes"]])
        return n if n > roles.OUT_MINUTED else 0

    for tier, (guards, forwards) in enumerate(roles.LINEUP_TIERS):
        banned, done, forced = [], False, True
        for _ in range(len(rows) + 1):
            five, forced = [], False
            for position, most in (("G", guards), ("F", forwards), (None, 5 - guards - forwards)):
                if position is None:
                    most = 5 - len(five)
                fit = [r for r in rows if position in (None, r["position"])]
                for r in [x for x in fit if x["player_id"] not in banned]:
                    if most > 0 and r not in five:
                        five.append(r)
                        most -= 1
                for r in fit:
                    if most > 0 and r not in five:
                        five.append(r)
                        most, forced = most - 1, True
            rest = [r for r in rows if r not in five]
            allowed = [r for r in rest if r["player_id"] not in banned]
            sixth = (allowed or rest or [None])[0]
            forced = forced or bool(rest and not allowed)
            worst, who = 0, None
            for r in sorted(five, key=lambda r: r["player_id"]):
                if beaten(r, rest) > worst:
                    worst, who = beaten(r, rest), r
            if sixth is not None and beaten(sixth, [r for r in rest if r is not sixth]) > worst:
                worst, who = beaten(sixth, [r for r in rest if r is not sixth]), sixth
            if who is None:
                done = True
                break
            if who["player_id"] in banned:
                break
            banned.append(who["player_id"])
        forced = forced if done else True
        if not started or sum(r["ppg"] for r in five) >= sum(started) - 0.05:
            break
    out = {}
    for r in rows:
        role = "Starter" if r in five else "Sixth Man" if r is sixth else "Role Player" if r["minutes"] >= roles.DEPTH_MINUTES else "Depth Piece"
        out[r["player_id"]] = (role, r["opt"], r["minutes"], r["ppg"], tier, forced)
    return out


def test_lineup_of_a_large_roster_is_quick_and_equal():
    """30,000 players, nearly all of whom are picked once and banned; small ones equal the loops."""
    rng = np.random.default_rng(8)

    def made(n):
        games = rng.integers(1, 30, n)
        minutes = rng.integers(1, 40, n).astype(float)
        starts = np.where(rng.random(n) < 0.2, games, 0)
        score = lambda: rng.permutation(n) + 0.5
        return roster(n=n, position=[("G", "F", "C", None)[i] for i in rng.integers(0, 4, n)], games=games, games_started=starts, avg_minutes=minutes, total_minutes=minutes * games, avg_production=score(), score=score())

    for n in (5, 6, 7, 12, 40, 90):
        for _ in range(6):
            frame = made(n)
            want = plain_lineup(frame.to_dict("records"))
            got = {r.player_id: (r.role, r.tier, r.fallback) for r in _lineup(frame).itertuples()}
            assert got == {k: (v[0], *v[4:]) for k, v in want.items()}
    began = time.process_time()
    assert (_lineup(made(30_000)).role == "Starter").sum() == 5
    assert time.process_time() - began < 20


def test_lineups_equal_plain_loops(spark):
    """q06 on the smallest tables, team by team."""
    star = Star(spark, SF).keep_lines()
    now = star.of_latest(star.lines)
    lines = now.collect()
    games = {}
    for r in lines:
        games.setdefault(r.team_id, set()).add(r.game_id)
    made = {}
    for r in lines:
        made.setdefault(r.player_id, []).append(r.points + r.rebounds + r.assists + r.steals + r.blocks - r.turnovers)
    teams = {}
    for r in models.current_players(star).filter("not thin_sample").collect():
        row = r.asDict() | {"avg_production": sum(made[r.player_id]) / len(made[r.player_id]), "team_games": -(-len(games[r.team_id]) // 12), "ppg_actual": r.ppg}
        teams.setdefault(r.team_id, []).append(row)
    want = {(t, p): v for t, rows in teams.items() for p, v in plain_lineup(rows).items()}
    got = {(r.team_id, r.player_id): (r.role, r.optimizer_score, r.minutes, r.ppg, r.tier, r.fallback) for r in models.lineups(star).collect()}
    assert set(got) == set(want) and len(want) > 20
    for k, v in want.items():
        assert got[k][0] == v[0] and got[k][4:] == v[4:], (k, got[k], v)
        assert got[k][1:4] == pytest.approx(v[1:4], abs=0.1001)
