"""Team ratings: iterative offence and defence, schedules, bridge, sequential Elo."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions.model import std_or_one
from tipoff.operators.ordering import numbered
from tipoff.sources.shared import bucketed, written

RATED = "season int, team_id long, off_rating double, def_rating double, rating double, games long, iterations int, max_change double"


def unpivot(games: DataFrame, *more: str) -> DataFrame:
    """Two rows a game, one a side, with the season and ``more`` columns.  An OR join of teams and games would be a nested
    loop; this is one pass.  Games of a team against itself are left out."""
    side = lambda me, other, home: F.struct(F.col(f"{me}_team_id").alias("team_id"), F.col(f"{other}_team_id").alias("opponent_team_id"), F.col(f"{me}_score").alias("scored"), F.col(f"{other}_score").alias("allowed"), F.lit(home).alias("home"))
    played = games.filter("home_team_id <> away_team_id and home_score is not null and away_score is not null")
    return played.select(*more, "season", F.inline(F.array(side("home", "away", True), side("away", "home", False))))


def _solve(frame: pd.DataFrame, passes: int, tolerance: float, damping: float) -> pd.DataFrame:
    teams, code = np.unique(np.concatenate([frame.team_id, frame.opponent_team_id]), return_inverse=True)
    me, other = code[: len(frame)], code[len(frame) :]
    n = np.bincount(me, minlength=len(teams))
    scored, allowed = frame.scored.to_numpy(float), frame.allowed.to_numpy(float)
    mean = lambda x: np.bincount(me, x, len(teams)) / n
    off, de = mean(scored), mean(allowed)
    change, done = math.inf, 0
    while done < passes and change >= tolerance:
        new_off = mean(scored - de[other]) + de.mean()
        new_def = mean(allowed - off[other]) + off.mean()
        new_off, new_def = damping * off + (1 - damping) * new_off, damping * de + (1 - damping) * new_def
        change = float(max(np.abs(new_off - off).max(), np.abs(new_def - de).max()))
        off, de, done = new_off, new_def, done + 1
    return pd.DataFrame({"team_id": teams, "off_rating": off, "def_rating": de, "rating": off - de, "games": n, "iterations": done, "max_change": change if done else 0.0})


def solve_ratings(sides: DataFrame, passes: int = 200, tolerance: float = 1e-4, damping: float = 0.0, pool: str | None = None) -> DataFrame:
    """Iterative offence and defence of every season (and pool), each in one worker.

    A season has some ten thousand rows, so a group is bounded by nature; seasons
    run side by side.  Not every schedule converges: ``iterations`` and
    ``max_change`` tell.  ``damping`` is opt-in.
    """
    keys = ["season", *([pool] if pool else [])]
    schema = RATED if pool is None else RATED.replace("season int,", f"season int, {pool} string,")

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = _solve(frame, passes, tolerance, damping)
        for i, (name, value) in enumerate(zip(keys, key, strict=True)):
            out.insert(i, name, value)
        return out

    return sides.select(*keys, "team_id", "opponent_team_id", "scored", "allowed").groupBy(*keys).applyInPandas(solve, schema)


def solve_distributed(sides: DataFrame, passes: int = 200, tolerance: float = 1e-4, damping: float = 0.0, pool: str | None = None, every: int = 1) -> DataFrame:
    """``solve_ratings`` for pools beyond one worker: the same updates and the same end.

    Meetings of two teams are summed into one edge, bucketed by the opponent once; in a
    pass only the teams' state moves to the edges, and sums of what they say move back.  A
    pool ends with its own largest change under ``tolerance``: one maximum a pool goes to
    the driver after every ``every`` passes, where the state is written too, so that a lost
    executor costs these passes at most.
    """
    keys = ["season", *([pool] if pool else [])]
    edges = sides.groupBy(*keys, "team_id", "opponent_team_id").agg(F.count(F.lit(1)).alias("n"), F.sum("scored").cast("double").alias("scored"), F.sum("allowed").cast("double").alias("allowed"))
    edges = bucketed(edges, "edges", *keys, "opponent_team_id")
    sums = edges.groupBy(*keys, "team_id").agg(F.sum("n").alias("games"), F.sum("scored").alias("scored"), F.sum("allowed").alias("allowed"))
    state = written(sums.select(*keys, "team_id", "games", "scored", "allowed", (F.col("scored") / F.col("games")).alias("off"), (F.col("allowed") / F.col("games")).alias("de"), F.lit(0.0).alias("change"), F.lit(0).alias("iterations")), "state")
    ended = None
    done = 0
    while done < passes:
        for _ in range(min(every, passes - done)):
            state = _pass(state, edges, keys, damping)
            done += 1
        state = written(state, "state")
        moved = state.groupBy(*keys).agg(F.max("change").alias("most"))
        over = [r for r in moved.collect() if r["most"] < tolerance]  # a row a pool
        if over:
            still = " or ".join("(" + " and ".join(f"{k} = {r[k]!r}" for k in keys) + ")" for r in over)
            ended = state.filter(still) if ended is None else ended.unionByName(state.filter(still))
            state = state.filter(f"not ({still})")
            if not state.limit(1).count():
                break
    got = state if ended is None else ended.unionByName(state)
    most = got.groupBy(*keys).agg(F.max("change").alias("max_change"))
    return got.join(most, keys).select(*keys, "team_id", F.col("off").alias("off_rating"), F.col("de").alias("def_rating"), (F.col("off") - F.col("de")).alias("rating"), "games", "iterations", "max_change")


def _pass(state: DataFrame, edges: DataFrame, keys: list[str], damping: float) -> DataFrame:
    """The next state of all teams."""
    other = state.select(*keys, F.col("team_id").alias("opponent_team_id"), "off", "de")
    said = edges.join(other, [*keys, "opponent_team_id"]).groupBy(*keys, "team_id").agg(F.sum(F.col("n") * F.col("de")).alias("met_de"), F.sum(F.col("n") * F.col("off")).alias("met_off"))
    means = state.groupBy(*keys).agg(F.avg("off").alias("mean_off"), F.avg("de").alias("mean_de"))  # a row a pool
    new_off = damping * F.col("off") + (1 - damping) * ((F.col("scored") - F.col("met_de")) / F.col("games") + F.col("mean_de"))
    new_de = damping * F.col("de") + (1 - damping) * ((F.col("allowed") - F.col("met_off")) / F.col("games") + F.col("mean_off"))
    both = state.join(said, [*keys, "team_id"]).join(means, keys).withColumns({"new_off": new_off, "new_de": new_de})
    change = F.greatest(F.abs(F.col("new_off") - F.col("off")), F.abs(F.col("new_de") - F.col("de")))
    return both.select(*keys, "team_id", "games", "scored", "allowed", F.col("new_off").alias("off"), F.col("new_de").alias("de"), change.alias("change"), (F.col("iterations") + 1).alias("iterations"))


def schedule_strength(sides: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean rating of opponents: a game counts each time (sos), an opponent once."""
    other = ratings.select("season", F.col("team_id").alias("opponent_team_id"), F.col("rating").alias("o"))
    by_pair = sides.groupBy("season", "team_id", "opponent_team_id").agg(F.count(F.lit(1)).alias("n")).join(other, ["season", "opponent_team_id"])
    return by_pair.groupBy("season", "team_id").agg((F.sum(F.col("o") * F.col("n")) / F.sum("n")).alias("sos"), F.avg("o").alias("avg_opponent"), F.count(F.lit(1)).alias("opponents"))


def home_away(sides: DataFrame, ratings: DataFrame) -> DataFrame:
    """One pass with the season's ratings fixed, over home and over away games."""
    other = ratings.select("season", F.col("team_id").alias("opponent_team_id"), F.col("off_rating").alias("o"), F.col("def_rating").alias("d"))
    means = ratings.groupBy("season").agg(F.avg("off_rating").alias("mo"), F.avg("def_rating").alias("md"))
    value = (F.col("scored") - F.col("d")) - (F.col("allowed") - F.col("o"))
    pick = lambda flag: F.avg(F.when(F.col("home") == flag, value))
    return sides.join(other, ["season", "opponent_team_id"]).groupBy("season", "team_id").agg(pick(True).alias("h"), pick(False).alias("a")).join(means, "season").select("season", "team_id", (F.col("h") + F.col("md") - F.col("mo")).alias("home_rating"), (F.col("a") + F.col("md") - F.col("mo")).alias("away_rating"))


def bridge(sides: DataFrame, pool_ratings: DataFrame, pools: DataFrame, least: int = 10) -> DataFrame:
    """Shift between two pools from their crossover games: (season, shift, games).

    ``pools``: (team_id, division).  Rows are seen from the D1 side; the shift is
    null below ``least`` games.
    """
    mine = pools.select("team_id", F.col("division").alias("mine"))
    other = pools.select(F.col("team_id").alias("opponent_team_id"), F.col("division").alias("other"))
    cross = sides.join(mine, "team_id").join(other, "opponent_team_id").filter("mine = 'D1' and other = 'D2'")
    r1 = pool_ratings.select("season", "team_id", F.col("rating").alias("r1"))
    r2 = pool_ratings.select("season", F.col("team_id").alias("opponent_team_id"), F.col("rating").alias("r2"))
    gap = F.avg(F.col("r1") - F.col("r2") - (F.col("scored") - F.col("allowed")))
    return cross.join(r1, ["season", "team_id"]).join(r2, ["season", "opponent_team_id"]).groupBy("season").agg(F.when(F.count(F.lit(1)) >= least, gap).alias("shift"), F.count(F.lit(1)).alias("games"))


def league_rating(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("season").agg(F.avg("rating").alias("mean_rating"), std_or_one(F.col("rating")).alias("std_rating"))


def initial_rating(ratings: DataFrame) -> DataFrame:
    """Last season's rating of each team; null where it has none."""
    last = ratings.select((F.col("season") + 1).alias("season"), "team_id", F.col("rating").alias("initial_rating"))
    return ratings.join(last, ["season", "team_id"], "left").select("season", "team_id", "initial_rating", "rating")


ELO = "season int, team_id long, elo double, games long"


def elo(games: DataFrame, k: float = 32.0, epochs: int = 6, start: float = 1600.0) -> DataFrame:
    """Margin-aware Elo in game order, epoch by epoch; needs ``game_order``.

    Sequential by nature: one worker a season, its games sorted there.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("game_order", kind="stable")
        rows = list(zip(frame.home_team_id.tolist(), frame.away_team_id.tolist(), frame.home_score.tolist(), frame.away_score.tolist(), strict=True))
        rating: dict[int, float] = {}
        played: dict[int, int] = {}
        for epoch in range(epochs):
            for home, away, hs, as_ in rows:
                a, b = rating.setdefault(home, start), rating.setdefault(away, start)
                actual = 1.0 if hs > as_ else 0.0 if hs < as_ else 0.5
                expected = 1 / (1 + 10 ** ((b - a) / 400))
                change = k / (epoch + 1) * (math.log(abs(hs - as_) + 1) + 1) * (actual - expected)
                rating[home], rating[away] = a + change, b - change
                if not epoch:
                    played[home], played[away] = played.get(home, 0) + 1, played.get(away, 0) + 1
        return pd.DataFrame({"season": key[0], "team_id": list(rating), "elo": list(rating.values()), "games": [played[t] for t in rating]})

    return games.groupBy("season").applyInPandas(run, ELO)


def elo_waves(games: DataFrame, k: float = 32.0, epochs: int = 6, start: float = 1600.0, together: int = 8) -> DataFrame:
    """``elo`` in waves, for seasons beyond one worker: the same numbers.

    A game can be played when it is the next one of both teams; such games have no team in
    common and form a wave.  Each team knows its own games by turn, bucketed once; a wave
    looks up every team's next game, plays those that both teams stand before, and moves
    nothing but the teams' state, one row a team.  ``together`` waves go between two writes.
    """
    side = lambda me, home: F.struct(F.col(f"{me}_team_id").alias("team_id"), F.lit(home).alias("home"), (F.col("home_score") - F.col("away_score")).alias("margin"))
    own = games.select("season", "game_order", F.inline(F.array(side("home", True), side("away", False))))
    turn = F.row_number().over(Window.partitionBy("season", "team_id").orderBy("game_order")) - 1
    turns = bucketed(own.withColumn("turn", turn), "turns", "season", "team_id")
    state = turns.groupBy("season", "team_id").agg(F.count(F.lit(1)).alias("games")).withColumns({"elo": F.lit(start).cast("double"), "played": F.lit(0).cast("long")})
    state = written(state, "elo_state")
    while state.filter(F.col("played") < F.col("games") * epochs).limit(1).count():
        for _ in range(together):
            state = _wave(state, turns, k, epochs)
        state = written(state, "elo_state")
    return state.select("season", "team_id", "elo", "games")


def _wave(state: DataFrame, turns: DataFrame, k: float, epochs: int) -> DataFrame:
    """The state after one wave."""
    epoch = F.floor(F.col("played") / F.col("games"))
    ahead = state.filter(F.col("played") < F.col("games") * epochs).withColumns({"epoch": epoch, "next": F.col("played") % F.col("games")})
    step = ahead.join(turns, ["season", "team_id"]).filter("turn = next")
    pick = lambda home, c: F.max(F.when(F.col("home") == home, F.col(c)))
    met = step.groupBy("season", "game_order", "epoch", "margin").agg(F.count(F.lit(1)).alias("sides"), *[pick(h, c).alias(f"{c}_{h}".lower()) for h in (True, False) for c in ("team_id", "elo")]).filter("sides = 2")
    actual = F.when(F.col("margin") > 0, 1.0).when(F.col("margin") < 0, 0.0).otherwise(0.5)
    expected = 1 / (1 + F.pow(F.lit(10.0), (F.col("elo_false") - F.col("elo_true")) / 400))
    change = k / (F.col("epoch") + 1) * (F.log(F.abs(F.col("margin")) + 1.0) + 1) * (actual - expected)
    moved = met.withColumn("change", change).select("season", F.inline(F.array(F.struct(F.col("team_id_true").alias("team_id"), F.col("change").alias("change")), F.struct(F.col("team_id_false").alias("team_id"), (-F.col("change")).alias("change")))))
    return state.join(moved, ["season", "team_id"], "left").select("season", "team_id", "games", (F.col("elo") + F.coalesce("change", F.lit(0.0))).alias("elo"), (F.col("played") + F.when(F.col("change").isNotNull(), 1).otherwise(0)).alias("played"))


def ranked(ratings: DataFrame) -> DataFrame:
    """Net rank over the whole season, before any filter."""
    return numbered(ratings, ["season"], [F.col("rating").desc(), F.col("team_id").asc()], "net_rank")
