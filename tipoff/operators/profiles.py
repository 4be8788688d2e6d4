"""Season and team profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.functions import model as M
from tipoff.operators.ordering import numbered

TOTALS = {"points": "pts", "rebounds": "reb", "assists": "ast", "blocks": "blk", "steals": "stl", "turnovers": "tov"}
CATEGORIES = (*[f"per40_{s}" for s in TOTALS.values()], "ts_pct", "fg_pct", "tfg_pct")


def latest_season(lines: DataFrame) -> DataFrame:
    """One row: the season with the most lines; of equals the last."""
    return lines.groupBy("season").count().orderBy(F.col("count").desc(), F.col("season").desc()).limit(1).select("season")


def season_totals(lines: DataFrame) -> DataFrame:
    """Totals and rates of every player and season, in one aggregate.

    Minutes are floored at one before any use; shooting shares need 15 attempts.
    """
    total = lambda c: F.sum(c).cast("long")
    floored = F.greatest(F.col("minutes"), F.lit(1))
    sums = lines.groupBy("player_id", "season").agg(
        F.count(F.lit(1)).alias("games"),
        total(floored).alias("total_minutes"),
        total("started").alias("games_started"),
        *[total(c).alias(f"sum_{s}") for c, s in TOTALS.items()],
        *[total(c).alias(f"sum_{c}") for c in ("fga", "fgm", "tfga", "tfgm", "fta", "ftm")],
    )
    minutes, games = F.col("total_minutes"), F.col("games")
    return sums.select(
        "player_id", "season", "games", "total_minutes", "games_started",
        (minutes / games).alias("avg_minutes"),
        *[(F.col(f"sum_{s}") / games).alias(n) for s, n in (("pts", "ppg"), ("reb", "rpg"), ("ast", "apg"), ("blk", "bpg"), ("stl", "spg"), ("tov", "topg"))],
        *[(F.col(f"sum_{s}") / minutes * 40).alias(f"per40_{s}") for s in TOTALS.values()],
        M.true_shooting(F.col("sum_pts"), F.col("sum_fga"), F.col("sum_fta")).alias("ts_pct"),
        M.made_share(F.col("sum_fgm"), F.col("sum_fga")).alias("fg_pct"),
        M.made_share(F.col("sum_tfgm"), F.col("sum_tfga")).alias("tfg_pct"),
        ((games < 3) | (minutes < 40)).alias("thin_sample"),
        *[f"sum_{s}" for s in TOTALS.values()], "sum_fga", "sum_fgm", "sum_tfga", "sum_tfgm", "sum_fta", "sum_ftm",
    )


def season_scores(lines: DataFrame, players: DataFrame, games: DataFrame, ratings: DataFrame) -> DataFrame:
    """(player_id, season, raw, score_raw, score): weighted mean of adjusted game values.

    A game's composite per 40 minutes is scaled by the opponent's rating, weighted by
    closeness and minutes, then set against its season's pool on the score curve.
    """
    rated = ratings.select("season", F.col("team_id").alias("opponent_team_id"), "rating")
    league = ratings.groupBy("season").agg(F.avg("rating").alias("league_mean"), M.std_or_one(F.col("rating")).alias("league_std"))
    margin = games.select("season", F.col("home_team_id").alias("team_id"), F.col("away_team_id").alias("opponent_team_id"), (F.col("home_score") - F.col("away_score")).alias("margin"))
    who = players.select("player_id", "position", "class_year")
    joined = lines.join(who, "player_id").join(rated, ["season", "opponent_team_id"], "left").join(league, "season").join(margin, ["season", "team_id", "opponent_team_id"], "left")
    minutes = F.greatest(F.col("minutes"), F.lit(1))
    stats = {"pts": "points", "fgm": "fgm", "fga": "fga", "reb": "rebounds", "ast": "assists", "stl": "steals", "blk": "blocks", "tov": "turnovers", "pf": "fouls"}
    columns = {k: F.col(v) for k, v in stats.items()} | {"ftmiss": F.col("fta") - F.col("ftm")}
    value = M.composite(M.bucket(F.col("position")), columns) * M.per40_scale(minutes) * M.opponent_factor(F.col("rating"), F.col("league_mean"), F.col("league_std"))
    weight = M.close_game_weight(F.col("margin")) * M.reliability(minutes)
    mean = joined.select("player_id", "season", "class_year", value.alias("v"), weight.alias("w")).groupBy("player_id", "season", "class_year").agg(F.when(F.sum("w") > 0, F.sum(F.col("v") * F.col("w")) / F.sum("w")).otherwise(F.avg("v")).alias("mean"))
    raw = mean.select("player_id", "season", F.round(F.col("mean") * M.lookup(F.col("class_year"), M.EXPERIENCE, 1.0), 8).alias("raw"))
    pool = raw.groupBy("season").agg(F.avg("raw").alias("m"), M.std_or_one(F.col("raw")).alias("s"))
    return raw.join(pool, "season").select("player_id", "season", "raw", M.score_curve((F.col("raw") - F.col("m")) / F.col("s")).alias("score_raw")).withColumn("score", M.shown(F.col("score_raw")))


def team_games(lines: DataFrame) -> DataFrame:
    return lines.groupBy("season", "team_id").agg(F.countDistinct("game_id").alias("team_games"))


def team_profiles(totals: DataFrame, players: DataFrame, games_played: DataFrame) -> DataFrame:
    """Roster totals as rates of a team and season; only teams with games."""
    sums = totals.join(players.select("player_id", "team_id"), "player_id").groupBy("season", "team_id").agg(
        F.count(F.lit(1)).alias("roster_size"), *[F.sum(c).alias(c) for c in ("total_minutes", *[f"sum_{s}" for s in TOTALS.values()], "sum_fga", "sum_fgm", "sum_tfga", "sum_tfgm", "sum_fta")]
    )
    got = sums.join(games_played.filter("team_games > 0"), ["season", "team_id"])
    return got.select(
        "season", "team_id", "roster_size", "team_games",
        *[(F.col(f"sum_{s}") / F.col("team_games")).alias(f"per40_{s}") for s in TOTALS.values()],
        M.true_shooting(F.col("sum_pts"), F.col("sum_fga"), F.col("sum_fta"), 1).alias("ts_pct"),
        M.made_share(F.col("sum_fgm"), F.col("sum_fga"), 1).alias("fg_pct"),
        M.made_share(F.col("sum_tfgm"), F.col("sum_tfga"), 1).alias("tfg_pct"),
    )


def long_profile(profiles: DataFrame, *keys: str) -> DataFrame:
    """One row a category, in fixed order."""
    pairs = ", ".join(f"'{c}', {c}" for c in CATEGORIES)
    return profiles.select(*keys, F.expr(f"stack({len(CATEGORIES)}, {pairs}) as (category, value)"))


def category_stats(long: DataFrame, *keys: str) -> DataFrame:
    """Mean and population deviation of each category."""
    return long.groupBy(*keys, "category").agg(F.avg("value").alias("mean"), M.std_or_one(F.col("value")).alias("std"), F.count("value").alias("teams"))


def ranks(scores: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """Overall rank and rank in the division, by score, of every season."""
    got = scores.join(players.select("player_id", "team_id"), "player_id").join(teams.select("team_id", "division"), "team_id")
    order = [F.round("score_raw", 6).desc(), F.col("player_id").asc()]
    overall = numbered(got, ["season"], order, "overall_rank")
    return numbered(overall, ["season", "division"], order, "division_rank").select("player_id", "season", "division", "score", "overall_rank", "division_rank")
