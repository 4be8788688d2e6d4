"""What-if projections of players onto other teams, set-oriented.

The core takes rows of (player columns, current_rating, target_rating, std_rating,
minutes_override) and adds the projected line, its ranges and its confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions import model as M

COUNTS = {"ppg": "per40_pts", "rpg": "per40_reb", "apg": "per40_ast", "bpg": "per40_blk", "spg": "per40_stl", "topg": "per40_tov"}


class ProjectionError(ValueError):
    """A parameter that no projection can use."""


def check_minutes(minutes: float | None) -> None:
    if minutes is not None and not 0 <= minutes <= 40:
        raise ProjectionError("minutes_override must be between 0 and 40")


def project(rows: DataFrame) -> DataFrame:
    """Add the projection; all closed-form expressions, no shuffle."""
    std = F.col("std_rating")
    gap = F.col("target_rating") - F.col("current_rating")
    gap_std = F.when(std != 0, gap / std).otherwise(0.0)
    rows = rows.withColumns({"gap": gap, "gap_std": gap_std, "pf": M.production_factor(gap, std), "mf": M.minutes_factor(gap, std), "shift": M.score_shift(gap, std)})
    override = F.col("minutes_override")
    rows = rows.withColumn("extreme", M.extreme(F.col("gap_std"), F.col("class_year")))
    rows = rows.withColumn("confidence", M.confidence(F.col("games"), F.col("class_year"), F.col("extreme")))
    share = M.lookup(F.col("confidence"), M.RANGE_SHARE)
    low, high = M.MINUTES_BOUNDS
    spread = M.spread(F.col("gap_std"))
    at = {k: M.clamp(F.col("pf") * spread[k] / spread["median"], *M.PRODUCTION_BOUNDS) for k in ("p10", "p25", "p75", "p90")}
    rows = rows.withColumns({"share": share, **at}).withColumns({"mf_low": M.clamp(F.col("mf") - F.col("share") * (F.col("mf") - low), low, high), "mf_high": M.clamp(F.col("mf") + F.col("share") * (F.lit(high) - F.col("mf")), low, high)})

    def minutes(mf: str) -> Column:
        return F.coalesce(override, M.clamp(F.col("avg_minutes") * F.col(mf), 4.0, 36.0))

    def per_game(stat: str, pf: Column, m: Column) -> Column:
        factor = M.turnover_factor(pf) if stat == "topg" else pf
        return F.col(COUNTS[stat]) * factor * m / 40.0

    out = {"proj_minutes": F.round(minutes("mf"), 1)}
    for stat in COUNTS:
        out[f"proj_{stat}"] = F.round(per_game(stat, F.col("pf"), minutes("mf")), 1)
        for name, (a, b) in {"likely": ("p25", "p75"), "wide": ("p10", "p90")}.items():
            corners = [per_game(stat, F.col(p), minutes(m)) for p in (a, b) for m in ("mf_low", "mf_high")]
            out[f"{stat}_{name}_low"] = F.round(F.least(*corners), 1)
            out[f"{stat}_{name}_high"] = F.round(F.greatest(*corners), 1)
    for pct in ("ts_pct", "fg_pct", "tfg_pct"):
        out[f"proj_{pct}"] = F.round(M.clamp(F.col(pct) * F.col("pf"), *M.SHOOTING_BOUNDS) * 100, 1)
    raw = F.col("score_raw") + F.col("shift")
    out["proj_score"] = M.shown(raw)
    ends = [M.shown(raw - F.col("share") * (F.col("shift") - M.SHIFT_BOUNDS[0])), M.shown(raw + F.col("share") * (F.lit(M.SHIFT_BOUNDS[1]) - F.col("shift")))]
    out["score_low"], out["score_high"] = F.least(*ends), F.greatest(*ends)
    out["strength_gap"], out["gap_in_std"] = F.round("gap", 2) + 0.0, F.round("gap_std", 2) + 0.0
    return rows.withColumns(out)


def candidates(players: DataFrame, ratings: DataFrame, target_id: int, own: bool = False, minutes: float | None = None) -> DataFrame:
    """Players with the rating of their team, the target's and the league's deviation.

    ``ratings``: (team_id, rating) of one season; the target is one row.
    """
    check_minutes(minutes)
    league = ratings.agg(M.std_or_one(F.col("rating")).alias("std_rating"))
    target = ratings.filter(F.col("team_id") == target_id).select(F.col("rating").alias("target_rating"), F.col("team_id").alias("target_team_id"))
    got = players.join(ratings.select("team_id", F.col("rating").alias("current_rating")), "team_id").crossJoin(F.broadcast(target)).crossJoin(F.broadcast(league))
    got = got if own else got.filter(F.col("team_id") != target_id)
    return got.withColumn("minutes_override", F.lit(minutes).cast("double"))


def fits(projected: DataFrame, stats: list[str], limit: int) -> DataFrame:
    """Rank by the mean z of rounded projections in the pool; turnovers count down."""
    unknown = [s for s in stats if f"proj_{s}" not in projected.columns]
    if unknown:
        raise ProjectionError(f"unknown stats {unknown}")
    pool = projected.dropna(subset=[f"proj_{s}" for s in stats])
    stat = pool.agg(*[F.avg(f"proj_{s}").alias(f"m_{s}") for s in stats], *[M.std_or_one(F.col(f"proj_{s}")).alias(f"s_{s}") for s in stats])
    z = sum(((F.col(f"proj_{s}") - F.col(f"m_{s}")) / F.col(f"s_{s}") * (-1 if s == "topg" else 1) for s in stats), F.lit(0.0)) / len(stats)
    return pool.crossJoin(F.broadcast(stat)).withColumn("fit_score", F.round(z, 4)).orderBy(F.col("fit_score").desc(), "player_id").limit(limit)


def leaps(projected: DataFrame, limit: int, per_team: int = 2) -> DataFrame:
    """Largest gains in score, at most ``per_team`` a school, deterministic."""
    gain = F.round(F.col("proj_score") - F.col("score"), 1)
    w = Window.partitionBy("team_id").orderBy(F.col("gain").desc(), F.col("proj_score").desc(), "player_id")
    return projected.withColumn("gain", gain).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_team).orderBy(F.col("gain").desc(), F.col("proj_score").desc(), "player_id").limit(limit)


def batch(projected: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of requested players: unknown ones become errors, not failures."""
    return projected.join(requests, "player_id"), requests.join(projected, "player_id", "left_anti").withColumn("error", F.lit("no such player"))
