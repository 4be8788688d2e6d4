"""Scalar model functions: column to column, no Python on the executors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model: weights, bounds and the transfer spread table.
ROLE_WEIGHTS = {
    "PG": {"pts": 1.0, "fgm": 0.4, "fga": -0.7, "ftmiss": -0.4, "oreb": 0.4, "dreb": 0.30, "ast": 1.10, "stl": 1.10, "blk": 0.40, "tov": -1.10, "pf": -0.30},
    "SG": {"pts": 1.0, "fgm": 0.4, "fga": -0.7, "ftmiss": -0.4, "oreb": 0.5, "dreb": 0.35, "ast": 0.80, "stl": 0.90, "blk": 0.40, "tov": -1.00, "pf": -0.30},
    "WING": {"pts": 1.0, "fgm": 0.4, "fga": -0.7, "ftmiss": -0.4, "oreb": 0.6, "dreb": 0.45, "ast": 0.70, "stl": 0.85, "blk": 0.55, "tov": -0.90, "pf": -0.30},
    "FORWARD": {"pts": 1.0, "fgm": 0.4, "fga": -0.7, "ftmiss": -0.4, "oreb": 0.8, "dreb": 0.55, "ast": 0.50, "stl": 0.70, "blk": 0.75, "tov": -0.80, "pf": -0.35},
    "CENTER": {"pts": 1.0, "fgm": 0.4, "fga": -0.7, "ftmiss": -0.4, "oreb": 1.0, "dreb": 0.65, "ast": 0.35, "stl": 0.55, "blk": 1.00, "tov": -0.70, "pf": -0.40},
}
BUCKET_OF = {"G": "GUARD", "PG": "GUARD", "SG": "GUARD", "F": "FORWARD", "SF": "FORWARD", "PF": "FORWARD", "ATH": "FORWARD", "C": "CENTER"}
EXPERIENCE = {"FR": 1.03, "SO": 1.015, "JR": 1.0, "SR": 1.0, "GR": 0.995}
SPREAD = (
    (-2.0, 0.92, 1.05, 1.26, 1.47, 1.92),
    (-1.5, 0.87, 1.00, 1.38, 1.66, 2.06),
    (-1.0, 0.85, 0.99, 1.18, 1.51, 1.91),
    (-0.5, 0.79, 0.98, 1.14, 1.45, 1.86),
    (0.0, 0.69, 0.83, 0.99, 1.27, 1.59),
    (0.5, 0.66, 0.81, 0.98, 1.18, 1.44),
    (1.0, 0.56, 0.70, 0.84, 1.04, 1.24),
    (1.5, 0.53, 0.66, 0.81, 0.94, 1.15),
    (2.0, 0.56, 0.69, 0.74, 1.00, 1.14),
)
PRODUCTION_BOUNDS, MINUTES_BOUNDS, SHIFT_BOUNDS, SHOOTING_BOUNDS = (0.65, 1.45), (0.55, 1.10), (-10.0, 6.0), (0.20, 0.80)
RANGE_SHARE = {"High": 0.35, "Medium": 0.55, "Low": 0.80}
HIGH_CONFERENCES = ("ACC", "Big 10", "SEC", "Big 12", "Big East")
MID_CONFERENCES = ("American", "Atlantic 10", "MWC", "WCC", "Coastal", "MVC")
OUTLIER_PROGRAMS = ("Gonzaga", "South Dakota State", "Princeton", "Florida Gulf Coast")

STATS = ("pts", "fgm", "fga", "ftmiss", "reb", "ast", "stl", "blk", "tov", "pf")


def bucket_weights() -> dict[str, dict[str, float]]:
    """Three position buckets, each the mean of its roles, and their mean for all others."""

    def mean_of(*roles: str) -> dict[str, float]:
        rows = [ROLE_WEIGHTS[r] | {"reb": (ROLE_WEIGHTS[r]["oreb"] + ROLE_WEIGHTS[r]["dreb"]) / 2.0} for r in roles]
        return {s: sum(r[s] for r in rows) / len(rows) for s in STATS}

    out = {"GUARD": mean_of("PG", "SG"), "FORWARD": mean_of("WING", "FORWARD"), "CENTER": mean_of("CENTER")}
    out["ALL"] = {s: sum(out[b][s] for b in ("GUARD", "FORWARD", "CENTER")) / 3.0 for s in STATS}
    return out


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    """Between the bounds; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def per40_scale(minutes: Column) -> Column:
    return F.lit(40.0) / F.greatest(minutes, F.lit(10)).cast("double")


def logistic(x: Column, bound: float | None = None) -> Column:
    x = clamp(x, -bound, bound) if bound else x
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bucket(position: Column) -> Column:
    return lookup(position, BUCKET_OF, "ALL")


def composite(bucket_col: Column, stats: Mapping[str, Column]) -> Column:
    """Weighted sum of a game's counts, by position bucket."""
    out = None
    for name, weights in bucket_weights().items():
        total = sum((stats[s] * F.lit(weights[s]) for s in STATS[1:]), stats["pts"] * F.lit(weights["pts"]))
        out = total if out is None else F.when(bucket_col == name, total).otherwise(out)
    return out


def close_game_weight(margin: Column) -> Column:
    m = F.abs(margin)
    return F.when(margin.isNull() | (m <= 12), 1.0).otherwise(clamp(F.lit(1.0) - (m - 12) / 18.0, 0.25, 1.0))


def reliability(minutes: Column) -> Column:
    return clamp(minutes / 15.0, 0.3, 1.0)


def opponent_factor(rating: Column, mean: Column, std: Column) -> Column:
    scale = F.when(std * 2 == 0, 1.0).otherwise(std * 2)
    return clamp(F.lit(1.0) + (F.coalesce(rating, mean) - mean) / scale, 0.55, 1.6)


def score_curve(z: Column) -> Column:
    """Saturating score around 60, within 30 and 99, before rounding."""
    return F.lit(60.0) + F.when(z >= 0, 39.0).otherwise(30.0) * F.tanh(z / 1.5)


def old_score_curve(z: Column) -> Column:
    """The superseded curve: linear, with a square on top above the mean."""
    over = F.greatest(z, F.lit(0.0))
    return F.lit(60.0) + z * 12 + over * over * 3


def shown(score: Column) -> Column:
    return F.round(clamp(score, 30.0, 99.0), 1)


def true_shooting(points: Column, fga: Column, fta: Column, least: int = 15) -> Column:
    return F.when(fga >= least, points / (2 * (fga + F.lit(0.44) * fta)))


def made_share(made: Column, tried: Column, least: int = 15) -> Column:
    return F.when(tried >= least, made / tried)


def production(points: Column, rebounds: Column, assists: Column, steals: Column, blocks: Column, turnovers: Column) -> Column:
    return points + rebounds + assists + steals + blocks - turnovers


def classify_tier(name: Column, conference: Column, outliers: bool = True) -> Column:
    high = conference.isin(*HIGH_CONFERENCES)
    high = name.isin(*OUTLIER_PROGRAMS) | high if outliers else high
    return F.when(high, "High-Major").when(conference.isin(*MID_CONFERENCES), "Mid-Major").otherwise("Low-Major")


def normal_tier(tier: Column) -> Column:
    return F.when(tier == "P5", "High-Major").otherwise(tier)


def spread(gap_std: Column) -> dict[str, Column]:
    """Percentiles of what transfers over such a gap kept, between the table's centres."""
    g = clamp(gap_std, SPREAD[0][0], SPREAD[-1][0])
    out = {}
    for k, name in enumerate(("p10", "p25", "median", "p75", "p90"), 1):
        value = F.lit(SPREAD[-1][k])
        for low, high in reversed(list(zip(SPREAD, SPREAD[1:], strict=False))):
            value = F.when(g <= high[0], F.lit(low[k]) + (F.lit(high[k]) - F.lit(low[k])) * (g - low[0]) / (high[0] - low[0])).otherwise(value)
        out[name] = F.when(g.isNotNull(), value)
    return out


def production_factor(gap: Column, std: Column) -> Column:
    return clamp(F.lit(1.06) - gap / (std * 5.85), *PRODUCTION_BOUNDS)


def minutes_factor(gap: Column, std: Column) -> Column:
    return clamp(F.lit(1.0) - gap / (std * 6.4), *MINUTES_BOUNDS)


def score_shift(gap: Column, std: Column) -> Column:
    return clamp(-gap / (std * 0.8), *SHIFT_BOUNDS)


def turnover_factor(factor: Column) -> Column:
    return F.lit(2 * 1.06) - factor


def extreme(gap_std: Column, class_year: Column) -> Column:
    return F.abs(gap_std) >= F.when(class_year.isin("FR", "SO"), 1.25).otherwise(2.0)


def confidence(games: Column, class_year: Column, is_extreme: Column) -> Column:
    level = F.when(games >= 20, 2).when(games >= 10, 1).otherwise(0)
    level = F.when(class_year.isin("FR", "SO"), F.greatest(F.lit(0), level - 1)).otherwise(level)
    level = F.when(is_extreme & (level == 2), 1).otherwise(level)
    return F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), level + 1)


def trend(delta: Column) -> Column:
    return F.when(delta.isNull(), "Insufficient data").when(delta >= 3, "Improving").when(delta <= -3, "Declining").otherwise("Stable")


def gap_bucket(gap_std: Column) -> Column:
    """Nearest half, ties to even, within three either way."""
    return clamp(F.bround(gap_std / 0.5, 0) * 0.5, -3.0, 3.0)


def old_transfer(gap: Column, tempo_ratio: Column, minutes: Column) -> dict[str, Column]:
    """The prototype's transfer factors."""
    factor = clamp(F.lit(1.0) - gap / 2500, 0.70, 1.12) * tempo_ratio
    mins = minutes * clamp(F.lit(1.0) - gap / 3200, 0.55, 1.05)
    return {"production": factor, "minutes": mins, "shift": clamp(-gap / 400, -6.0, 3.0), "starter": logistic((mins - 21) / 4, 50)}


def std_or_one(x: Column) -> Column:
    """Population deviation, 1 where it is 0 or there is no row."""
    return F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0))


def first_text(*columns: Column) -> Column:
    """First of several columns that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def three_state(x: Column) -> Column:
    """Yes, no or unknown."""
    v = F.lower(F.trim(x.cast("string")))
    return F.when(v.isin("yes", "y", "true", "1"), True).when(v.isin("no", "n", "false", "0"), False)


def started_flag(x: Column) -> Column:
    return F.when(F.lower(F.trim(x.cast("string"))).isin("yes", "y", "true"), 1).otherwise(0)


def winner(home: Column, away: Column, home_score: Column, away_score: Column, known: Column) -> Column:
    """The named winner, else the side with more points; none for a tie."""
    return F.coalesce(known, F.when(home_score > away_score, home).when(away_score > home_score, away))
