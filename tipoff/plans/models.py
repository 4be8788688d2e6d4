"""Ratings, profiles, roles, projections: the model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions import model as M
from tipoff.operators import profiles as P
from tipoff.operators import projection as J
from tipoff.operators import ratings as R
from tipoff.operators import roles as O
from tipoff.operators.ordering import percentiles, value_ranks
from tipoff.plans.boards import rate
from tipoff.plans.registry import query
from tipoff.sources.star import ORACLE, Star

#: Fixed passes in both engines: stopping early depends on the engine's rounding.
PASSES = 6

RATINGS = (
    ORACLE.replace("with teams as", "with recursive teams as")
    + f""", mean0 as (select season, team_id, avg(scored) as off, avg(allowed) as de, count(*) as games from sides where team_id <> opponent_team_id group by 1, 2),
solve(i, season, team_id, off, de) as (
  select 0, season, team_id, off, de from mean0
  union all
  select any_value(p.i) + 1, e.season, e.team_id, avg(e.scored - p.de) + any_value(m.md), avg(e.allowed - p.off) + any_value(m.mo)
  from sides e join solve p on e.opponent_team_id = p.team_id and e.season = p.season join (select season, avg(de) as md, avg(off) as mo from solve group by season) m on m.season = e.season
  where p.i < {PASSES} group by e.season, e.team_id),
ratings as (select season, team_id, off as off_rating, de as def_rating, off - de as rating from solve where i = {PASSES}),
league as (select season, avg(rating) as mean_rating, coalesce(nullif(stddev_pop(rating), 0), 1.0) as std_rating from ratings group by season)
"""
)


CURRENT_RATINGS = ", cr as (select team_id, round(rating, 3) + 0.0 as rating from ratings where season = (select season from current))"


def solved(s: Star) -> DataFrame:
    """A row a team and season; its users would each run the solver again."""
    return s.once("ratings", lambda: R.solve_ratings(R.unpivot(s.games), passes=PASSES, tolerance=0.0))


@query("r01_ratings", "select season, team_id, round(off_rating, 3) + 0.0 as off_rating, round(def_rating, 3) + 0.0 as def_rating, round(rating, 3) + 0.0 as rating from ratings", RATINGS)
def ratings(s: Star) -> DataFrame:
    return solved(s).select("season", "team_id", *[(F.round(c, 3) + 0.0).alias(c) for c in ("off_rating", "def_rating", "rating")])


@query("r01_distributed", "select season, team_id, round(off_rating, 3) + 0.0 as off_rating, round(def_rating, 3) + 0.0 as def_rating, round(rating, 3) + 0.0 as rating from ratings", RATINGS, keep=True)
def ratings_distributed(s: Star) -> DataFrame:
    """R01 for pools of any size, as joins."""
    got = R.solve_distributed(R.unpivot(s.games), passes=PASSES, tolerance=0.0, every=3)
    return got.select("season", "team_id", *[(F.round(c, 3) + 0.0).alias(c) for c in ("off_rating", "def_rating", "rating")])


@query("r02_schedule", ", p as (select season, team_id, opponent_team_id, count(*) as n from sides group by 1, 2, 3) select p.season, p.team_id, round(sum(r.rating * n) / sum(n), 3) + 0.0 as sos, round(avg(r.rating), 3) + 0.0 as avg_opponent, count(*) as opponents from p join ratings r on r.season = p.season and r.team_id = opponent_team_id group by 1, 2", RATINGS)
def schedule(s: Star) -> DataFrame:
    """R02, R03."""
    got = R.schedule_strength(R.unpivot(s.games), solved(s))
    return got.select("season", "team_id", (F.round("sos", 3) + 0.0).alias("sos"), (F.round("avg_opponent", 3) + 0.0).alias("avg_opponent"), "opponents")


@query(
    "r04_home_away",
    ", m as (select season, avg(off_rating) as mo, avg(def_rating) as md from ratings group by season), v as (select s.season, s.team_id, home, avg(scored - r.def_rating) - avg(allowed - r.off_rating) as v from sides s join ratings r on r.season = s.season and r.team_id = s.opponent_team_id group by 1, 2, 3) select season, team_id, round(max(v) filter (home) + any_value(md) - any_value(mo), 3) + 0.0 as home_rating, round(max(v) filter (not home) + any_value(md) - any_value(mo), 3) + 0.0 as away_rating from v join m using (season) group by 1, 2",
    RATINGS,
)
def home_away(s: Star) -> DataFrame:
    got = R.home_away(R.unpivot(s.games), solved(s))
    return got.select("season", "team_id", (F.round("home_rating", 3) + 0.0).alias("home_rating"), (F.round("away_rating", 3) + 0.0).alias("away_rating"))


@query("r06_bridge", ", x as (select s.season, r1.rating - r2.rating - (scored - allowed) as gap from sides s join teams a using (team_id) join teams b on b.team_id = s.opponent_team_id join ratings r1 on r1.season = s.season and r1.team_id = s.team_id join ratings r2 on r2.season = s.season and r2.team_id = s.opponent_team_id where a.division = 'D1' and b.division = 'D2') select season, case when count(*) >= 10 then round(avg(gap), 3) + 0.0 end as shift, count(*) as games from x group by season", RATINGS)
def bridge(s: Star) -> DataFrame:
    """R06 with the pooled ratings; R05's separate pools are r05_pools."""
    return R.bridge(R.unpivot(s.games), solved(s), s.teams).select("season", (F.round("shift", 3) + 0.0).alias("shift"), "games")


POOLS = (
    ORACLE.replace("with teams as", "with recursive teams as")
    + f""", tiers as (select s.*, a.division as pool, b.division as other from sides s join teams a using (team_id) join teams b on b.team_id = s.opponent_team_id),
own as (select * from tiers where pool = other),
solve(i, season, pool, team_id, off, de) as (
  select 0, season, pool, team_id, avg(scored), avg(allowed) from own where team_id <> opponent_team_id group by 2, 3, 4
  union all
  select any_value(p.i) + 1, e.season, e.pool, e.team_id, avg(e.scored - p.de) + any_value(m.md), avg(e.allowed - p.off) + any_value(m.mo)
  from own e join solve p on e.opponent_team_id = p.team_id and e.season = p.season join (select season, pool, avg(de) as md, avg(off) as mo from solve group by 1, 2) m on m.season = e.season and m.pool = e.pool
  where p.i < {PASSES} group by e.season, e.pool, e.team_id),
alone as (select season, pool, team_id, off - de as rating from solve where i = {PASSES}),
shifts as (select b.season, case when count(*) >= 10 then avg(x.rating - y.rating - (scored - allowed)) end as shift from tiers b join alone x on x.season = b.season and x.team_id = b.team_id join alone y on y.season = b.season and y.team_id = b.opponent_team_id where b.pool = 'D1' and b.other = 'D2' group by 1)
select season, pool, team_id, round(rating, 3) + 0.0 as rating, round(case when pool = 'D2' then rating + shift else rating end, 3) as combined from alone join shifts using (season)"""
)


@query("r05_pools", POOLS, "")
def pools(s: Star) -> DataFrame:
    """Each division solved alone, D2 lifted by the crossover shift."""
    teams = s.teams.select("team_id", F.col("division").alias("pool"))
    other = s.teams.select(F.col("team_id").alias("opponent_team_id"), F.col("division").alias("other"))
    sides = R.unpivot(s.games).join(teams, "team_id").join(other, "opponent_team_id")
    alone = s.once("pools", lambda: R.solve_ratings(sides.filter("pool = other"), passes=PASSES, tolerance=0.0, pool="pool"))
    shift = R.bridge(R.unpivot(s.games), alone, s.teams).select("season", "shift")
    return alone.join(shift, "season").select("season", "pool", "team_id", (F.round("rating", 3) + 0.0).alias("rating"), F.round(F.when(F.col("pool") == "D2", F.col("rating") + F.col("shift")).otherwise(F.col("rating")), 3).alias("combined"))


@query("r07_elo")
def elo(s: Star) -> DataFrame:
    """Order-dependent, so rows only; tests hold it against a plain loop."""
    ordered = s.games.withColumn("game_order", F.col("home_team_id") * 1000 + F.col("away_team_id"))
    return R.elo(ordered).select("season", "team_id", F.round("elo", 4).alias("elo"), "games")


@query("r08_initial", "select r.season, r.team_id, round(b.rating, 3) + 0.0 as initial_rating, round(r.rating, 3) + 0.0 as rating from ratings r left join ratings b on b.team_id = r.team_id and b.season = r.season - 1", RATINGS)
def initial(s: Star) -> DataFrame:
    return R.initial_rating(solved(s)).select("season", "team_id", (F.round("initial_rating", 3) + 0.0).alias("initial_rating"), (F.round("rating", 3) + 0.0).alias("rating"))


@query("r09_league", "select season, round(mean_rating, 3) + 0.0 as mean_rating, round(std_rating, 3) + 0.0 as std_rating from league", RATINGS)
def league(s: Star) -> DataFrame:
    return R.league_rating(solved(s)).select("season", (F.round("mean_rating", 3) + 0.0).alias("mean_rating"), (F.round("std_rating", 3) + 0.0).alias("std_rating"))


@query("w04_net_rank", ", k as (select season, team_id, row_number() over (partition by season order by round(rating, 3) desc, team_id) as net_rank from ratings) select season, team_id, t.name, cast(net_rank as int) as net_rank from k join teams t using (team_id) where t.tier = 'Mid-Major'", RATINGS)
def net_rank(s: Star) -> DataFrame:
    """Ranked over the league, then filtered."""
    ranked = R.ranked(solved(s).withColumn("rating", F.round("rating", 3)))
    return ranked.join(s.teams.filter("tier = 'Mid-Major'").select("team_id", "name"), "team_id").select("season", "team_id", "name", F.col("net_rank").cast("int").alias("net_rank"))


# -- profiles ----------------------------------------------------------------------

TOTALS = """, tot as (select player_id, season, count(*) as games, cast(sum(greatest(minutes, 1)) as bigint) as total_minutes, cast(sum(started) as bigint) as games_started,
 sum(points) as pts, sum(rebounds) as reb, sum(assists) as ast, sum(blocks) as blk, sum(steals) as stl, sum(turnovers) as tov, sum(fga) as fga, sum(fgm) as fgm, sum(tfga) as tfga, sum(tfgm) as tfgm, sum(fta) as fta from lines group by 1, 2),
prof as (select player_id, season, games, total_minutes, games_started, total_minutes / games as avg_minutes, pts / games as ppg, reb / games as rpg, ast / games as apg, blk / games as bpg, stl / games as spg, tov / games as topg,
 pts / total_minutes * 40 as per40_pts, reb / total_minutes * 40 as per40_reb, ast / total_minutes * 40 as per40_ast, blk / total_minutes * 40 as per40_blk, stl / total_minutes * 40 as per40_stl, tov / total_minutes * 40 as per40_tov,
 case when fga >= 15 then pts / (2 * (fga + 0.44::double * fta)) end as ts_pct, case when fga >= 15 then fgm / fga end as fg_pct, case when tfga >= 15 then tfgm / tfga end as tfg_pct, games < 3 or total_minutes < 40 as thin_sample, pts, reb, ast, blk, stl, tov, fga, fgm, tfga, tfgm, fta from tot)
"""
PROFILE_COLUMNS = ("avg_minutes", "ppg", "rpg", "apg", "bpg", "spg", "topg", "per40_pts", "per40_reb", "per40_ast", "per40_blk", "per40_stl", "per40_tov", "ts_pct", "fg_pct", "tfg_pct")


@query("a04_season_profiles", TOTALS + "select player_id, season, games, total_minutes, games_started, thin_sample, " + ", ".join(f"round({c}, 4) as {c}" for c in PROFILE_COLUMNS) + " from prof")
def season_profiles(s: Star) -> DataFrame:
    """A04, U01's first tier, M11 to M13: all seasons in one aggregate."""
    return P.season_totals(s.lines).select("player_id", "season", "games", "total_minutes", "games_started", "thin_sample", *[rate(F.col(c)).alias(c) for c in PROFILE_COLUMNS])


def _weights_sql() -> str:
    cases = []
    for name, w in M.bucket_weights().items():
        terms = " + ".join(f"{col} * {w[k]!r}::double" for k, col in (("pts", "points"), ("fgm", "fgm"), ("fga", "fga"), ("ftmiss", "(fta - ftm)"), ("reb", "rebounds"), ("ast", "assists"), ("stl", "steals"), ("blk", "blocks"), ("tov", "turnovers"), ("pf", "fouls")))
        cases.append(f"when '{name}' then {terms}")
    return "case case position when 'G' then 'GUARD' when 'F' then 'FORWARD' when 'C' then 'CENTER' else 'ALL' end " + " ".join(cases) + " end"


SCORES = (
    TOTALS
    + f""", v as (select l.player_id, l.season, p.class_year,
  ({_weights_sql()}) * (40.0 / greatest(greatest(minutes, 1), 10)) * greatest(0.55, least(1.6, 1 + (coalesce(r.rating, g.mean_rating) - g.mean_rating) / (2 * g.std_rating))) as v,
  case when abs(m.home_score - m.away_score) <= 12 then 1.0 else greatest(0.25, least(1.0, 1 - (abs(m.home_score - m.away_score) - 12) / 18.0)) end * greatest(0.3, least(1.0, greatest(minutes, 1) / 15.0)) as w
  from lines l join players p using (player_id) left join ratings r on r.season = l.season and r.team_id = l.opponent_team_id join league g on g.season = l.season
  left join games m on m.season = l.season and m.home_team_id = l.team_id and m.away_team_id = l.opponent_team_id),
raw as (select player_id, season, round(case when sum(w) > 0 then sum(v * w) / sum(w) else avg(v) end * case class_year when 'FR' then 1.03 when 'SO' then 1.015 when 'GR' then 0.995 else 1.0 end, 8) as raw from v group by player_id, season, class_year),
pool as (select season, avg(raw) as m, coalesce(nullif(stddev_pop(raw), 0), 1.0) as s from raw group by season),
scores as (select player_id, season, raw, 60 + case when raw >= m then 39 else 30 end * tanh((raw - m) / s / 1.5) as score_raw from raw join pool using (season))
"""
)


def scored(s: Star) -> DataFrame:
    s.keep_lines()
    games = s.once("games", lambda: s.games)  # a row a pair of teams and season: known to be small
    return P.season_scores(s.dealt(s.lines, "player_id"), s.players, games, solved(s))


@query("m08_season_scores", SCORES + "select player_id, season, round(raw, 3) + 0.0 as raw, round(score_raw, 3) + 0.0 as score from scores", RATINGS, keep=True)
def season_scores(s: Star) -> DataFrame:
    """A05, J11, M03 to M10, W12."""
    return scored(s).select("player_id", "season", (F.round("raw", 3) + 0.0).alias("raw"), (F.round("score_raw", 3) + 0.0).alias("score"))


@query("w02_ranks", SCORES + ", k as (select s.player_id, s.season, t.division, round(score_raw, 3) + 0.0 as score, row_number() over (partition by s.season order by round(score_raw, 3) desc, s.player_id) as a, row_number() over (partition by s.season, t.division order by round(score_raw, 3) desc, s.player_id) as b from scores s join players p using (player_id) join teams t on t.team_id = p.team_id) select player_id, season, division, cast(a as int) as overall_rank, cast(b as int) as division_rank from k", RATINGS, keep=True)
def ranks(s: Star) -> DataFrame:
    got = P.ranks(scored(s).withColumn("score_raw", F.round("score_raw", 3)), s.players, s.teams)
    return got.select("player_id", "season", "division", F.col("overall_rank").cast("int").alias("overall_rank"), F.col("division_rank").cast("int").alias("division_rank"))


@query("w03_percentile", SCORES + ", c as (select s.player_id, s.season, round(score_raw, 3) + 0.0 as score, thin_sample from scores s join prof using (player_id, season)) select player_id, season, round(100.0 * (rank() over (partition by season order by score desc)) / (count(*) over (partition by season)), 2) as top_percent from c where not thin_sample", RATINGS, keep=True)
def percentile(s: Star) -> DataFrame:
    full = scored(s).join(P.season_totals(s.lines).select("player_id", "season", "thin_sample"), ["player_id", "season"]).filter("not thin_sample").withColumn("score", F.round("score_raw", 3))
    placed = value_ranks(full, ["season"], "score", "place")
    return placed.select("player_id", "season", F.round(F.lit(100.0) * F.col("place") / F.col("place_of"), 2).alias("top_percent"))


TEAMPROF = TOTALS + """, tg as (select season, team_id, count(distinct game_id) as team_games from lines group by 1, 2),
tp as (select q.season, p.team_id, count(*) as roster_size, any_value(team_games) as team_games, sum(pts) / any_value(team_games) as per40_pts, sum(reb) / any_value(team_games) as per40_reb, sum(ast) / any_value(team_games) as per40_ast, sum(blk) / any_value(team_games) as per40_blk, sum(stl) / any_value(team_games) as per40_stl, sum(tov) / any_value(team_games) as per40_tov,
 sum(pts) / (2 * (sum(fga) + 0.44::double * sum(fta))) as ts_pct, sum(fgm) / sum(fga) as fg_pct, case when sum(tfga) >= 1 then sum(tfgm) / sum(tfga) end as tfg_pct
 from prof q join players p using (player_id) join tg on tg.season = q.season and tg.team_id = p.team_id group by 1, 2),
tl as (unpivot tp on per40_pts, per40_reb, per40_ast, per40_blk, per40_stl, per40_tov, ts_pct, fg_pct, tfg_pct into name category value value)
"""


def team_profiles(s: Star) -> DataFrame:
    return P.team_profiles(P.season_totals(s.lines), s.players, P.team_games(s.lines))


@query("a06_team_profiles", TEAMPROF + "select season, team_id, roster_size, team_games, " + ", ".join(f"round({c}, 4) as {c}" for c in P.CATEGORIES) + " from tp")
def team_profile(s: Star) -> DataFrame:
    """A02, A06."""
    return team_profiles(s).select("season", "team_id", "roster_size", "team_games", *[rate(F.col(c)).alias(c) for c in P.CATEGORIES])


@query("a07_category_stats", TEAMPROF + "select season, t.tier, category, round(avg(value), 4) as mean, round(coalesce(nullif(stddev_pop(value), 0), 1.0), 4) as std, count(value) as teams from tl join teams t using (team_id) group by 1, 2, 3")
def category_stats(s: Star) -> DataFrame:
    """Every tier and category at once."""
    long = P.long_profile(team_profiles(s), "season", "team_id").join(s.teams.select("team_id", "tier"), "team_id")
    return P.category_stats(long, "season", "tier").select("season", "tier", "category", rate(F.col("mean")).alias("mean"), rate(F.col("std")).alias("std"), "teams")


@query("a09_conference_means", TEAMPROF + "select season, conference, category, round(avg(value), 4) as mean from tl join teams using (team_id) group by 1, 2, 3")
def conference_means(s: Star) -> DataFrame:
    long = P.long_profile(team_profiles(s), "season", "team_id").join(s.teams.select("team_id", "conference"), "team_id")
    return long.groupBy("season", "conference", "category").agg(rate(F.avg("value")).alias("mean"))


@query("a25_spread", "select player_id, season, count(*) as games, max(points) as highest, min(points) as lowest, round(stddev_pop(points), 4) as deviation from lines group by 1, 2")
def spread(s: Star) -> DataFrame:
    return s.lines.groupBy("player_id", "season").agg(F.count(F.lit(1)).alias("games"), F.max("points").alias("highest"), F.min("points").alias("lowest"), rate(F.stddev_pop("points")).alias("deviation"))


@query("a23_top_quartile", ", k as (select season, rating, row_number() over (partition by season order by rating desc, team_id) as place, count(*) over (partition by season) as n from ratings) select season, round(avg(rating), 3) + 0.0 as target from k where place <= greatest(1, floor(n * 0.25)) group by season", RATINGS)
def top_quartile(s: Star) -> DataFrame:
    w = Window.partitionBy("season")
    got = solved(s).withColumns({"place": F.row_number().over(w.orderBy(F.col("rating").desc(), "team_id")), "n": F.count(F.lit(1)).over(w)})
    return got.filter(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.25))).groupBy("season").agg(F.round(F.avg("rating"), 3).alias("target"))


@query(
    "q10_team_needs",
    TEAMPROF + ", st as (select category, avg(value) as m, coalesce(nullif(stddev_pop(value), 0), 1.0) as s from tl where season = (select season from current) group by category), z as (select team_id, category, round(value, 4) as value, round((value - m) / s * case when category = 'per40_tov' then -1 else 1 end, 3) + 0.0 as z from tl join st using (category) where season = (select season from current)), k as (select *, row_number() over (partition by team_id order by z, category) as place from z) select team_id, category, value, z, cast(place as int) as place from k where place <= 3",
    keep=True,
)
def team_needs(s: Star, top: int = 3) -> DataFrame:
    """Worst categories of every team; a lower turnover rate is better."""
    long = P.long_profile(s.of_latest(team_profiles(s)), "team_id")
    stats = P.category_stats(long)
    sign = F.when(F.col("category") == "per40_tov", -1).otherwise(1)
    z = long.join(F.broadcast(stats), "category").select("team_id", "category", rate(F.col("value")).alias("value"), F.round((F.col("value") - F.col("mean")) / F.col("std") * sign, 3).alias("z"))
    w = Window.partitionBy("team_id").orderBy("z", "category")
    return z.withColumn("place", F.row_number().over(w).cast("int")).filter(F.col("place") <= top)


# -- players over seasons ------------------------------------------------------------


@query("q14_trajectory", SCORES + ", n as (select player_id, count(*) as seasons, round(case when count(*) >= 2 then (max_by(score, season) - min_by(score, season)) / (count(*) - 1) end + 1e-9, 3) + 0.0 as delta from (select player_id, season, round(score_raw, 3) + 0.0 as score from scores) group by player_id) select player_id, seasons, delta, case when delta is null then 'Insufficient data' when delta >= 3 then 'Improving' when delta <= -3 then 'Declining' else 'Stable' end as trend from n", RATINGS, keep=True)
def trajectory(s: Star) -> DataFrame:
    """W07, M27."""
    got = scored(s).withColumn("score", F.round("score_raw", 3)).groupBy("player_id").agg(F.count(F.lit(1)).alias("seasons"), F.round(F.when(F.count(F.lit(1)) >= 2, (F.max_by("score", "season") - F.min_by("score", "season")) / (F.count(F.lit(1)) - 1)) + 1e-9, 3).alias("delta"))
    return got.withColumn("trend", M.trend(F.col("delta")))


def board(totals: DataFrame, stat: str, least: int, limit: int) -> DataFrame:
    """Q15's three sources: a rate column, a total, a share with enough attempts."""
    kept = totals.filter(f"not thin_sample and games >= {least}")
    value = {"ppg": F.col("ppg"), "total_points": F.col("sum_pts").cast("double"), "topg": F.col("topg"), "tfg_pct": F.when(F.col("sum_tfga") >= 15, F.col("tfg_pct") * 100)}[stat]
    order = F.col("value").asc() if stat == "topg" else F.col("value").desc()
    return kept.select("player_id", F.lit(stat).alias("stat"), rate(value).alias("value")).filter("value is not null").orderBy(order, "player_id").limit(limit)


@query(
    "q15_leaderboard",
    TOTALS + ", c as (select * from prof where season = (select season from current) and not thin_sample and games >= 3) (select player_id, 'ppg' as stat, round(ppg, 4) as value from c order by value desc, player_id limit 25) union all (select player_id, 'total_points', round(cast(pts as double), 4) as value from c order by value desc, player_id limit 25) union all (select player_id, 'topg', round(topg, 4) as value from c order by value, player_id limit 25) union all (select player_id, 'tfg_pct', round(tfg_pct * 100, 4) as value from c where tfg_pct is not null order by value desc, player_id limit 25)",
    keep=True,
)
def leaderboard(s: Star) -> DataFrame:
    """O04, A11, A12."""
    totals = s.of_latest(P.season_totals(s.lines))
    out = board(totals, "ppg", 3, 25)
    for stat in ("total_points", "topg", "tfg_pct"):
        out = out.unionByName(board(totals, stat, 3, 25))
    return out


@query(
    "q22_player_efficiency",
    TOTALS + ", c as (select player_id, round(per40_pts, 4) as usage, round(ts_pct, 4) as efficiency from prof where season = (select season from current) and not thin_sample and games >= 4 and ts_pct is not null order by round(per40_pts, 4) desc, player_id limit 400), m as (select round(avg(usage), 1) as mu, round(avg(efficiency), 1) as me from c) select player_id, usage, efficiency, mu as mean_usage, me as mean_efficiency, case when usage >= mu and efficiency >= me then 'star' when usage >= mu then 'volume' when efficiency >= me then 'efficient' else 'limited' end as quadrant from c, m",
    keep=True,
)
def player_efficiency(s: Star) -> DataFrame:
    """W13 after the limit: raw values against rounded means."""
    totals = s.of_latest(P.season_totals(s.lines)).filter("not thin_sample and games >= 4 and ts_pct is not null")
    top = totals.select("player_id", rate(F.col("per40_pts")).alias("usage"), rate(F.col("ts_pct")).alias("efficiency")).orderBy(F.col("usage").desc(), "player_id").limit(400)
    means = top.agg(rate(F.avg("usage"), 1).alias("mean_usage"), rate(F.avg("efficiency"), 1).alias("mean_efficiency"))
    u, e = F.col("usage") >= F.col("mean_usage"), F.col("efficiency") >= F.col("mean_efficiency")
    return top.crossJoin(F.broadcast(means)).withColumn("quadrant", F.when(u & e, "star").when(u, "volume").when(e, "efficient").otherwise("limited"))


@query("w08_transfers", TOTALS + ", h as (select player_id, season, per40_pts, mode_team, lag(mode_team) over w as team_before, lag(per40_pts) over w as per40_before from (select q.player_id, q.season, q.per40_pts, x.opponent_team_id as mode_team from prof q join (select player_id, season, max(opponent_team_id) as opponent_team_id from lines group by 1, 2) x using (player_id, season)) window w as (partition by player_id order by season)) select player_id, season, mode_team as team_id, team_before, round(per40_pts / per40_before + 1e-9, 4) as factor from h where team_before <> mode_team and per40_before > 0")
def transfers(s: Star) -> DataFrame:
    """Adjacent available seasons with another team (here: the last opponent nation)."""
    return _transfers(s).select("player_id", "season", "team_id", "team_before", rate(F.col("factor") + 1e-9).alias("factor"))


def _transfers(s: Star) -> DataFrame:
    team = s.lines.groupBy("player_id", "season").agg(F.max("opponent_team_id").alias("team_id"))
    w = Window.partitionBy("player_id").orderBy("season")
    got = P.season_totals(s.lines).select("player_id", "season", "per40_pts").join(team, ["player_id", "season"])
    got = got.withColumns({"team_before": F.lag("team_id").over(w), "before": F.lag("per40_pts").over(w)})
    return got.filter("team_before <> team_id and before > 0").withColumn("factor", F.col("per40_pts") / F.col("before"))


@query(
    "a18_transfer_spread",
    TOTALS + ", h as (select season, mode_team, team_before, per40_pts / per40_before as factor from (select q.season, q.per40_pts, x.t as mode_team, lag(x.t) over w as team_before, lag(q.per40_pts) over w as per40_before from prof q join (select player_id, season, max(opponent_team_id) as t from lines group by 1, 2) x using (player_id, season) window w as (partition by q.player_id order by q.season)) where team_before <> mode_team and per40_before > 0), g as (select factor, round_even(round((b.rating - a.rating) / l.std_rating, 6) / 0.5, 0) * 0.5 as gap from h join ratings a on a.season = h.season and a.team_id = team_before join ratings b on b.season = h.season and b.team_id = mode_team join league l on l.season = h.season), c as (select greatest(-3.0, least(3.0, gap)) as bucket, factor from g) select cast(bucket as double) as bucket, count(*) as n, round(quantile_cont(factor, 0.1), 4) as p10, round(quantile_cont(factor, 0.25), 4) as p25, round(quantile_cont(factor, 0.5), 4) as median, round(quantile_cont(factor, 0.75), 4) as p75, round(quantile_cont(factor, 0.9), 4) as p90 from c group by 1 having count(*) >= 5",
    RATINGS,
)
def transfer_spread(s: Star) -> DataFrame:
    """Percentiles of what transfers kept, by strength gap."""
    rating, std = solved(s).select("season", "team_id", "rating"), R.league_rating(solved(s)).select("season", "std_rating")
    old = rating.select("season", F.col("team_id").alias("team_before"), F.col("rating").alias("was"))
    got = _transfers(s).join(rating, ["season", "team_id"]).join(old, ["season", "team_before"]).join(std, "season")
    bucket = M.gap_bucket(F.round((F.col("rating") - F.col("was")) / F.col("std_rating"), 6))
    shares = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    groups = percentiles(got.select(bucket.alias("bucket"), "factor"), ["bucket"], "factor", shares, least=5)
    return groups.select("bucket", "n", *[F.round(name, 4).alias(name) for name in shares])


@query("w09_stints", ", t as (select player_id, season, max(opponent_team_id) as team from lines group by 1, 2), f as (select *, case when lag(team) over w is distinct from team then 1 else 0 end as new from t window w as (partition by player_id order by season)), i as (select *, sum(new) over (partition by player_id order by season) as island from f), s as (select player_id, island, team, min(season) as a, max(season) as b from i group by 1, 2, 3) select player_id, string_agg(team || ' (' || a || '-' || b || ')', ' -> ' order by island) as history from s group by player_id")
def stints(s: Star) -> DataFrame:
    """Islands of equal teams, rendered in order."""
    w = Window.partitionBy("player_id").orderBy("season")
    team = s.lines.groupBy("player_id", "season").agg(F.max("opponent_team_id").alias("team"))
    new = F.when(F.lag("team").over(w).eqNullSafe(F.col("team")), 0).otherwise(1)
    island = team.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    spans = island.groupBy("player_id", "island", "team").agg(F.min("season").alias("a"), F.max("season").alias("b"))
    text = F.format_string("%d (%d-%d)", "team", "a", "b")
    rows = F.array_sort(F.collect_list(F.struct("island", text.alias("t"))))  # at most one a season
    return spans.groupBy("player_id").agg(F.array_join(F.transform(rows, lambda x: x.t), " -> ").alias("history"))


# -- roles and projections -------------------------------------------------------------


def current_players(s: Star) -> DataFrame:
    """Players with their profile and score of the latest season."""
    totals = s.of_latest(P.season_totals(s.lines))
    score = s.of_latest(scored(s)).select("player_id", F.round("score_raw", 6).alias("score_raw"), "score")
    return s.players.join(totals.drop("season"), "player_id").join(score, "player_id")


def roster_roles(s: Star) -> DataFrame:
    totals = s.of_latest(P.season_totals(s.lines))
    current = s.players.select("player_id", "team_id").join(totals.select("player_id", "games", "avg_minutes"), "player_id", "left")
    played = s.of_latest(P.team_games(s.lines)).select("team_id", F.ceil(F.col("team_games") / 12).alias("team_games"))
    return O.rosters(current, O.starts(s.of_latest(s.lines)), played)


ROLES = TOTALS + """, tg as (select team_id, cast(ceil(count(distinct game_id) / 12) as bigint) as team_games from lines where season = (select season from current) group by 1),
rr as (select p.player_id, p.team_id, c.games, c.avg_minutes, c.games_started, tg.team_games, coalesce(c.games_started / tg.team_games >= 0.65, false) as is_starter,
 coalesce(c.games_started / c.games < 0.35, false) and c.avg_minutes is not null and coalesce(c.games / tg.team_games > 0.5, false) as fits
 from players p left join (select * from prof where season = (select season from current)) c using (player_id) left join tg on tg.team_id = p.team_id),
rs as (select *, row_number() over (partition by team_id, not is_starter and fits order by round(avg_minutes, 6) desc nulls last, player_id) as place from rr),
roles as (select *, case when is_starter then 'starter' when fits and not is_starter and place = 1 then 'sixth_man' when avg_minutes is null then null when avg_minutes < 10 then 'depth_piece' else 'role_player' end as role from rs),
rmin as (select team_id, role, round(avg(avg_minutes), 1) as minutes, count(*) as players, round(min(avg_minutes), 1) as low, round(max(avg_minutes), 1) as high from roles where role is not null group by 1, 2)
"""


@query("q03_roles", ROLES + "select player_id, team_id, round(avg_minutes, 4) as avg_minutes, role from roles", keep=True)
def roles(s: Star) -> DataFrame:
    """The nation's schedule is scaled down to a roster's share."""
    return roster_roles(s).select("player_id", "team_id", rate(F.col("avg_minutes")).alias("avg_minutes"), "role")


@query("q03_role_minutes", ROLES + "select team_id, role, minutes, players, low, high from rmin", keep=True)
def role_minutes(s: Star) -> DataFrame:
    return O.role_minutes(roster_roles(s))


@query("q09_role_translation", ROLES + "select c.player_id, p.team_id, r.role, not (c.games >= 4 and c.total_minutes >= 80) as insufficient_sample, case when c.games >= 4 and c.total_minutes >= 80 then r.minutes end as minutes, " + ", ".join(f"case when c.games >= 4 and c.total_minutes >= 80 then round({b} * r.minutes / 40, 1) end as {a}" for a, b in (("ppg", "per40_pts"), ("rpg", "per40_reb"), ("apg", "per40_ast"), ("bpg", "per40_blk"), ("spg", "per40_stl"), ("topg", "per40_tov"))) + " from prof c join players p using (player_id) join rmin r on r.team_id = p.team_id where c.season = (select season from current)", keep=True)
def role_translation(s: Star) -> DataFrame:
    totals = s.of_latest(P.season_totals(s.lines))
    return O.translate(totals.join(s.players.select("player_id", "team_id"), "player_id"), O.role_minutes(roster_roles(s)), 4, 80)


def current_ratings(s: Star) -> DataFrame:
    return s.of_latest(solved(s)).select("team_id", (F.round("rating", 3) + 0.0).alias("rating"))


def projected(s: Star, target: int = 3, least: int = 3) -> DataFrame:
    pool = current_players(s).filter(f"not thin_sample and games >= {least}")
    return J.project(J.candidates(pool, current_ratings(s), target))


def _spread_sql(k: int) -> str:
    parts = [f"when g <= {b[0]} then {a[k]} + ({b[k]} - {a[k]}) * (g - ({a[0]})) / ({b[0] - a[0]})" for a, b in zip(M.SPREAD, M.SPREAD[1:], strict=False)]
    return "(case " + " ".join(parts) + " end)"


PROJECTED = (
    SCORES
    + """, cr as (select team_id, round(rating, 3) + 0.0 as rating from ratings where season = (select season from current)),
base as (select c.*, p.name, p.team_id, p.position, p.class_year, p.in_transfer_portal, round(s.score_raw, 6) as score_raw, cr.rating as own, t.rating as target, l.std from prof c join players p using (player_id) join scores s on s.player_id = c.player_id and s.season = c.season
 join cr on cr.team_id = p.team_id, (select rating from cr where team_id = 3) t, (select coalesce(nullif(stddev_pop(rating), 0), 1.0) as std from cr) l where c.season = (select season from current) and not thin_sample and games >= 3 and p.team_id <> 3),
f1 as (select *, (target - own) / std as gs, greatest(0.65, least(1.45, 1.06 - (target - own) / (5.85 * std))) as pf, greatest(0.55, least(1.1, 1 - (target - own) / (6.4 * std))) as mf, greatest(-10.0, least(6.0, -(target - own) / (0.8 * std))) as shift, greatest(-2.0, least(2.0, (target - own) / std)) as g from base),
f2 as (select *, abs(gs) >= case when class_year in ('FR', 'SO') then 1.25 else 2.0 end as extreme, """
    + ", ".join(f"{_spread_sql(k)} as s{n}" for k, n in ((1, "p10"), (2, "p25"), (3, "median"), (4, "p75"), (5, "p90")))
    + """ from f1),
f3 as (select *, case when games >= 20 then 2 when games >= 10 then 1 else 0 end - case when class_year in ('FR', 'SO') and games >= 10 then 1 else 0 end as lv from f2),
f4 as (select *, case when extreme and lv = 2 then 1 else lv end as level, greatest(4.0, least(36.0, avg_minutes * mf)) as mins, """
    + ", ".join(f"greatest(0.65, least(1.45, pf * s{n} / smedian)) as f{n}" for n in ("p10", "p25", "p75", "p90"))
    + """ from f3),
f5 as (select *, case level when 2 then 'High' when 1 then 'Medium' else 'Low' end as confidence, case level when 2 then 0.35 when 1 then 0.55 else 0.8 end as share from f4),
f6 as (select *, greatest(4.0, least(36.0, avg_minutes * greatest(0.55, least(1.1, mf - share * (mf - 0.55))))) as mlo, greatest(4.0, least(36.0, avg_minutes * greatest(0.55, least(1.1, mf + share * (1.1 - mf))))) as mhi from f5),
proj as (select player_id, name, team_id, position, class_year, games, in_transfer_portal, confidence, extreme, round(gs, 2) + 0.0 as gap_in_std, round(mins, 1) as proj_minutes, round(per40_pts * pf * mins / 40, 1) as proj_ppg, round(per40_reb * pf * mins / 40, 1) as proj_rpg, round(per40_ast * pf * mins / 40, 1) as proj_apg, round(per40_tov * (2.12 - pf) * mins / 40, 1) as proj_topg,
 round(greatest(0.2, least(0.8, fg_pct * pf)) * 100, 1) as proj_fg_pct, round(least(per40_pts * fp25 * mlo, per40_pts * fp75 * mlo, per40_pts * fp25 * mhi, per40_pts * fp75 * mhi) / 40, 1) as ppg_likely_low, round(greatest(per40_pts * fp25 * mlo, per40_pts * fp75 * mlo, per40_pts * fp25 * mhi, per40_pts * fp75 * mhi) / 40, 1) as ppg_likely_high,
 round(least(per40_pts * fp10 * mlo, per40_pts * fp90 * mlo, per40_pts * fp10 * mhi, per40_pts * fp90 * mhi) / 40, 1) as ppg_wide_low, round(greatest(per40_pts * fp10 * mlo, per40_pts * fp90 * mlo, per40_pts * fp10 * mhi, per40_pts * fp90 * mhi) / 40, 1) as ppg_wide_high,
 round(greatest(30.0, least(99.0, score_raw + shift)), 1) as proj_score, round(greatest(30.0, least(99.0, score_raw)), 1) as score from f6)
"""
)
PROJ_COLUMNS = ("proj_minutes", "proj_ppg", "proj_rpg", "proj_apg", "proj_topg", "ppg_likely_low", "ppg_likely_high", "ppg_wide_low", "ppg_wide_high", "proj_score")


@query("q08_project", PROJECTED + "select player_id, confidence, extreme, gap_in_std, " + ", ".join(PROJ_COLUMNS) + " from proj", RATINGS, keep=True)
def project(s: Star) -> DataFrame:
    """J12, M15 to M24 for every player against one target team."""
    return projected(s).select("player_id", "confidence", "extreme", "gap_in_std", *PROJ_COLUMNS)


@query("q11_fits", PROJECTED + ", st as (select avg(proj_ppg) as mp, coalesce(nullif(stddev_pop(proj_ppg), 0), 1.0) as sp, avg(proj_topg) as mt, coalesce(nullif(stddev_pop(proj_topg), 0), 1.0) as st from proj) select player_id, team_id, proj_ppg, proj_topg, round(((proj_ppg - mp) / sp - (proj_topg - mt) / st) / 2, 3) + 0.0 as fit_score from proj, st order by round(((proj_ppg - mp) / sp - (proj_topg - mt) / st) / 2, 4) desc, player_id limit 15", RATINGS, keep=True)
def fits(s: Star) -> DataFrame:
    return J.fits(projected(s), ["ppg", "topg"], 15).select("player_id", "team_id", "proj_ppg", "proj_topg", (F.round("fit_score", 3) + 0.0).alias("fit_score"))


@query("q12_leaps", PROJECTED + ", k as (select *, round(proj_score - score, 1) as gain, row_number() over (partition by team_id order by round(proj_score - score, 1) desc, proj_score desc, player_id) as place from proj) select player_id, team_id, score, proj_score, gain from k where place <= 2 order by gain desc, proj_score desc, player_id limit 8", RATINGS, keep=True)
def leaps(s: Star) -> DataFrame:
    """W06, O08."""
    return J.leaps(projected(s), 8).select("player_id", "team_id", "score", "proj_score", "gain")


@query("q13_batch", PROJECTED + ", a as (select * from proj where player_id in (11, 40, 77, 110, 200)) select count(*) as players, round(sum(proj_ppg), 1) as ppg, round(sum(proj_rpg), 1) as rpg, round(sum(proj_apg), 1) as apg from a", RATINGS, keep=True)
def batch(s: Star) -> DataFrame:
    """Sums of rounded values; unknown players go to the errors."""
    wanted = s.spark.createDataFrame([(11,), (40,), (77,), (110,), (200,), (-1,)], "player_id long")
    rows, _ = J.batch(projected(s), wanted)
    return rows.agg(F.count(F.lit(1)).alias("players"), *[F.round(F.sum(f"proj_{c}"), 1).alias(c) for c in ("ppg", "rpg", "apg")])


#: The same projections against the mean of the strongest tier, for players of the others.
TO_THE_TOP = PROJECTED.replace("(select rating from cr where team_id = 3) t", "(select avg(rating) as rating from cr join teams using (team_id) where tier = 'High-Major') t").replace("p.team_id <> 3", "p.team_id in (select team_id from teams where tier <> 'High-Major')")


@query("q17_standouts", TO_THE_TOP + "select player_id, team_id, score, proj_score, proj_ppg, confidence from proj join (select player_id, score_raw from base) using (player_id) order by proj_score desc, score_raw desc, player_id limit 20", RATINGS, keep=True)
def standouts(s: Star) -> DataFrame:
    """Against the mean rating of the strongest tier."""
    high = current_ratings(s).join(s.teams.filter("tier = 'High-Major'").select("team_id"), "team_id", "left_semi").agg(F.avg("rating").alias("target_rating"))
    league = current_ratings(s).agg(M.std_or_one(F.col("rating")).alias("std_rating"))
    pool = current_players(s).filter("not thin_sample and games >= 3").join(current_ratings(s).select("team_id", F.col("rating").alias("current_rating")), "team_id").join(s.teams.filter("tier <> 'High-Major'").select("team_id"), "team_id", "left_semi")
    got = J.project(pool.crossJoin(F.broadcast(high)).crossJoin(F.broadcast(league)).withColumn("minutes_override", F.lit(None).cast("double")))
    return got.orderBy(F.col("proj_score").desc(), F.col("score_raw").desc(), "player_id").limit(20).select("player_id", "team_id", "score", "proj_score", "proj_ppg", "confidence")


@query("q06_lineups", keep=True)
def lineups(s: Star) -> DataFrame:
    """The lineup search of every team; path-dependent, so rows only."""
    now = s.of_latest(s.lines)
    played = s.of_latest(P.team_games(s.lines)).select("team_id", F.ceil(F.col("team_games") / 12).alias("team_games"))
    pool = current_players(s).filter("not thin_sample").join(O.mean_production(now), "player_id").join(played, "team_id")
    return O.lineups(pool.select("team_id", "player_id", "position", "games", "games_started", "team_games", "avg_minutes", "total_minutes", "per40_pts", F.col("ppg").alias("ppg_actual"), "avg_production", "score"))


@query("q07_player_detail", SCORES + ", c as (select p.player_id, p.name, t.name as team, c.games, c.games_started, round(c.ppg, 1) as ppg, round(100 * c.ts_pct, 1) as ts_pct, round(s.score_raw, 3) + 0.0 as score, c.thin_sample from players p join prof c using (player_id) join scores s on s.player_id = c.player_id and s.season = c.season left join teams t on t.team_id = p.team_id where c.season = (select season from current)) select a.* exclude (thin_sample), round(100.0 * ((select count(*) from c b where not b.thin_sample and b.score > a.score) + 1) / (select count(*) from c where not thin_sample), 2) as top_percent from c a where player_id in (11, 40, 77)", RATINGS, keep=True)
def player_detail(s: Star) -> DataFrame:
    """The pool leaves thin samples out, the subject may be one."""
    rows = current_players(s).join(s.teams.select("team_id", F.col("name").alias("team")), "team_id", "left").withColumn("score", F.round("score_raw", 3))
    pool = rows.filter("not thin_sample").select(F.col("score").alias("other"))
    subject = rows.filter(F.col("player_id").isin(11, 40, 77))  # three rows
    better = F.broadcast(subject.select("player_id", "score")).join(pool).groupBy("player_id").agg(F.round(F.lit(100.0) * (F.sum(F.when(F.col("other") > F.col("score"), 1).otherwise(0)) + 1) / F.count(F.lit(1)), 2).alias("top_percent"))
    return subject.join(better, "player_id").select("player_id", "name", "team", "games", "games_started", rate(F.col("ppg"), 1).alias("ppg"), rate(F.col("ts_pct") * 100, 1).alias("ts_pct"), "score", "top_percent")
