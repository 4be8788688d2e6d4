"""Two sports in one set of tables: ``sport`` is a partition and a part of every key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.operators import ratings as R
from tipoff.operators.ordering import numbered, value_ranks
from tipoff.plans.models import PASSES
from tipoff.plans.registry import query
from tipoff.sources.star import ORACLE, Star

#: Sports by the parity of a player's id.
SPORTS = ("women", "men")


def lines(s: Star) -> DataFrame:
    """The lines of both sports, written by sport and season, so that the filter of a
    list on one sport or season leaves the other folders unread."""
    sport = F.when(F.col("player_id") % 2 == 0, SPORTS[0]).otherwise(SPORTS[1])
    return s.once("sports", lambda: s.lines.withColumn("sport", sport), "sport", "season")


def games(s: Star) -> DataFrame:
    """A season's meetings of an ordered pair of teams of one sport as one game."""
    return lines(s).groupBy("sport", "season", F.col("team_id").alias("home_team_id"), F.col("opponent_team_id").alias("away_team_id")).agg(F.sum("points").alias("home_score"), (F.sum("rebounds") * 3).alias("away_score"))


BOTH = (
    ORACLE.replace("with teams as", "with recursive teams as")
    + f""", sl as (select *, case when player_id % 2 = 0 then 'women' else 'men' end as sport from lines),
sg as (select sport, season, team_id as home, opponent_team_id as away, cast(sum(points) as bigint) as hs, cast(sum(rebounds) * 3 as bigint) as as_ from sl group by 1, 2, 3, 4),
ss as (select sport, season, home as team_id, away as opponent_team_id, hs as scored, as_ as allowed from sg union all select sport, season, away, home, as_, hs from sg),
sv(i, sport, season, team_id, off, de) as (
  select 0, sport, season, team_id, avg(scored), avg(allowed) from ss group by 2, 3, 4
  union all
  select any_value(p.i) + 1, e.sport, e.season, e.team_id, avg(e.scored - p.de) + any_value(m.md), avg(e.allowed - p.off) + any_value(m.mo)
  from ss e join sv p on e.opponent_team_id = p.team_id and e.season = p.season and e.sport = p.sport
  join (select sport, season, avg(de) as md, avg(off) as mo from sv group by 1, 2) m on m.season = e.season and m.sport = e.sport
  where p.i < {PASSES} group by e.sport, e.season, e.team_id),
sr as (select sport, season, team_id, round(off - de, 3) + 0.0 as rating from sv where i = {PASSES})
"""
)


@query("s11_ratings", BOTH + "select sport, season, team_id, rating, row_number() over (partition by sport, season order by rating desc, team_id) as net_rank from sr", "")
def ratings_by_sport(s: Star) -> DataFrame:
    """S11 with R01, R05, W04: every sport is a pool of its own in rating and rank."""
    solved = R.solve_ratings(R.unpivot(games(s), "sport"), passes=PASSES, tolerance=0.0, pool="sport")
    rounded = solved.select("sport", "season", "team_id", (F.round("rating", 3) + 0.0).alias("rating"))
    return numbered(rounded, ["sport", "season"], [F.desc("rating"), F.asc("team_id")], "net_rank")


@query("s11_men", ", l as (select * from lines where player_id % 2 = 1 and season = 1997), p as (select player_id, count(*) as games, sum(points) as points from l group by 1), k as (select *, rank() over (order by points desc) as place, count(*) over () as players from p) select player_id, games, cast(points as bigint) as points, place, players from k where place <= 25")
def men(s: Star) -> DataFrame:
    """S11 with W03, O01: a list of one sport and season reads one folder."""
    own = lines(s).filter("sport = 'men' and season = 1997").groupBy("player_id").agg(F.count(F.lit(1)).alias("games"), F.sum("points").alias("points"))
    placed = value_ranks(own.withColumn("sport", F.lit("men")), ["sport"], "points", "place").withColumnRenamed("place_of", "players")
    return placed.filter("place <= 25").select("player_id", "games", "points", "place", "players")


@query("s11_schedules", ", sl as (select *, case when player_id % 2 = 0 then 'women' else 'men' end as sport from lines), m as (select sport, season, team_id, opponent_team_id, sum(points) - 3 * sum(rebounds) as margin from sl group by 1, 2, 3, 4) select sport, season, team_id, count(*) as games, cast(count(*) filter (margin > 0) as bigint) as wins, cast(sum(margin) as bigint) as margin from m group by 1, 2, 3")
def schedules(s: Star) -> DataFrame:
    """S11 with S08, A14: home records of both sports in one pass."""
    margin = F.col("home_score") - F.col("away_score")
    return games(s).groupBy("sport", "season", F.col("home_team_id").alias("team_id")).agg(F.count(F.lit(1)).alias("games"), F.count(F.when(margin > 0, 1)).alias("wins"), F.sum(margin).alias("margin"))
