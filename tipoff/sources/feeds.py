"""JSON feeds: team lists, rosters, schedules, box scores, game logs; native expressions.

A frame has one document a row in column ``body``.  Broken documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEAMS = "sports array<struct<leagues: array<struct<teams: array<struct<team: struct<id: string, displayName: string, abbreviation: string>>>>>>>"
ROSTER = "athletes array<struct<id: string, fullName: string, jersey: string, displayHeight: string, position: struct<abbreviation: string>, experience: struct<abbreviation: string>>>"
EVENTS = "events array<struct<id: string, date: string, neutralSite: boolean, competitions: array<struct<competitors: array<struct<id: string, homeAway: string, winner: boolean, score: struct<value: double>, team: struct<displayName: string>>>>>>>"
BOX = "boxscore struct<players: array<struct<team: struct<id: string>, statistics: array<struct<names: array<string>, athletes: array<struct<athlete: struct<id: string, displayName: string>, starter: boolean, stats: array<string>>>>>>>>"
LOG = "rows array<struct<date: string, opponent: string, gs: string, min: string, pts: string, isFooter: boolean>>"


def parsed(docs: DataFrame, schema: str) -> DataFrame:
    return docs.withColumn("doc", F.from_json("body", schema))


def team_list(docs: DataFrame) -> DataFrame:
    """The first league of the first sport."""
    teams = F.expr("doc.sports[0].leagues[0].teams")
    return parsed(docs, TEAMS).select(F.explode(teams).alias("t")).select(F.col("t.team.id").alias("team_ref"), F.col("t.team.displayName").alias("name"), F.col("t.team.abbreviation").alias("short"))


def roster(docs: DataFrame) -> DataFrame:
    """S07, S10."""
    return parsed(docs, ROSTER).select("team_ref", F.explode("doc.athletes").alias("a")).select("team_ref", F.col("a.id").alias("player_ref"), F.col("a.fullName").alias("name"), F.col("a.displayHeight").alias("height"), F.col("a.position.abbreviation").alias("position"), F.col("a.experience.abbreviation").alias("class_year"))


def schedule(docs: DataFrame) -> DataFrame:
    """Events of two sides, seen from ``team_ref``."""
    events = parsed(docs, EVENTS).select("team_ref", F.explode("doc.events").alias("e")).select("team_ref", "e", F.expr("e.competitions[0].competitors").alias("c")).filter("size(c) = 2")
    me, other = F.filter("c", lambda x: x.id == F.col("team_ref")), F.filter("c", lambda x: x.id != F.col("team_ref"))
    got = events.withColumns({"me": F.get(me, 0), "other": F.get(other, 0)}).filter("me is not null and other is not null")
    return got.select("team_ref", F.col("e.id").alias("game_ref"), F.col("e.date").alias("date"), F.col("me.homeAway").alias("side"), F.col("other.id").alias("opponent_ref"), F.col("other.team.displayName").alias("opponent"), F.col("me.score.value").alias("scored"), F.col("other.score.value").alias("allowed"), F.coalesce("e.neutralSite", F.lit(False)).alias("neutral"))


def box_score(docs: DataFrame) -> DataFrame:
    """Names and values of a row zipped to a map; rows of another length are dropped."""
    sides = parsed(docs, BOX).select("game_ref", F.explode("doc.boxscore.players").alias("s")).select("game_ref", F.col("s.team.id").alias("team_ref"), F.expr("s.statistics[0]").alias("t"))
    rows = sides.select("game_ref", "team_ref", F.col("t.names").alias("names"), F.explode("t.athletes").alias("a")).filter("size(names) = size(a.stats)")
    stats = F.map_from_arrays("names", "a.stats")
    pick = lambda k: F.try_element_at("stats", F.lit(k))
    got = rows.withColumn("stats", stats)
    return got.select("game_ref", "team_ref", F.col("a.athlete.id").alias("player_ref"), F.col("a.athlete.displayName").alias("name"), F.coalesce("a.starter", F.lit(False)).cast("int").alias("started"), pick("MIN").try_cast("int").alias("minutes"), pick("PTS").try_cast("int").alias("points"), pick("FG").alias("fg"))


def height(docs: DataFrame) -> DataFrame:
    """One field of a profile."""
    return docs.select("player_ref", F.get_json_object("body", "$.athlete.displayHeight").alias("height"))


def game_log(docs: DataFrame) -> DataFrame:
    """Without footers and undated rows."""
    rows = parsed(docs, LOG).select("player_ref", F.explode("doc.rows").alias("r"))
    kept = rows.filter("not coalesce(r.isFooter, false) and coalesce(trim(r.date), '') <> ''")
    return kept.select("player_ref", F.col("r.date").alias("date"), F.col("r.opponent").alias("opponent"), F.col("r.gs").alias("gs"), F.col("r.min").try_cast("int").alias("minutes"), F.col("r.pts").try_cast("int").alias("points"))
