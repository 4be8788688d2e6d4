"""Keeping tables: changed partitions only, stable ids, sheets with types of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.operators import ledger
from tipoff.operators import quality as K
from tipoff.plans.registry import query
from tipoff.sources import partitions, sheets
from tipoff.sources.shared import folder
from tipoff.sources.star import Star


def by_season(s: Star) -> DataFrame:
    """Points of every player and season, with a sport."""
    return s.lines.groupBy("season", "player_id").agg(F.sum("points").alias("points")).withColumn("sport", F.when(F.col("player_id") % 2 == 0, "women").otherwise("men"))


def stored(s: Star, path: str) -> DataFrame:
    """(sport, season, file) of a table's files."""
    return s.spark.read.parquet(path).select("sport", "season", F.col("_metadata.file_path").alias("file")).distinct()


@query(
    "s26_partition_refresh",
    ", p as (select season, player_id, sum(points) as points, case when player_id % 2 = 0 then 'women' else 'men' end as sport from lines group by 1, 2), l as (select max(season) as last from p) select sport, season, count(*) as players, cast(sum(case when season = last and sport = 'men' then points + 1 else points end) as bigint) as points, not (season = last and sport = 'men') as same_files from p, l group by sport, season, last",
    keep=True,
)
def partition_refresh(s: Star) -> DataFrame:
    """The last season of one sport is written anew, the other partitions'
    files are the same as before."""
    live = f"{folder(s.spark, 'upkeep')}/seasons"
    table = by_season(s)
    partitions.replace_partitions(table, live, ["sport", "season"])
    before = s.spark.createDataFrame(stored(s, live).toArrow())  # a row a file: which are there now
    last = s.lines.agg(F.max("season").alias("season"))  # one row
    changes = table.filter("sport = 'men'").join(F.broadcast(last), "season", "left_semi").withColumn("points", F.col("points") + 1)
    checks = lambda staged: K.findings({"no points": staged.filter("points is null"), "twice": K.duplicates(staged, "sport", "season", "player_id")}, {})
    partitions.upsert_partitions(changes, live, ["sport", "season"], ["player_id"], checks)
    kept = stored(s, live).join(before.select("file"), "file", "left_semi").groupBy("sport", "season").agg(F.count(F.lit(1)).alias("kept"))
    files = stored(s, live).groupBy("sport", "season").agg(F.count(F.lit(1)).alias("files"))
    same = files.join(kept, ["sport", "season"], "left").select("sport", "season", (F.coalesce("kept", F.lit(0)) == F.col("files")).alias("same_files"))
    rows = s.spark.read.parquet(live).groupBy("sport", "season").agg(F.count(F.lit(1)).alias("players"), F.sum("points").alias("points"))
    return rows.join(same, ["sport", "season"])


@query("k30_ledger", ", h as (select player_id, row_number() over (order by player_id) as id from players where player_id % 3 = 0), t as (select count(*) as top from h), r as (select player_id, top + row_number() over (order by player_id) as id from players, t where player_id % 3 <> 0) select player_id, id, true as stays from h union all select player_id, id, true from r")
def ledger_of_players(s: Star) -> DataFrame:
    """A third of the players come first, then all, twice: ids stay."""
    path = f"{folder(s.spark, 'upkeep')}/ids"
    keys = s.players.select("player_id")
    first = ledger.assign(keys.filter("player_id % 3 = 0"), path, name="first")
    second = ledger.assign(keys, path, name="id")
    third = ledger.assign(keys, path, name="again")
    got = second.join(third, "player_id").join(first, "player_id", "left")
    return got.select("player_id", "id", ((F.col("id") == F.col("again")) & F.coalesce(F.col("id") == F.col("first"), F.lit(True))).alias("stays"))


@query("s05_mixed_cells", ", c as (select player_id, height_in, case when player_id % 5 = 0 then cast(height_in + 0.5 as varchar) else cast(height_in as varchar) end as half, case when player_id % 7 = 0 then 'n/a' else cast(height_in as varchar) end as mixed, case when player_id % 3 <> 0 then player_id end as part from players) select player_id, height_in, cast(half as double) as half, mixed, part, 'bigint,bigint,double,string,bigint' as kinds from (select * replace (cast(height_in as bigint) as height_in) from c)")
def mixed_cells(s: Star) -> DataFrame:
    """Whole numbers, decimals among them, text among them, and blanks."""
    path = f"{folder(s.spark, 'upkeep')}/cells.csv"
    inches = F.col("height_in").cast("string")
    half = F.when(F.col("player_id") % 5 == 0, (F.col("height_in") + F.lit(0.5)).cast("string")).otherwise(inches)
    mixed = F.when(F.col("player_id") % 7 == 0, "n/a").otherwise(inches)
    s.players.select("player_id", "height_in", half.alias("half"), mixed.alias("mixed"), F.when(F.col("player_id") % 3 != 0, F.col("player_id")).alias("part")).write.option("header", True).csv(path)
    got = sheets.read_sheet(s.spark, path, ["player_id", "half", "mixed"])
    return got.withColumn("kinds", F.lit(",".join(kind for _, kind in got.dtypes)))


@query("s01_workbook", ", g as (select count(*) as n, sum(season) as t from games), p as (select count(*) as n, sum(team_id) as t from players), l as (select count(*) as n, sum(minutes) as t from lines), e as (select count(*) as n, sum(team_id) as t from teams) select 'games' as relation, n as rows, cast(t as bigint) as total from g union all select 'players', n, cast(t as bigint) from p union all select 'player_game_logs', n, cast(t as bigint) from l union all select 'teams', n, cast(t as bigint) from e union all select 'meta', 1, cast(7 as bigint)", keep=True)
def workbook(s: Star) -> DataFrame:
    """Five sheets exported and read back as typed relations."""
    path = f"{folder(s.spark, 'upkeep')}/book"
    games = s.games.select(F.concat_ws("-", "season", "home_team_id", "away_team_id").alias("Game ID"), F.col("season").alias("SEASON"), "home_team_id", "away_team_id", "home_score", "away_score")
    lines = s.lines.select("player_id", "game_id", "season", "team_id", "opponent_team_id", "minutes", "points")
    meta = s.spark.createDataFrame([("7", "version")], "value string, key string")
    for name, frame in {"teams": s.teams, "players": s.players.select("player_id", "name", "team_id", "position"), "games": games, "player_game_logs": lines, "meta": meta}.items():
        frame.write.option("header", True).csv(f"{path}/{name}.csv")
    book = sheets.read_workbook(s.spark, path)
    totals = {"teams": "team_id", "players": "team_id", "games": "season", "player_game_logs": "minutes", "meta": "value"}
    out = None
    for name, frame in book.items():
        one = frame.agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("rows"), F.sum(F.col(totals[name]).cast("long")).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out
