"""Readers and writers of the engine's tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed schemas of the query-time tables.
SCHEMAS = {
    "meta": "key string, value string",
    "teams": "team_id long, name string, division string, conference string, tier string, current_rating double, sos double",
    "players": "player_id long, name string, height string, height_in int, team_id long, division string, position string, class_year string, season string, games int, total_minutes double, avg_minutes double, ppg double, rpg double, apg double, bpg double, spg double, topg double, ts_pct double, fg_pct double, tfg_pct double, per40_pts double, per40_reb double, per40_ast double, per40_blk double, per40_stl double, per40_tov double, impact_score double, impact_score_raw double, in_transfer_portal boolean, thin_sample boolean",
    "team_profile": "team_id long, roster_size int, per40_pts double, per40_reb double, per40_ast double, per40_blk double, per40_stl double, per40_tov double, ts_pct double, fg_pct double, tfg_pct double",
    "player_game_logs": "player_id long, season string, game_id string, date timestamp, team_id long, opponent_team_id long, opponent_name string, opponent_division string, started boolean, minutes int, points int, rebounds int, assists int, steals int, blocks int, turnovers int, fouls int, fgm int, fga int, tfgm int, tfga int, ftm int, fta int",
    "games": "game_id string, season string, date timestamp, home_team_id long, home_team_name string, away_team_id long, away_team_name string, home_score int, away_score int, winner_team_id long, margin int, neutral_site boolean, overtime boolean, conference_game boolean",
}
PARTITIONS = {"player_game_logs": ["season"], "games": ["season"]}


def conform(frame: DataFrame, schema: str) -> DataFrame:
    """Columns by name, missing ones as typed nulls, further ones dropped."""
    have = {c.lower(): c for c in frame.columns}
    return frame.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields])


def not_blank(frame: DataFrame) -> DataFrame:
    """Without all-null rows."""
    return frame.na.drop("all")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header, blank as null, given or inferred types."""
    reader = spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
    return not_blank(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path))


def write_table(frame: DataFrame, path: str, name: str) -> None:
    """Overwrite one table, partitioned where it grows."""
    writer = conform(frame, SCHEMAS[name]).write.mode("overwrite")
    (writer.partitionBy(*PARTITIONS[name]) if name in PARTITIONS else writer).parquet(f"{path}/{name}")


def append_rows(frame: DataFrame, path: str, name: str) -> None:
    """Append by header; unknown columns are ignored."""
    conform(frame, SCHEMAS[name]).write.mode("append").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return conform(spark.read.parquet(f"{path}/{name}"), SCHEMAS[name])


def swap(spark: SparkSession, staged: str, live: str, tries: int = 3) -> None:
    """Move the live folder aside and the staged one in its place.

    A move that fails is tried again; the last backup goes only when the new table is
    in place, and if it can't get there the old one comes back.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old, back, last = (hadoop.Path(p) for p in (staged, live, live.rstrip("/") + ".backup", live.rstrip("/") + ".backup.last"))
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())

    def move(a: object, b: object, problem: str) -> None:
        for i in range(tries):
            if fs.rename(a, b):
                return
            time.sleep(0.2 * i)
        raise OSError(problem)

    if not fs.exists(new):
        raise OSError(f"there is no {staged}")
    fs.delete(last, True)
    if fs.exists(old):
        if fs.exists(back):
            move(back, last, f"the backup of {live} can't be moved aside")
        move(old, back, f"{live} can't be moved aside")
    try:
        move(new, old, f"{staged} can't take the place of {live}")
    except OSError:
        if fs.exists(back):
            fs.rename(back, old)
        raise
    fs.delete(last, True)
