"""Questions from a shell, answered as one JSON object a line.

    spark-submit ... -m tipoff --tables DIR roles --team 3
    python -m tipoff --tables DIR fits --team 3 --stats ppg,topg --top 10
    python -m tipoff --tables DIR query q25_standings
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.operators import projection as J
from tipoff.plans import QUERIES, models
from tipoff.sources.shared import release
from tipoff.sources.star import Star


def roles(s: Star, a: argparse.Namespace) -> DataFrame:
    return models.roles(s).filter(F.col("team_id") == a.team).orderBy("role", F.desc("avg_minutes"), "player_id")


def needs(s: Star, a: argparse.Namespace) -> DataFrame:
    return models.team_needs(s, a.top).filter(F.col("team_id") == a.team).orderBy("place")


def fits(s: Star, a: argparse.Namespace) -> DataFrame:
    stats = a.stats.split(",")
    got = J.fits(models.projected(s, a.team), stats, a.top)
    return got.select("player_id", "name", "team_id", *[f"proj_{c}" for c in stats], "fit_score").orderBy(F.desc("fit_score"), "player_id")


def trajectory(s: Star, a: argparse.Namespace) -> DataFrame:
    return models.trajectory(s).filter(F.col("player_id") == a.player)


def project(s: Star, a: argparse.Namespace) -> DataFrame:
    pool = models.current_players(s).filter(F.col("player_id") == a.player)
    rows = J.project(J.candidates(pool, models.current_ratings(s), a.team, own=True, minutes=a.minutes))
    return rows.select("player_id", "confidence", "extreme", "gap_in_std", *models.PROJ_COLUMNS)


def any_query(s: Star, a: argparse.Namespace) -> DataFrame:
    if a.name not in QUERIES:
        raise J.ProjectionError(f"there is no query {a.name}")
    return QUERIES[a.name](s.spark, s.path)


COMMANDS: dict[str, Callable[[Star, argparse.Namespace], DataFrame]] = {"roles": roles, "needs": needs, "fits": fits, "trajectory": trajectory, "project": project, "query": any_query}


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tipoff", description=__doc__.split("\n")[0])
    parser.add_argument("--tables", required=True, help="folder of the tables")
    parser.add_argument("--lines", type=int, default=1000, help="lines printed, at most")
    add = parser.add_subparsers(dest="command", required=True).add_parser
    for name in ("roles", "needs", "fits", "project"):
        one = add(name)
        one.add_argument("--team", type=int, required=True)
        if name in ("needs", "fits"):
            one.add_argument("--top", type=int, default=3 if name == "needs" else 15)
        if name == "fits":
            one.add_argument("--stats", default="ppg")
        if name == "project":
            one.add_argument("--player", type=int, required=True)
            one.add_argument("--minutes", type=float)
    add("trajectory").add_argument("--player", type=int, required=True)
    add("query").add_argument("name")
    return parser.parse_args(argv)


def main(argv: list[str], out: TextIO = sys.stdout) -> int:
    """Q32: 0 with rows, 1 without, 2 for a parameter that can't be used."""
    a = arguments(argv)
    spark = SparkSession.builder.appName("tipoff").getOrCreate()
    try:
        rows = COMMANDS[a.command](Star(spark, a.tables).keep_lines(), a).limit(a.lines).toJSON().collect()
    except J.ProjectionError as e:
        print(json.dumps({"error": str(e)}), file=out)
        return 2
    finally:
        release()
    for row in rows:
        print(row, file=out)
    return 0 if rows else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
