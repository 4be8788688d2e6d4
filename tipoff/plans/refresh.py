"""The gated refresh: checks, staged write, swap."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tipoff.operators import quality as K
from tipoff.sources.tables import swap, write_table


class RefreshError(RuntimeError):
    """The checks found errors; nothing was written."""


def refresh(spark: SparkSession, tables: dict[str, DataFrame], live: str, force: bool = False) -> DataFrame:
    """Returns the findings; raises before any write if there are errors."""
    lines, games, players, teams = (tables[k] for k in ("player_game_logs", "games", "players", "teams"))
    found = K.findings(
        {"duplicate lines": K.duplicates(lines, "player_id", "game_id"), "orphan teams": K.orphans(players, "team_id", teams, "team_id"), "self play": K.self_play(games)},
        {"roster sizes": K.roster_sizes(players, teams), "missing names": K.missing(players, "name")},
    )
    if not force and not K.passed(found):
        raise RefreshError("the data checks found errors")
    staged = f"{live.rstrip('/')}.staged-{uuid.uuid4().hex}"
    for name, frame in tables.items():
        write_table(frame, staged, name)
    swap(spark, staged, live)
    return found
