"""Data checks and repairs, set-oriented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.operators.ordering import numbered

FINDING = ("severity", "category", "n")
COUNTS = ("points", "rebounds", "assists", "steals", "blocks", "turnovers", "fouls", "fga", "fgm", "tfga", "tfgm", "fta", "ftm")
LITERAL = ("player_id", "team_id", "game_ts", "minutes", *COUNTS)


def duplicates(frame: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur twice or more."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing(frame: DataFrame, column: str) -> DataFrame:
    """K02."""
    return frame.filter(F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == ""))


def roster_sizes(players: DataFrame, teams: DataFrame, low: int = 6, high: int = 26) -> DataFrame:
    """Teams out of bounds; those without players have 0."""
    sizes = players.groupBy("team_id").agg(F.count(F.lit(1)).alias("players"))
    got = teams.select("team_id").join(sizes, "team_id", "left").fillna(0, ["players"])
    return got.filter((F.col("players") < low) | (F.col("players") > high)).withColumn("problem", F.when(F.col("players") == 0, "none").when(F.col("players") < low, "small").otherwise("large"))


def orphans(frame: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key the parent doesn't have; null keys are no orphans."""
    return frame.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def self_play(games: DataFrame) -> DataFrame:
    """K05."""
    return games.filter("home_team_id = away_team_id")


def sanity(lines: DataFrame) -> DataFrame:
    """All counts of one pass, in long form."""
    rules = {
        "made over attempts": "fgm > fga or tfgm > tfga or ftm > fta", "minutes over 55": "minutes > 55", "points over 65": "points > 65", "rebounds over 35": "rebounds > 35",
        "points differ": "points <> 2 * (fgm - tfgm) + 3 * tfgm + ftm", "minutes out of 0 to 60": "minutes < 0 or minutes > 60", "negative": " or ".join(f"{c} < 0" for c in COUNTS),
    }
    sums = lines.agg(*[F.coalesce(F.sum(F.when(F.expr(r), 1)), F.lit(0)).cast("long").alias(f"r{i}") for i, r in enumerate(rules.values())])
    pairs = ", ".join(f"'{name}', r{i}" for i, name in enumerate(rules))
    return sums.select(F.expr(f"stack({len(rules)}, {pairs}) as (category, n)"))


def findings(errors: dict[str, DataFrame], warnings: dict[str, DataFrame]) -> DataFrame:
    """(severity, category, n) of every check."""
    out = None
    for severity, checks in (("ERROR", errors), ("WARNING", warnings)):
        for name, frame in checks.items():
            one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(severity).alias("severity"), F.lit(name).alias("category"), "n")
            out = one if out is None else out.unionByName(one)
    return out


def passed(found: DataFrame) -> bool:
    """The gate: no error."""
    return found.filter("severity = 'ERROR' and n > 0").isEmpty()


def score_key() -> Column:
    """A game whichever side a source calls home."""
    flip = F.col("home_team_id") > F.col("away_team_id")
    pick = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a)).cast("string")
    return F.concat_ws("|", F.col("season").cast("string"), pick("home_team_id", "away_team_id"), pick("away_team_id", "home_team_id"), pick("home_score", "away_score"), pick("away_score", "home_score"))


def keep_first(frame: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row a key, in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def dedupe_games(games: DataFrame) -> DataFrame:
    """An id that is known goes first, then the smallest."""
    return keep_first(games, [score_key()], [F.col("game_id").isNull(), F.col("game_id")])


def cascade(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """Lines without those of removed games."""
    return lines.join(removed.select("game_id").distinct(), "game_id", "left_anti")


def literal_duplicates(lines: DataFrame) -> DataFrame:
    """Equal player, team and counts on one day: the first game stays."""
    return keep_first(lines, [*LITERAL], [F.col("game_id")])


def literal_places(lines: DataFrame) -> DataFrame:
    """K13 with all lines: ``place`` is 1 for those that stay."""
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(*LITERAL).orderBy("game_id")))


def team_verdicts(lines: DataFrame, *keys: str) -> DataFrame:
    """K14 for lines with ``fits``, whether the player's history has their team: ``verdict`` is
    kept, wrong or review.  Lines are equal if ``keys`` are too; null counts equal each other.

    One window, whose keys begin with the player: lines that are dealt by player stay where they are.
    """
    equal = Window.partitionBy("player_id", "season", "game_ts", "minutes", *COUNTS, *keys)
    several = F.coalesce(F.min("team_id").over(equal) < F.max("team_id").over(equal), F.lit(False))
    one = F.sum(F.col("fits").cast("int")).over(equal) == 1
    return lines.withColumn("verdict", F.when(~several, "kept").when(~one, "review").when(F.col("fits"), "kept").otherwise("wrong"))


def cross_team(lines: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of equal lines under several teams, that of the team in the player's history.

    Returns (kept, review): groups for which not exactly one team fits go to review.
    The history is joined as one row a player, so that lines are moved once.
    """
    teams = history.groupBy("player_id").agg(F.collect_set(F.struct("season", "team_id")).alias("__history"))
    fits = F.exists("__history", lambda h: (h.season == F.col("season")) & (h.team_id == F.col("team_id")))
    judged = team_verdicts(lines.join(teams, "player_id", "left").withColumn("fits", F.coalesce(fits, F.lit(False))))
    kept, review = (judged.filter(F.col("verdict") == v).select(*lines.columns) for v in ("kept", "review"))
    return kept, review


def ghosts(lines: DataFrame) -> DataFrame:
    """Nothing was played and nothing counted."""
    return lines.filter(F.greatest(*[F.abs(F.coalesce(F.col(c), F.lit(0))) for c in ("minutes", *COUNTS)]) == 0)


def season_rows(lines: DataFrame) -> DataFrame:
    """Games, starts and the last team of every player and season."""
    order = F.struct("game_ts", "game_id")
    return lines.groupBy("player_id", "season").agg(F.count(F.lit(1)).alias("games"), F.sum("started").cast("long").alias("games_started"), F.max_by("team_id", order).alias("team_id"), F.max_by("opponent_team_id", order).alias("last_opponent"))


def merged_boxes(lines: DataFrame, least: int = 320) -> DataFrame:
    """Team games with more minutes than two teams can play."""
    return box_sizes(lines).filter(f"minutes >= {least}")


def box_sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("team_id", "game_id").agg(F.count(F.lit(1)).alias("players"), F.sum("minutes").cast("long").alias("minutes"), F.sum(F.when(F.col("minutes") == 0, 1).otherwise(0)).cast("long").alias("idle"))


def clusters(frame: DataFrame, group: str, number: str, gap: int = 500, least: int = 4) -> DataFrame:
    """Runs of numbers without a gap over ``gap``, of at least ``least``."""
    w = Window.partitionBy(group).orderBy(number)
    new = F.coalesce((F.col(number) - F.lag(number).over(w) > gap).cast("int"), F.lit(1))
    island = frame.select(group, number).withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return island.groupBy(group, "island").agg(F.count(F.lit(1)).alias("size"), F.min(number).alias("low"), F.max(number).alias("high")).filter(f"size >= {least}")


def phantoms(box: DataFrame, least_players: int = 18, least_zero: int = 8, merged_minutes: int = 320, gap: int = 500, least: int = 4) -> DataFrame:
    """Box scores with many players of no minutes whose outer ids lie close together.

    ``box``: (team_id, game_id, player_id, minutes, external_id).  A box of so many minutes
    that two teams must be in it is another finding (K17).  Returns a row a suspect.
    """
    own = Window.partitionBy("team_id", "game_id")
    sums = {"players": F.count(F.lit(1)).over(own), "idle": F.sum((F.col("minutes") == 0).cast("int")).over(own), "total": F.sum("minutes").over(own)}
    counted = box.filter("team_id is not null and game_id is not null").withColumns(sums)
    odd = counted.filter((F.col("players") >= least_players) & (F.col("idle") >= least_zero) & (F.col("total") < merged_minutes))
    idle = odd.filter("minutes = 0 and external_id is not null")
    w = Window.partitionBy("team_id", "game_id").orderBy("external_id", "player_id")
    far = F.coalesce((F.col("external_id") - F.lag("external_id").over(w) > gap).cast("int"), F.lit(1))
    marked = idle.withColumn("far", far).withColumn("island", F.sum("far").over(w))
    size = F.count(F.lit(1)).over(Window.partitionBy("team_id", "game_id", "island"))
    return marked.withColumn("size", size).filter(F.col("size") >= least).select("team_id", "game_id", "player_id", "players", "idle", "size")


def ghost_rosters(roster: DataFrame, played: DataFrame, most: int = 26, gap: int = 500, least: int = 4, share: float = 0.5) -> DataFrame:
    """On too large rosters, clusters of outer ids without any line, half of whose
    names another team has too.

    ``roster``: (player_id, team_id, name_key, external_id); ``played``: (player_id).
    Returns (team_id, island, size, elsewhere) of the clusters.
    """
    large = roster.groupBy("team_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("team_id")
    names = roster.groupBy("name_key").agg(F.countDistinct("team_id").alias("teams"))
    seen = played.select("player_id").distinct().withColumn("seen", F.lit(1))
    rows = roster.filter("external_id is not null").join(large, "team_id").join(names, "name_key").join(seen, "player_id", "left")
    w = Window.partitionBy("team_id").orderBy("external_id", "player_id")
    far = F.coalesce((F.col("external_id") - F.lag("external_id").over(w) > gap).cast("int"), F.lit(1))
    marked = rows.withColumn("far", far).withColumn("island", F.sum("far").over(w))
    groups = marked.groupBy("team_id", "island").agg(F.count(F.lit(1)).alias("size"), F.sum((F.col("teams") > 1).cast("int")).alias("elsewhere"), F.count("seen").alias("with_lines"))
    return groups.filter((F.col("size") >= least) & (F.col("elsewhere") >= share * F.col("size")) & (F.col("with_lines") == 0)).select("team_id", "island", "size", "elsewhere")


def fill_blank(frame: DataFrame, incoming: DataFrame, key: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """Blanks from a second table, or all of them."""
    other = incoming.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    got = frame.join(other, key, "left")
    new = {c: F.coalesce(f"__{c}", c) if overwrite else F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"__{c}")) for c in columns}
    return got.withColumns(new).drop(*[f"__{c}" for c in columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of touched keys are replaced."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def corrected(frame: DataFrame, teams: DataFrame, column: str = "division") -> DataFrame:
    """The team table's value where it differs."""
    other = teams.select("team_id", F.col(column).alias("__new"))
    return frame.join(other, "team_id", "left").withColumn("changed", F.coalesce(~F.col(column).eqNullSafe(F.col("__new")) & F.col("__new").isNotNull(), F.lit(False))).withColumn(column, F.coalesce("__new", column)).drop("__new")


def one_external(players: DataFrame) -> DataFrame:
    """Of players with one name and team, those without an external id go if one has it."""
    w = Window.partitionBy(F.lower("name"), "team_id")
    has = F.col("external_id").isNotNull().cast("int")
    return players.withColumn("__m", F.max(has).over(w)).filter((F.col("__m") == 0) | F.col("external_id").isNotNull()).drop("__m")


def uncovered(games: DataFrame, lines: DataFrame) -> DataFrame:
    """Games without lines."""
    return games.join(lines.select("game_id").distinct(), "game_id", "left_anti")


def identities(seen: DataFrame, known: DataFrame) -> DataFrame:
    """By external id, then name and home town, then name and team, else a new id.

    New ids go on from the largest, in key order; the place within a partition of
    the key is added to the rows of the partitions before it, so no single task sorts
    all new names.
    """
    by = lambda name, *keys: known.groupBy(*keys).agg(F.min("player_id").alias(name))
    got = seen.join(by("a", "external_id"), "external_id", "left").join(by("b", "name_key", "hometown"), ["name_key", "hometown"], "left").join(by("c", "name_key", "team_id"), ["name_key", "team_id"], "left")
    got = got.withColumn("found", F.coalesce("a", "b", "c")).drop("a", "b", "c")
    fresh = numbered(got.filter("found is null").select("name_key", "team_id").distinct(), [], [F.col("name_key").asc(), F.col("team_id").asc()], "place")
    top = known.agg(F.coalesce(F.max("player_id"), F.lit(0)).alias("top"))  # one row
    new = fresh.crossJoin(F.broadcast(top)).select("name_key", "team_id", (F.col("top") + F.col("place")).alias("new_id"))
    return got.join(new, ["name_key", "team_id"], "left").withColumn("player_id", F.coalesce("found", "new_id")).drop("found", "new_id")


def our_side(sides: DataFrame, roster: DataFrame) -> DataFrame:
    """The side whose names overlap the roster more; a tie gives no row."""
    n = sides.join(roster.select("name_key").distinct(), "name_key").groupBy("game_id", "side").agg(F.countDistinct("name_key").alias("overlap"))
    w = Window.partitionBy("game_id")
    best = n.withColumns({"top": F.max("overlap").over(w)}).filter("overlap = top")
    return best.withColumn("ties", F.count(F.lit(1)).over(w)).filter("ties = 1").select("game_id", "side", "overlap")


def unresolved(lines: DataFrame) -> DataFrame:
    """The one team that all lines of an unresolved player agree on."""
    return lines.filter("team_id = -1").groupBy("player_id").agg(F.countDistinct("candidate").alias("n"), F.min("candidate").alias("team_id")).filter("n = 1").select("player_id", "team_id")
