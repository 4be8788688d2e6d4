"""Text functions for names, heights, classes and scores: column to column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations in team names.
ABBREVIATIONS = {
    "mo.": "missouri", "conn.": "connecticut", "n.h.": "new hampshire",
    "okla.": "oklahoma", "wash.": "washington", "neb.": "nebraska", "ark.": "arkansas",
    "fla.": "florida", "colo.": "colorado", "ga.": "georgia", "n.m.": "new mexico",
    "ill.": "illinois", "mich.": "michigan", "minn.": "minnesota", "wis.": "wisconsin",
    "tenn.": "tennessee", "mass.": "massachusetts", "calif.": "california", "ky.": "kentucky",
    "ind.": "indiana", "tex.": "texas", "ala.": "alabama", "miss.": "mississippi",
    "va.": "virginia", "n.c.": "north carolina", "s.c.": "south carolina", "n.d.": "north dakota",
    "s.d.": "south dakota", "penn.": "pennsylvania", "sch.": "school", "dom.": "dominguez",
    "atl.": "atlantic",
    "fran.": "francisco", "int'l": "international",
}
CLASSES = {"fr": "FR", "freshman": "FR", "so": "SO", "sophomore": "SO", "jr": "JR", "junior": "JR", "sr": "SR", "senior": "SR", "gr": "GR", "graduate": "GR"}


def normalize(x: Column) -> Column:
    """Lower case, letters, digits and single spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9 ]", ""), "\\s+", " ")


def expand(x: Column) -> Column:
    """State abbreviations; ``St.`` is State unless it comes first."""
    table = F.create_map(*[F.lit(v) for pair in ABBREVIATIONS.items() for v in pair])
    key = lambda w: F.rtrim(F.lower(w), F.lit(","))
    words = F.filter(F.split(x, "\\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when(key(w).isin("st.", "st") & (i > 0), "State").otherwise(F.coalesce(F.try_element_at(table, key(w)), w))), " ")


def narrow(x: Column) -> Column:
    """T03."""
    return normalize(expand(F.coalesce(x, F.lit(""))))


def team_name(x: Column) -> Column:
    """Without institution words."""
    return F.trim(F.regexp_replace(F.regexp_replace(narrow(x), "\\b(university|college|univ)\\b", ""), "\\s+", " "))


def name_key(x: Column) -> Column:
    """Words in order of the alphabet, so that it doesn't matter which name is first."""
    return F.array_join(F.array_sort(F.filter(F.split(normalize(x), " "), lambda w: w != "")), " ")


def without_parenthesis(x: Column) -> Column:
    """T06."""
    return F.trim(F.regexp_replace(x, "\\s*\\([^)]*\\)\\s*$", ""))


def directory_name(x: Column) -> Column:
    """For the outer directory."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(x), "&", " and "), "\\bst\\b\\.?", "state")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]", " "), "\\s+", " "))


def height_inches(x: Column) -> Column:
    """Feet and optional inches; null if it is no height."""
    feet, inches = F.regexp_extract(x, "^\\s*(\\d+)\\s*['\\-]\\s*(\\d*)", 1), F.regexp_extract(x, "^\\s*(\\d+)\\s*['\\-]\\s*(\\d*)", 2)
    return F.when(feet != "", F.expr("0") + feet.try_cast("int") * 12 + F.coalesce(inches.try_cast("int"), F.lit(0)))


def normal_height(x: Column) -> Column:
    """``5-8`` as ``5' 8"``; anything else trimmed."""
    return F.when(F.trim(x).rlike("^\\d+-\\d+"), F.regexp_replace(F.regexp_extract(F.trim(x), "^(\\d+-\\d+)", 1), "^(\\d+)-(\\d+)$", "$1' $2\"")).otherwise(F.nullif(F.trim(x), F.lit("")))


def normal_class(x: Column) -> Column:
    """Known names to two letters, others kept."""
    key = F.regexp_replace(F.lower(F.trim(x)), "[.]", "")
    table = F.create_map(*[F.lit(v) for pair in CLASSES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, key), F.trim(x))


def made_attempted(x: Column) -> tuple[Column, Column]:
    """Both parts of ``7-9``, or zeros."""
    parts = F.split(x, "-")
    a, b = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    good = a.isNotNull() & b.isNotNull() & (F.size(parts) == 2)
    return F.when(good, a).otherwise(0), F.when(good, b).otherwise(0)


def int_or_zero(x: Column) -> Column:
    """Whole numbers only, as a strict parser would."""
    return F.when(x.rlike("^\\s*[-+]?\\d+\\s*$"), F.trim(x).try_cast("int")).otherwise(0)


def split_name(x: Column) -> tuple[Column, Column]:
    """(first, last), also from ``Last, First``."""
    words = F.split(F.trim(x), "\\s+", 2)
    comma = F.split(x, ",", 2)
    return F.when(F.contains(x, F.lit(",")), F.trim(F.get(comma, 1))).otherwise(F.get(words, 0)), F.when(F.contains(x, F.lit(",")), F.trim(F.get(comma, 0))).otherwise(F.coalesce(F.get(words, 1), F.lit("")))


def hometown(x: Column) -> tuple[Column, Column]:
    """(home town, school) of ``Town, ST / School``."""
    parts = F.split(x, "/", 2)
    return F.nullif(F.trim(F.get(parts, 0)), F.lit("")), F.nullif(F.trim(F.get(parts, 1)), F.lit(""))


def undoubled(x: Column) -> Column:
    """A name that is its own double is written once."""
    half = F.floor(F.length(x) / 2).cast("int")
    return F.when((F.length(x) % 2 == 0) & (F.substring(x, F.lit(1), half) == F.substring(x, half + 1, half)), F.substring(x, F.lit(1), half)).otherwise(x)


def season_label(end_year: Column) -> Column:
    """2026 is ``2025-26``."""
    return F.concat((end_year - 1).cast("string"), F.lit("-"), F.lpad((end_year % 100).cast("string"), 2, "0"))


def season_end(label: Column) -> Column:
    return F.substring(label, 1, 4).try_cast("int") + 1


def season_short(label: Column) -> Column:
    """``2025-2026`` as ``2025-26``."""
    return F.regexp_replace(label, "^(\\d{4})-\\d{2}(\\d{2})$", "$1-$2")


def plain_opponent(x: Column) -> Column:
    """Without tags, entities and leading place words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), "&amp;", "&"), "^\\s*(vs\\.?|at|@)\\s+|\\s+", " "))


def id_of_url(x: Column) -> Column:
    """The first pattern that finds an id."""
    found = [F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in ("rp_id=(\\d+)", "/roster/[^/]+/(\\d+)", "/(\\d+)(?:[/?#.]|$)")]
    return F.coalesce(*found)


def site_type(url: Column) -> Column:
    """S30."""
    u = F.lower(url)
    return F.when(u.rlike("/sports/[a-z]+/\\d{4}-\\d{2}"), "slug").when(u.rlike("/sports/[a-z-]+"), "path").when(u.isNull() | (u == ""), "none").otherwise("unknown")


def url_base(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, "^(https?://[^/?#]+)", 1)


def transfer_rows(frame: DataFrame, column: str, most: int = 6) -> DataFrame:
    """``Team (2021-2023) -> Other (2024)`` as (team, season) rows.

    A history with any part that can't be read, or a span over ``most``, gives none.
    """
    pattern = "^\\s*(.+?)\\s*\\((\\d{4})(?:-(\\d{4}))?\\)\\s*$"
    parts = F.split(F.col(column), "->")
    read = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, pattern, 1).alias("team"), F.regexp_extract(p, pattern, 2).try_cast("int").alias("a"), F.coalesce(F.regexp_extract(p, pattern, 3).try_cast("int"), F.regexp_extract(p, pattern, 2).try_cast("int")).alias("b")))
    good = F.forall(read, lambda r: r.a.isNotNull() & (r.b >= r.a) & (r.b - r.a < most))
    rows = frame.withColumn("__parts", F.when(good, read)).select("*", F.inline("__parts")).drop("__parts")
    return rows.withColumn("season", F.explode(F.sequence("a", "b"))).drop("a", "b")


def name_index(teams: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, team_id), safe from collisions in two tiers.

    A first-tier key (the name as it is) counts only if one team has it; a second-tier
    key (without its parenthesis, or an alias) only if the first tier's kept keys
    don't have it and one team has it.
    """
    first = teams.select("team_id", F.explode(F.array(normalize(F.col("name")), narrow(F.col("name")), narrow(F.regexp_replace("name", "-", " ")))).alias("key"))
    stripped = without_parenthesis(F.col("name"))
    second = teams.filter(stripped != F.col("name")).select("team_id", narrow(stripped).alias("key"))
    if aliases is not None:
        second = second.unionByName(aliases.select("team_id", narrow(F.col("alias")).alias("key")))

    def single(keys: DataFrame) -> DataFrame:
        return keys.filter("key <> ''").groupBy("key").agg(F.countDistinct("team_id").alias("n"), F.min("team_id").alias("team_id")).filter("n = 1").select("key", "team_id")

    kept = single(first)
    return kept.unionByName(single(second).join(kept.select("key"), "key", "left_anti"))


def resolve(names: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """team_id for a literal name; its own parenthesis is never taken off."""
    keyed = names.select("*", F.array_distinct(F.array(normalize(F.col(column)), narrow(F.col(column)), narrow(F.regexp_replace(column, "-", " ")))).alias("__keys"))
    found = keyed.select(column, F.posexplode("__keys").alias("place", "key")).distinct().join(index, "key").groupBy(column).agg(F.min_by("team_id", "place").alias("team_id"))
    return keyed.drop("__keys").join(found, column, "left")
