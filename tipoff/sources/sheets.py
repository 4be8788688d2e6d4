"""Sheets exported as CSV, with types folded from their cells.

A sheet may have lines above its header and a header of any order.  Every cell is read as
text; the header is the first row that has the wanted names; the type of a column is the
narrowest that holds all its cells (whole number, decimal number, text), found by one
aggregate over the sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.sources.tables import SCHEMAS, conform

#: The lattice: a column's kind is the largest of its cells'.
KINDS = ("bigint", "double", "string")
#: Columns of a sheet, at most.
MOST = 120
WHOLE, DECIMAL = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def width(spark: SparkSession, path: str) -> int:
    """Columns that no row of a sheet goes beyond: its most commas in a line, and one."""
    commas = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))
    return min(MOST, 1 + (spark.read.text(path).agg(F.max(commas).alias("most")).first().most or 0))


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(place, cells): the rows of a sheet as text, blank as null, all-blank rows left out."""
    wide = ", ".join(f"c{i} string" for i in range(width(spark, path)))  # else the first line says how many there are
    rows = spark.read.schema(wide).option("header", False).csv(path)
    texts = [F.when(F.trim(c) != "", F.col(c)).alias(c) for c in rows.columns]
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    placed = rows.select(F.struct(file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("row")).alias("place"), F.array(*texts).alias("cells"))
    return placed.filter(F.exists("cells", lambda c: c.isNotNull()))


def normal(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s_]+", "_")


def kind(cell: Column) -> Column:
    """A cell's place in the lattice; null for a blank one, which fits everywhere."""
    return F.when(cell.isNull(), None).when(cell.rlike(WHOLE), 0).when(cell.rlike(DECIMAL), 1).otherwise(2)


def read_sheet(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The sheet's columns by its own header, typed.

    Rows above the header and all-blank ones are left out; a column without a name is left
    out; of two of one name the first counts.  A sheet without a header with the wanted
    names is an error.
    """
    rows = cells(spark, path)
    names = F.transform("cells", normal)
    # a header has the first word of each name in its text: few rows get their cells normalised
    text = F.lower(F.concat_ws(",", "cells"))
    likely = F.forall(F.array(*[F.lit(w.lower().split("_")[0]) for w in wanted]), lambda w: text.contains(w))
    head = rows.filter(likely).filter(F.size(F.array_except(F.array(*[F.lit(w.lower()) for w in wanted]), names)) == 0)
    first = head.orderBy("place").select("place", names.alias("names")).first()
    if first is None:
        raise ValueError(f"no row of {path} has the names {wanted}")
    p = first["place"]
    after = (F.col("place.file") > p["file"]) | ((F.col("place.file") == p["file"]) & ((F.col("place.start") > p["start"]) | ((F.col("place.start") == p["start"]) & (F.col("place.row") > p["row"]))))
    # an export in several files has its header in each
    body = rows.filter(after).filter(~likely | ~names.eqNullSafe(F.array(*[F.lit(n) for n in first["names"]])))
    place = {n: first["names"].index(n) for n in dict.fromkeys(first["names"]) if n}
    texts = body.select(*[F.get("cells", F.lit(i)).alias(n) for n, i in place.items()])
    kinds = texts.agg(*[F.max(kind(F.col(f"`{n}`"))).alias(n) for n in place]).first()  # one row
    return texts.select(*[F.trim(f"`{n}`").try_cast(KINDS[kinds[n]]).alias(n) if kinds[n] is not None and kinds[n] < 2 else F.col(f"`{n}`") for n in place])


#: The sheets of a workbook and the names that their header must have.
SHEETS = {
    "teams": ["team_id", "name"],
    "players": ["player_id", "name", "team_id"],
    "games": ["game_id", "season", "home_team_id", "away_team_id"],
    "player_game_logs": ["player_id", "game_id", "season", "minutes"],
    "meta": ["key", "value"],
}


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five relations of an exported workbook (a CSV or a folder of it a sheet), each
    in its table's schema: missing columns as nulls, others left out."""
    return {name: conform(read_sheet(spark, f"{path}/{name}.csv", wanted), SCHEMAS[name]) for name, wanted in SHEETS.items()}
