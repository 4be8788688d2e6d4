"""Fuzzy matching of names as a similarity join.

The ratio of two names is 2 M / T: M characters in matching blocks (the longest common
block, then the longest on either side of it), T characters in all.  Its own bounds make
it a join:

* M is at most the number of shared characters, so lengths and an overlap of characters
  (numbered: the second ``a`` of a name is a token of its own) are needed;
* blocks are parted by characters outside them, so with s shared pairs of neighbours M is
  at most (s + T + 1) / 3.

An inverted index has each choice under its rarest tokens only, as many as such an overlap
needs (prefix filter); names look up theirs.  Tokens are pairs of neighbours where the ratio
asks for some, else single characters.  The names and choices of one token meet as tables:
their shared grams are a product of matrices, and only pairs that pass both bounds become
rows.  They get the ratio itself, many pairs at a time.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Names and choices of one token that meet in one group; a token with more is split.
GROUP, OFFERED = 2_000, 20_000
#: Columns of a table of grams.
WIDE = 2_048
#: From this length on, frequent characters are left out of the search for blocks.
LONG = 200


def needed(size: int, cutoff: float, total: Column) -> Column:
    """Shared grams that a ratio of ``cutoff`` needs in names of ``total`` characters."""
    return F.ceil(total * (cutoff / 2) - 1e-9) if size == 1 else F.ceil(total * (1.5 * cutoff - 1) - 1 - 1e-9)


def least_total(cutoff: float) -> Column:
    """Characters of a name and the shortest other that it may match."""
    return F.length("name") + F.ceil(F.length("name") * (cutoff / (2 - cutoff)) - 1e-9)


def tokens(names: DataFrame, cutoff: float) -> DataFrame:
    """(id, name, size, token, count, need): the numbered grams of both sizes of every name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size in (1, 2):
                rows, of = counted(frame.name.tolist(), size)
                of = [f"{g}\u0001{n}" for g, n in of]
                yield pd.DataFrame({"id": frame.id.to_numpy()[rows], "name": frame.name.to_numpy()[rows], "size": np.int32(size), "token": pd.Series(of, dtype=object), "count": np.bincount(rows, minlength=1)[rows].astype(np.int32)})

    got = names.select("id", "name").mapInPandas(run, "id long, name string, size int, token string, count int")
    need = [needed(size, cutoff, least_total(cutoff)) for size in (1, 2)]
    return got.withColumn("need", F.when(F.col("size") == 1, need[0]).otherwise(need[1]))


def rarest(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The prefix of each name: its rarest tokens, so many that a match shares one."""
    order = Window.partitionBy("id", "size").orderBy(F.coalesce("places", F.lit(0)), "token")
    placed = rows.join(places, ["size", "token"], "left").withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= F.col("count") - F.greatest("need", F.lit(1)) + 1)


def pairs(names: DataFrame, choices: DataFrame, cutoff: float) -> DataFrame:
    """(id, name, choice_id, choice): pairs that may have the ratio, of (id, name) each."""
    asked, offered = tokens(names, cutoff), tokens(choices, cutoff)
    places = offered.groupBy("size", "token").agg(F.count(F.lit(1)).alias("places"))
    # pairs of neighbours where such a match must share one, else single characters
    two = F.max(F.when((F.col("size") == 2) & (F.col("need") >= 1), 2).otherwise(1)).over(Window.partitionBy("id"))
    ask = rarest(asked.withColumn("two", two).filter("size = two").drop("two"), places).select("size", "token", "id", "name")
    offer = rarest(offered, places).select("size", "token", F.col("id").alias("choice_id"), F.col("name").alias("choice"))
    often = lambda df, most, parts: df.groupBy("size", "token").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(parts))
    cells = often(ask, GROUP, "parts").join(often(offer, OFFERED, "slices"), ["size", "token"])
    part = lambda key, parts: F.pmod(F.xxhash64(key), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    ask = ask.join(cells, ["size", "token"]).withColumn("part", part("id", "parts")).withColumn("slice", every("slices")).drop("parts", "slices")
    offer = offer.join(cells, ["size", "token"]).withColumn("slice", part("choice_id", "slices")).withColumn("part", every("parts")).drop("parts", "slices")
    keys = ["size", "token", "part", "slice"]
    # few bytes and much work: tasks are stated, else small shuffles end in one task
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ask, offer = ask.repartition(tasks, *keys), offer.repartition(tasks, *keys)
    met = ask.groupBy(*keys).cogroup(offer.groupBy(*keys)).applyInPandas(lambda x, y: near(x, y, cutoff), "id long, name string, choice_id long, choice string")
    return met.repartition(tasks, "id", "choice_id").distinct()


def counted(names: list[str], size: int) -> tuple[np.ndarray, list[tuple[str, int]]]:
    """The numbered grams of all names, and the name that each is of."""
    rows, out = [], []
    for row, name in enumerate(names):
        seen: dict[str, int] = {}
        for i in range(len(name) - size + 1):
            g = name[i : i + size]
            seen[g] = seen.get(g, 0) + 1
            rows.append(row)
            out.append((g, seen[g]))
    return np.array(rows, np.int64), out


def shared(a: list[str], b: list[str], size: int) -> np.ndarray:
    """How many grams every name of ``a`` shares with every one of ``b``: a product of 0/1 tables."""
    (rows_a, of_a), (rows_b, of_b) = counted(a, size), counted(b, size)
    place = {g: i for i, g in enumerate(set(of_a) & set(of_b))}
    at_a, at_b = (np.array([place.get(g, -1) for g in of], np.int64) for of in (of_a, of_b))
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(place), WIDE):
        tables = []
        for rows, at, n in ((rows_a, at_a, len(a)), (rows_b, at_b, len(b))):
            inside = (at >= low) & (at < low + WIDE)
            table = np.zeros((n, min(WIDE, len(place) - low)), np.float32)
            table[rows[inside], at[inside] - low] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def near(asked: pd.DataFrame, offered: pd.DataFrame, cutoff: float) -> pd.DataFrame:
    """The pairs of one token's names and choices that pass both bounds."""
    out = [pd.DataFrame({"id": pd.Series(dtype="int64"), "name": pd.Series(dtype=str), "choice_id": pd.Series(dtype="int64"), "choice": pd.Series(dtype=str)})]
    for low in range(0, len(offered) if len(asked) else 0, GROUP):
        some = offered.iloc[low : low + GROUP]
        names, choices = asked.name.tolist(), some.choice.tolist()
        total = np.array([len(n) for n in names])[:, None] + np.array([len(c) for c in choices])
        passed = shared(names, choices, 1) >= np.ceil(total * (cutoff / 2) - 1e-9)
        if passed.any():
            passed &= shared(names, choices, 2) >= np.ceil(total * (1.5 * cutoff - 1) - 1 - 1e-9)
        i, j = np.nonzero(passed)
        if len(i):
            out.append(pd.DataFrame({"id": asked.id.to_numpy()[i], "name": asked.name.to_numpy()[i], "choice_id": some.choice_id.to_numpy()[j], "choice": some.choice.to_numpy()[j]}))
    return pd.concat(out) if len(out) > 1 else out[0]


def matching(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in matching blocks of each pair: all pairs advance together."""
    most_a, most_b = max(map(len, a), default=0), max(map(len, b), default=0)
    wide = lambda x, most, fill: np.array([[*map(ord, s), *[fill] * (most - len(s))] for s in x], np.int32).reshape(len(x), most)
    left, right = wide(a, most_a, -1), wide(b, most_b, -2)
    out = np.zeros(len(a), np.int64)
    pair = np.arange(len(a))
    a_low, a_high = np.zeros(len(a), np.int64), np.array([len(s) for s in a], np.int64)
    b_low, b_high = np.zeros(len(b), np.int64), np.array([len(s) for s in b], np.int64)
    at = np.arange(right.shape[1])
    while len(pair):
        inside = (at >= b_low[:, None]) & (at < b_high[:, None])
        run = np.zeros((len(pair), right.shape[1] + 1), np.int32)
        best, best_a, best_b = (np.zeros(len(pair), np.int64) for _ in range(3))
        mine = right[pair]
        for i in range(int(a_low.min()), int(a_high.max())):
            live = (i >= a_low) & (i < a_high)
            same = (left[pair, i][:, None] == mine) & inside & live[:, None]
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            size = run.max(axis=1)
            better = np.flatnonzero(size > best)  # the first of equal ones stays
            best[better] = size[better]
            best_a[better], best_b[better] = i + 1 - size[better], run[better].argmax(axis=1) - size[better]
        np.add.at(out, pair, best)
        hit = np.flatnonzero(best)
        sides = [(a_low, best_a, b_low, best_b), (best_a + best, a_high, best_b + best, b_high)]
        pair, a_low, a_high, b_low, b_high = (np.concatenate(x) for x in zip(*[(pair[hit], s[0][hit], s[1][hit], s[2][hit], s[3][hit]) for s in sides], strict=True))
        some = (a_low < a_high) & (b_low < b_high)
        pair, a_low, a_high, b_low, b_high = pair[some], a_low[some], a_high[some], b_low[some], b_high[some]
    return out


@F.pandas_udf(DoubleType())
def ratio(choice: pd.Series, name: pd.Series) -> pd.Series:
    """2 M / T of each pair, 1 for two empty names."""
    a, b = choice.tolist(), name.tolist()
    long = [len(x) >= LONG for x in b]
    found = matching(["" if far else x for x, far in zip(a, long, strict=True)], ["" if far else x for x, far in zip(b, long, strict=True)])
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    out = np.where(total > 0, 2.0 * found / np.maximum(total, 1), 1.0)
    for i in np.flatnonzero(long):
        out[i] = difflib.SequenceMatcher(None, a[i], b[i]).ratio()
    return pd.Series(out)


def close_matches(names: DataFrame, choices: DataFrame, cutoff: float = 0.87, top: int = 1) -> DataFrame:
    """(name, place, choice, ratio): of every distinct name the ``top`` distinct
    choices with a ratio of ``cutoff`` and more; of equal ratios the later name in order.

    Both frames have a column ``name``; null and empty names match nothing.
    """
    distinct = lambda df: df.select("name").filter("name <> ''").distinct().select(F.xxhash64("name").alias("id"), "name")
    found = pairs(distinct(names), distinct(choices), cutoff).select("name", "choice", ratio("choice", "name").alias("ratio")).filter(F.col("ratio") >= cutoff)
    order = Window.partitionBy("name").orderBy(F.desc("ratio"), F.desc("choice"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("name", "place", "choice", "ratio")


def matches(names: DataFrame, column: str, overrides: DataFrame, exact: DataFrame, choices: DataFrame, cutoff: float = 0.87) -> DataFrame:
    """Override, then exact, then fuzzy, else unmatched; all from tables.

    ``overrides`` and ``exact`` are (name, team), one team a name; ``choices`` has ``name``.
    """
    o = names.join(overrides.select(F.col("name").alias(column), F.col("team").alias("over")), column, "left").join(exact.select(F.col("name").alias(column), F.col("team").alias("same")), column, "left")
    asked = o.filter("over is null and same is null").select(F.col(column).alias("name"))
    found = close_matches(asked, choices, cutoff).select(F.col("name").alias(column), F.col("choice").alias("match"))
    kind = F.when(F.col("over").isNotNull(), "override").when(F.col("same").isNotNull(), "exact").when(F.col("match").isNotNull(), "fuzzy").otherwise("unmatched")
    return o.join(found, column, "left").withColumns({"kind": kind, "team": F.coalesce("over", "same", "match")}).drop("over", "same", "match")
