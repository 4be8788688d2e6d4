"""The logical tables over a star schema of nations, customers, orders and line items.

A nation is a team, a customer a player, the part of an order that one supplier
nation serves is one player's line in a game against that nation.  The two
dimensions with a fixed number of rows (nation, region) are broadcast; all other
joins are left to the optimiser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.sources.shared import written

#: How often a year's class comes, and positions by market segment.
CLASS_YEARS = ("FR", "SO", "JR", "SR", "GR")
POSITIONS = {"BUILDING": "G", "HOUSEHOLD": "G", "AUTOMOBILE": "F", "FURNITURE": "F", "MACHINERY": "C"}

#: Line items of a task of the joins and sums, of some 800 bytes of memory each.
ITEMS = 500_000

#: Suppliers that are broadcast, some 60 bytes each; to more than these the items are dealt.
SUPPLIERS = 500_000


def count_when(condition: str) -> Column:
    return F.sum(F.when(F.expr(condition), 1).otherwise(0)).cast("long")


@dataclass(frozen=True)
class Star:
    """Lazy frames of one table folder; each property is a plan, nothing is read."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def teams(self) -> DataFrame:
        joined = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        tier = F.when(F.col("n_regionkey").isin(0, 1), "High-Major").when(F.col("n_regionkey").isin(2, 3), "Mid-Major").otherwise("Low-Major")
        division = F.when(F.col("n_regionkey") == 4, "D2").otherwise("D1")
        return joined.select(F.col("n_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("name"), F.col("r_name").alias("conference"), tier.alias("tier"), division.alias("division"))

    @cached_property
    def players(self) -> DataFrame:
        key = F.col("c_custkey")
        position = F.coalesce(*[F.when(F.col("c_mktsegment") == s, p) for s, p in POSITIONS.items()])
        inches = (F.lit(66) + key % 18).cast("int")
        return self.table("customer").select(
            key.cast("long").alias("player_id"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").cast("long").alias("team_id"),
            position.alias("position"),
            F.element_at(F.array(*map(F.lit, CLASS_YEARS)), (key % 5 + 1).cast("int")).alias("class_year"),
            F.concat(F.floor(inches / 12).cast("string"), F.lit("' "), (inches % 12).cast("string"), F.lit('"')).alias("height"),
            inches.alias("height_in"),
            F.when(key % 7 == 0, True).when(key % 7 == 1, False).alias("in_transfer_portal"),
        )

    @cached_property
    def tasks(self) -> int:
        """Tasks that the line items need, so that a task's share is bounded at any size of
        the table; 0 where Spark's own number is enough.  Counted from the files' footers."""
        needed = -(-self.table("lineitem").count() // ITEMS)
        return needed if needed > min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism) else 0

    def dealt(self, frame: DataFrame, *keys: str) -> DataFrame:
        """A frame of the size of the lines by keys, to so many tasks."""
        return frame.repartition(self.tasks, *keys) if self.tasks else frame

    @contextmanager
    def finely(self) -> Iterator[None]:
        """While tables are written: the items are scanned in that many tasks too, as a split
        of the usual size may hold millions, which a shuffle to many tasks keeps in memory."""
        name = "spark.sql.files.minPartitionNum"
        was = self.spark.conf.get(name, None)
        if self.tasks > int(was or 0):
            self.spark.conf.set(name, self.tasks)
        try:
            yield
        finally:
            self.spark.conf.unset(name) if was is None else self.spark.conf.set(name, was)

    @cached_property
    def lines(self) -> DataFrame:
        """One row a player, order and opponent: a game line."""
        item = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
        order = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        player = self.table("customer").select("c_custkey", "c_nationkey")
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        few = self.table("supplier").count() <= SUPPLIERS
        met = item.join(F.broadcast(supplier), F.col("l_suppkey") == F.col("s_suppkey")) if few else self.dealt(item, "l_suppkey").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        served = self.dealt(met, "l_orderkey")
        ordered = self.dealt(served.join(order, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey")
        joined = ordered.join(player, F.col("o_custkey") == F.col("c_custkey")).filter("c_nationkey <> s_nationkey")
        quantity = F.col("l_quantity").cast("int")
        return (
            joined.groupBy("o_custkey", "o_orderdate", "l_orderkey", "c_nationkey", "s_nationkey")
            .agg(
                F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).cast("int").alias("started"),
                (F.sum(quantity) % 40 + 1).cast("long").alias("minutes"),
                F.sum(quantity % 31).cast("long").alias("points"),
                F.sum("l_linenumber").cast("long").alias("rebounds"),
                F.count(F.lit(1)).alias("assists"),
                count_when("l_returnflag = 'R'").alias("steals"),
                count_when("l_returnflag = 'A'").alias("blocks"),
                F.sum(F.round(F.col("l_tax") * 100).cast("int")).cast("long").alias("turnovers"),
                (F.sum("l_linenumber") % 6).cast("long").alias("fouls"),
                F.sum(quantity).cast("long").alias("fga"),
                F.sum(F.floor(F.col("l_quantity") / 2).cast("int")).cast("long").alias("fgm"),
                count_when("l_quantity > 10").alias("tfga"),
                count_when("l_quantity > 30").alias("tfgm"),
                F.sum(F.round(F.col("l_discount") * 100).cast("int")).cast("long").alias("fta"),
            )
            .select(
                F.col("o_custkey").cast("long").alias("player_id"),
                F.year("o_orderdate").cast("int").alias("season"),
                (F.col("l_orderkey") * 100 + F.col("s_nationkey")).cast("long").alias("game_id"),
                F.col("o_orderdate").alias("game_ts"),
                F.col("c_nationkey").cast("long").alias("team_id"),
                F.col("s_nationkey").cast("long").alias("opponent_team_id"),
                "started", "minutes", "points", "rebounds", "assists", "steals", "blocks", "turnovers", "fouls", "fga", "fgm", "tfga", "tfgm", "fta",
                F.floor(F.col("fta") * 0.7).cast("long").alias("ftm"),
            )
        )

    def once(self, name: str, make: Callable[[], DataFrame], *partitions: str) -> DataFrame:
        """A frame that several parts of one query use: written once, by partitions."""
        kept = self.__dict__.setdefault("_kept", {})
        if name not in kept:
            with self.finely():
                kept[name] = written(make(), name, *partitions)
        return kept[name]

    def bounded(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A frame over all lines of a query that doesn't write these: written itself where the
        items need many tasks, so that they are scanned in as many."""
        return self.once(name, make) if self.tasks else make()

    def keep_lines(self) -> Star:
        """Write the lines by season, for plans that read them in several roles: the joins
        and the aggregate below them run once, and a season's filter reaches the scan."""
        if "_lines" not in self.__dict__:
            with self.finely():
                self.__dict__["_lines"] = self.__dict__["lines"] = written(self.lines, "lines", "season")
            self.__dict__.pop("games", None)
        return self

    @cached_property
    def latest(self) -> int | None:
        """The season with the most lines, of equals the last: a count of few columns."""
        row = self.lines.groupBy("season").count().orderBy(F.col("count").desc(), F.col("season").desc()).first()
        return row.season if row else None

    def of_latest(self, frame: DataFrame) -> DataFrame:
        """Rows of the latest season; the filter goes down to the lines' partitions."""
        return frame.filter(F.col("season") == F.lit(self.latest).cast("int"))

    @cached_property
    def games(self) -> DataFrame:
        """A season's meetings of an ordered pair of teams as one game."""
        return self.lines.groupBy("season", F.col("team_id").alias("home_team_id"), F.col("opponent_team_id").alias("away_team_id")).agg(
            F.sum("points").alias("home_score"), (F.sum("rebounds") * 3).alias("away_score"), F.count(F.lit(1)).alias("n")
        )


#: The same tables for DuckDB, as common table expressions.
ORACLE = """
with teams as (
  select cast(n_nationkey as bigint) as team_id, n_name as name, r_name as conference,
    case when n_regionkey in (0,1) then 'High-Major' when n_regionkey in (2,3) then 'Mid-Major' else 'Low-Major' end as tier,
    case when n_regionkey = 4 then 'D2' else 'D1' end as division
  from nation join region on n_regionkey = r_regionkey),
players as (
  select cast(c_custkey as bigint) as player_id, c_name as name, cast(c_nationkey as bigint) as team_id,
    case c_mktsegment when 'BUILDING' then 'G' when 'HOUSEHOLD' then 'G' when 'AUTOMOBILE' then 'F' when 'FURNITURE' then 'F' when 'MACHINERY' then 'C' end as position,
    (['FR','SO','JR','SR','GR'])[c_custkey % 5 + 1] as class_year,
    cast((66 + c_custkey % 18) // 12 as varchar) || ''' ' || cast((66 + c_custkey % 18) % 12 as varchar) || '"' as height,
    cast(66 + c_custkey % 18 as int) as height_in,
    case when c_custkey % 7 = 0 then true when c_custkey % 7 = 1 then false end as in_transfer_portal
  from customer),
lines as (
  select cast(o_custkey as bigint) as player_id, cast(year(o_orderdate) as int) as season, cast(l_orderkey * 100 + s_nationkey as bigint) as game_id,
    o_orderdate as game_ts, cast(c_nationkey as bigint) as team_id, cast(s_nationkey as bigint) as opponent_team_id,
    cast(max(case when l_linestatus = 'O' then 1 else 0 end) as int) as started,
    cast(sum(cast(l_quantity as int)) % 40 + 1 as bigint) as minutes,
    cast(sum(cast(l_quantity as int) % 31) as bigint) as points,
    cast(sum(l_linenumber) as bigint) as rebounds, count(*) as assists,
    cast(count(*) filter (l_returnflag = 'R') as bigint) as steals, cast(count(*) filter (l_returnflag = 'A') as bigint) as blocks,
    cast(sum(cast(round(l_tax * 100) as int)) as bigint) as turnovers, cast(sum(l_linenumber) % 6 as bigint) as fouls,
    cast(sum(cast(l_quantity as int)) as bigint) as fga, cast(sum(cast(floor(l_quantity / 2) as int)) as bigint) as fgm,
    cast(count(*) filter (l_quantity > 10) as bigint) as tfga, cast(count(*) filter (l_quantity > 30) as bigint) as tfgm,
    cast(sum(cast(round(l_discount * 100) as int)) as bigint) as fta,
    cast(floor(cast(sum(cast(round(l_discount * 100) as int)) as double) * 0.7::double) as bigint) as ftm
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where c_nationkey <> s_nationkey
  group by o_custkey, o_orderdate, l_orderkey, c_nationkey, s_nationkey),
games as (
  select season, team_id as home_team_id, opponent_team_id as away_team_id, cast(sum(points) as bigint) as home_score,
    cast(sum(rebounds) * 3 as bigint) as away_score, count(*) as n
  from lines group by season, team_id, opponent_team_id),
sides as (
  select season, home_team_id as team_id, away_team_id as opponent_team_id, home_score as scored, away_score as allowed, true as home from games
  union all select season, away_team_id, home_team_id, away_score, home_score, false from games),
current as (select season from lines group by season order by count(*) desc, season desc limit 1)
"""
