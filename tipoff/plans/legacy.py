"""Superseded forms, the prototype's summaries, client-side lists and longer repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions import model as M
from tipoff.operators import profiles as P
from tipoff.operators import quality as K
from tipoff.operators import ratings as R
from tipoff.plans.boards import rate
from tipoff.plans.models import PROJECTED, RATINGS, TOTALS, current_players, current_ratings, projected, solved
from tipoff.plans.registry import query
from tipoff.sources.star import Star


@query("a24_latest_seasons", "select (select season from current) as most_lines, (select max_by(season, game_ts) from lines) as last_date")
def latest(s: Star) -> DataFrame:
    """The two definitions of the latest season."""
    by_date = s.lines.agg(F.max_by("season", "game_ts").alias("last_date"))
    return P.latest_season(s.lines).withColumnRenamed("season", "most_lines").crossJoin(by_date)


@query(
    "m30_old_summary",
    ", v as (select l.player_id, l.season, (points + rebounds + assists + steals + blocks - turnovers) * 40.0 / greatest(minutes, 1) as v, case when abs(m.home_score - m.away_score) <= 12 then 1.0 else greatest(0.25, least(1.0, 1 - (abs(m.home_score - m.away_score) - 12) / 18.0)) end * greatest(0.3, least(1.0, greatest(minutes, 1) / 15.0)) as w from lines l left join games m on m.season = l.season and m.home_team_id = l.team_id and m.away_team_id = l.opponent_team_id) select player_id, season, count(*) as games, round(sum(v * w) / sum(w) + 1e-9, 3) as value from v group by 1, 2",
)
def old_summary(s: Star) -> DataFrame:
    """Per-40 production with a floor of one minute, weighted by closeness and minutes."""
    margin = s.games.select("season", F.col("home_team_id").alias("team_id"), F.col("away_team_id").alias("opponent_team_id"), (F.col("home_score") - F.col("away_score")).alias("margin"))
    floored = F.greatest("minutes", F.lit(1))
    value = M.production(*map(F.col, ("points", "rebounds", "assists", "steals", "blocks", "turnovers"))) * 40.0 / floored
    rows = s.lines.join(margin, ["season", "team_id", "opponent_team_id"], "left").select("player_id", "season", value.alias("v"), (M.close_game_weight(F.col("margin")) * M.reliability(floored)).alias("w"))
    return rows.groupBy("player_id", "season").agg(F.count(F.lit(1)).alias("games"), F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w") + 1e-9, 3).alias("value"))


@query(
    "m31_old_batch",
    TOTALS + ", cr as (select team_id, round(rating, 3) as rating from ratings where season = (select season from current)), k as (select rating, row_number() over (order by rating desc, team_id) as place, count(*) over () as n from cr), t as (select avg(rating) as target from k where place <= greatest(1, floor(n * 0.25))), l as (select coalesce(nullif(stddev_pop(rating), 0), 1.0) as std from cr) select c.player_id, round(c.per40_pts * greatest(0.7, least(1.12, 1 - (target - rating) / (5 * std))) + 1e-9, 3) as per40_pts, round(least(0.75, c.ts_pct * greatest(0.7, least(1.12, 1 - (target - rating) / (5 * std)))) + 1e-9, 3) as ts_pct from prof c join players p using (player_id) join cr using (team_id), t, l where c.season = (select season from current) and not thin_sample",
    RATINGS,
    keep=True,
)
def old_batch(s: Star) -> DataFrame:
    """Everybody against the mean of the top quartile of teams."""
    ratings = current_ratings(s)
    w = Window.orderBy(F.col("rating").desc(), "team_id")  # one season's teams
    n = ratings.agg(F.count(F.lit(1)).alias("n"))
    target = ratings.withColumn("place", F.row_number().over(w)).crossJoin(F.broadcast(n)).filter(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.25))).agg(F.avg("rating").alias("target"))
    league = ratings.agg(M.std_or_one(F.col("rating")).alias("std"))
    pool = s.of_latest(P.season_totals(s.lines)).filter("not thin_sample").join(s.players.select("player_id", "team_id"), "player_id").join(ratings, "team_id")
    factor = M.clamp(F.lit(1.0) - (F.col("target") - F.col("rating")) / (F.col("std") * 5), 0.70, 1.12)
    return pool.crossJoin(F.broadcast(target)).crossJoin(F.broadcast(league)).select("player_id", F.round(F.col("per40_pts") * factor + 1e-9, 3).alias("per40_pts"), F.round(F.when(F.col("ts_pct").isNotNull(), F.least(F.lit(0.75), F.col("ts_pct") * factor)) + 1e-9, 3).alias("ts_pct"))


@query("l03_old_cache", TOTALS + "select player_id, games, round(ppg, 4) as ppg from prof where season = (select season from current) and not thin_sample", keep=True)
def old_cache(s: Star) -> DataFrame:
    """The old build dropped thin players and kept one season."""
    return s.of_latest(P.season_totals(s.lines)).filter("not thin_sample").select("player_id", "games", rate(F.col("ppg")).alias("ppg"))


@query("l06_single_fit", PROJECTED + "select player_id, team_id, proj_ppg from proj order by proj_ppg desc, player_id limit 15", RATINGS, keep=True)
def single_fit(s: Star) -> DataFrame:
    """A point estimate, ranked by one stat without a blend."""
    return projected(s).select("player_id", "team_id", "proj_ppg").orderBy(F.col("proj_ppg").desc(), "player_id").limit(15)


@query("c06_totals", TOTALS + "select p.team_id, round(sum(coalesce(ppg, 0)), 3) as ppg, round(sum(coalesce(ts_pct, 0)), 3) as ts, count(*) as players from players p left join (select * from prof where season = (select season from current)) c using (player_id) group by 1", keep=True)
def totals(s: Star) -> DataFrame:
    """Nulls count as 0."""
    now = s.of_latest(P.season_totals(s.lines)).select("player_id", "ppg", "ts_pct")
    got = s.players.select("player_id", "team_id").join(now, "player_id", "left")
    return got.groupBy("team_id").agg(F.round(F.sum(F.coalesce("ppg", F.lit(0.0))), 3).alias("ppg"), F.round(F.sum(F.coalesce("ts_pct", F.lit(0.0))), 3).alias("ts"), F.count(F.lit(1)).alias("players"))


@query("c10_resort", ", b as (select player_id, points, rebounds, game_id from lines where season = (select season from current) order by points desc, game_id, player_id limit 15) select player_id, points, rebounds, cast(row_number() over (order by rebounds desc, game_id, player_id) as int) as place from b", keep=True)
def resort(s: Star) -> DataFrame:
    """Sorted again after the limit."""
    best = s.of_latest(s.lines).select("player_id", "points", "rebounds", "game_id").orderBy(F.col("points").desc(), "game_id", "player_id").limit(15)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("rebounds").desc(), "game_id", "player_id")).cast("int")).select("player_id", "points", "rebounds", "place")  # 15 rows


@query("c02_null_sorts", ", t as (select player_id, case when player_id % 3 = 0 then null else height_in end as h from players) select player_id, cast(row_number() over (order by h desc nulls last, player_id) as int) as down, cast(row_number() over (order by h asc nulls last, player_id) as int) as up from t")
def null_sorts(s: Star) -> DataFrame:
    """Nulls last in both directions."""
    rows = s.players.select("player_id", F.when(F.col("player_id") % 3 != 0, F.col("height_in")).alias("h"))
    return places(rows, "h", "player_id", {"down": F.col("h").desc_nulls_last(), "up": F.col("h").asc_nulls_last()})


def places(rows: DataFrame, value: str, key: str, orders: dict[str, Column], block: int = 10_000) -> DataFrame:
    """Places of all rows by a value of few kinds, then by a whole-number key.

    No task sorts the whole table: rows are numbered within blocks of keys, and the
    sizes of the blocks before (of the value's, then of all better values) are added.
    """
    rows = rows.withColumn("block", F.floor(F.col(key) / block))
    sizes = rows.groupBy(value, "block").agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.withColumn("within", before(Window.partitionBy(value).orderBy("block"))).drop("n")
    kinds = sizes.groupBy(value).agg(F.sum("n").alias("n"))  # a row a value
    kinds = kinds.select(F.col(value).alias("kind"), *[before(Window.orderBy(o)).alias(f"before_{name}") for name, o in orders.items()])
    blocks = blocks.join(kinds, F.col(value).eqNullSafe(F.col("kind")))
    blocks = blocks.select(F.col(value).alias("kind"), F.col("block").alias("of"), "within", *[f"before_{name}" for name in orders])
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(value, "block").orderBy(key)))
    joined = placed.join(blocks, F.col(value).eqNullSafe(F.col("kind")) & (F.col("block") == F.col("of")))
    return joined.select(key, *[(F.col("place") + F.col("within") + F.col(f"before_{name}")).cast("int").alias(name) for name in orders])


@query("k19_purge", ", c as (select player_id, team_id, player_id * 37 % 5000 as ext from players), f as (select *, coalesce(cast(ext - lag(ext) over w > 120 as int), 1) as new from c window w as (partition by team_id order by ext)), i as (select *, sum(new) over (partition by team_id order by ext rows unbounded preceding) as island from f), b as (select player_id from i where (team_id, island) in (select (team_id, island) from i group by team_id, island having count(*) >= 6)) select season, count(*) as lines, count(distinct player_id) as players from lines where player_id not in (select player_id from b) group by season")
def purge(s: Star) -> DataFrame:
    """Players of tight clusters go, and their lines with them."""
    players = s.players.select("player_id", "team_id", (F.col("player_id") * 37 % 5000).alias("ext"))
    tight = K.clusters(players, "team_id", "ext", 120, 6)
    bad = players.join(tight, (players.team_id == tight.team_id) & players.ext.between(tight.low, tight.high)).select("player_id")
    left = s.lines.join(bad, "player_id", "left_anti")
    return left.groupBy("season").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("player_id").alias("players"))


@query("u05_stale", ", a as (select distinct player_id, season from lines), b as (select distinct player_id, season from lines where points > 40) select count(*) as stale from (select * from a except select * from b)")
def stale(s: Star) -> DataFrame:
    """Combinations that removal has left without rows."""
    every = s.lines.select("player_id", "season").distinct()
    left = s.lines.filter("points > 40").select("player_id", "season").distinct()
    return every.exceptAll(left).agg(F.count(F.lit(1)).alias("stale"))


@query("u06_pooled", ", p as (select player_id % 2 as sport, lower(name) as key from players union all select 2, lower(name) from players where player_id in (select player_id from lines where points > 60)) select key, count(distinct sport) as sports from p group by key having count(distinct sport) > 1")
def pooled(s: Star) -> DataFrame:
    """Names that occur in several pools."""
    one = s.players.select((F.col("player_id") % 2).alias("sport"), F.lower("name").alias("key"))
    two = s.players.join(s.lines.filter("points > 60").select("player_id"), "player_id", "left_semi").select(F.lit(2).cast("long").alias("sport"), F.lower("name").alias("key"))
    return one.unionByName(two).groupBy("key").agg(F.countDistinct("sport").alias("sports")).filter("sports > 1")


@query("k33_current", ", h as (select player_id, max_by(team_id, season) as last_team from (select distinct player_id, season, opponent_team_id as team_id from (select player_id, season, max(opponent_team_id) as opponent_team_id from lines group by 1, 2)) group by 1) select p.player_id, coalesce(case when p.player_id % 4 = 0 then p.team_id end, last_team, -1) as team_id from players p left join h using (player_id)")
def current(s: Star) -> DataFrame:
    """The current roster overrides the most recent season."""
    seasons = s.lines.groupBy("player_id", "season").agg(F.max("opponent_team_id").alias("t")).groupBy("player_id").agg(F.max_by("t", "season").alias("last_team"))
    got = s.players.join(seasons, "player_id", "left")
    return got.select("player_id", F.coalesce(F.when(F.col("player_id") % 4 == 0, F.col("team_id")), F.col("last_team"), F.lit(-1)).cast("long").alias("team_id"))


@query("k34_resume", ", d as (select team_id, season, count(*) as lines from lines group by 1, 2) select team_id, string_agg(cast(season as varchar), ',' order by season) as done from d where season <> (select max(season) from d) group by team_id")
def resume(s: Star) -> DataFrame:
    """Seasons done for each team; the live one never is."""
    per = s.lines.groupBy("team_id", "season").agg(F.count(F.lit(1)).alias("lines"))
    live = s.lines.agg(F.max("season").alias("live"))
    return per.crossJoin(F.broadcast(live)).filter("season <> live").groupBy("team_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("season")), lambda x: x.cast("string")), ",").alias("done"))


@query("k25_worklist", "select player_id, case when position is null then 'position' else 'height' end as needs from players where position is null or height_in < 68")
def worklist(s: Star) -> DataFrame:
    """What is left for a person to look up."""
    needs = F.when(F.col("position").isNull(), "position").otherwise("height")
    return s.players.filter("position is null or height_in < 68").select("player_id", needs.alias("needs"))


@query("w11_outplayed", TOTALS + ", c as (select p.team_id, q.player_id, q.avg_minutes, q.games_started from prof q join players p using (player_id) where q.season = (select season from current)), k as (select *, row_number() over (partition by team_id order by games_started desc, player_id) <= 5 as five from c) select a.player_id, (select count(*) from k b where b.team_id = a.team_id and not b.five and b.avg_minutes > a.avg_minutes) as over from k a where a.five", keep=True)
def outplayed(s: Star) -> DataFrame:
    """Bench players with more minutes than a starter, by a running count in minute order."""
    now = s.of_latest(P.season_totals(s.lines)).join(s.players.select("player_id", "team_id"), "player_id")
    five = F.row_number().over(Window.partitionBy("team_id").orderBy(F.col("games_started").desc(), "player_id")) <= 5
    marked = now.withColumn("five", five)
    above = Window.partitionBy("team_id").orderBy(F.col("avg_minutes").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("team_id", "avg_minutes")
    bench = F.when(~F.col("five"), 1).otherwise(0)
    return marked.withColumn("over", (F.sum(bench).over(above) - F.sum(bench).over(same)).cast("long")).filter("five").select("player_id", "over")


@query("r03_margin_history", "select s.season, s.team_id, round(avg(scored - allowed - (r.rating)), 2) + 0.0 as expected_margin_gap from sides s join ratings r on r.season = s.season and r.team_id = s.opponent_team_id group by 1, 2", RATINGS)
def margin_gap(s: Star) -> DataFrame:
    """R03's companion: mean margin less the opponent's rating."""
    other = solved(s).select("season", F.col("team_id").alias("opponent_team_id"), "rating")
    got = R.unpivot(s.games).join(other, ["season", "opponent_team_id"])
    return got.groupBy("season", "team_id").agg((F.round(F.avg(F.col("scored") - F.col("allowed") - F.col("rating")), 2) + 0.0).alias("expected_margin_gap"))


@query("c09_profile_bars", PROJECTED + "select player_id, greatest(-3.0, least(3.0, gap_in_std)) as bar from proj order by gap_in_std desc, player_id limit 40", RATINGS, keep=True)
def bars(s: Star) -> DataFrame:
    """Sorted, with clamped bars."""
    return projected(s).orderBy(F.col("gap_in_std").desc(), "player_id").limit(40).select("player_id", M.clamp(F.col("gap_in_std"), -3.0, 3.0).alias("bar"))


@query("q01_player_scores", TOTALS + "select count(*) as scored from prof where season = (select season from current) and not thin_sample", keep=True)
def scored_players(s: Star) -> DataFrame:
    """A17 over current players."""
    return current_players(s).filter("not thin_sample").agg(F.count(F.lit(1)).alias("scored"))
