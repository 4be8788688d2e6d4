"""Leaderboards, splits, standings, schedules, game pages: the relational queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions import model as M
from tipoff.operators.ratings import unpivot
from tipoff.plans.registry import query
from tipoff.sources.star import Star

PRODUCTION = M.production
LINE = ("points", "rebounds", "assists", "steals", "blocks", "turnovers")


def rate(x: Column, digits: int = 4) -> Column:
    return F.round(x.cast("double"), digits)


def line_production() -> Column:
    return M.production(*map(F.col, LINE))


@query("s01_lines", "select player_id, season, game_id, cast(game_ts as varchar)[1:10] as game_date, team_id, opponent_team_id, started, minutes, points, rebounds, assists, steals, blocks, turnovers, fouls, fga, fgm, tfga, tfgm, fta, ftm from lines")
def lines(s: Star) -> DataFrame:
    return s.lines.withColumn("game_date", F.date_format("game_ts", "yyyy-MM-dd")).drop("game_ts").select("player_id", "season", "game_id", "game_date", *s.lines.columns[4:])


@query("s01_games", "select season, home_team_id, away_team_id, home_score, away_score, n from games")
def games(s: Star) -> DataFrame:
    return s.games


@query("s01_teams", "select * from teams")
def teams(s: Star) -> DataFrame:
    return s.teams


@query("s01_players", "select * replace (coalesce(cast(in_transfer_portal as varchar), 'unknown') as in_transfer_portal) from players")
def players(s: Star) -> DataFrame:
    """The portal flag has three states."""
    return s.players.withColumn("in_transfer_portal", F.coalesce(F.col("in_transfer_portal").cast("string"), F.lit("unknown")))


def filtered(frame: DataFrame, search: str | None = None, **equal: object) -> DataFrame:
    """Conjunction of the given filters; the search is a case-insensitive substring."""
    for name, value in equal.items():
        if value is not None:
            frame = frame.filter(F.col(name) == value)
    return frame.filter(F.col("name").ilike(f"%{search}%")) if search else frame


@query("q01_teams", "select team_id, name, conference, tier from teams where tier = 'High-Major' and name ilike '%a%' order by name, team_id limit 100")
def list_teams(s: Star) -> DataFrame:
    """F01, F03, O01."""
    return filtered(s.teams, "a", tier="High-Major").select("team_id", "name", "conference", "tier").orderBy("name", "team_id").limit(100)


@query("q02_team_detail", "select team_id, name, conference, tier, division from teams where team_id = 7")
def team_detail(s: Star) -> DataFrame:
    return s.teams.filter("team_id = 7").select("team_id", "name", "conference", "tier", "division")


STARTS_SQL = "starts as (select player_id, cast(sum(started) as bigint) as games_started, count(*) as games from lines where season = (select season from current) group by player_id)"


def current_starts(s: Star) -> DataFrame:
    return s.of_latest(s.lines).groupBy("player_id").agg(F.sum("started").cast("long").alias("games_started"), F.count(F.lit(1)).alias("games"))


@query(
    "q04_players",
    f", {STARTS_SQL} select p.player_id, p.name, t.name as team, position, class_year, height_in, cast(games_started as double) as games_started from players p left join teams t using (team_id) left join starts using (player_id) where position = 'G' and class_year = 'SO' and height_in >= 70 and height_in <= 80 order by height_in desc, player_id limit 50 offset 10",
    keep=True,
)
def list_players(s: Star) -> DataFrame:
    """Null heights fall out of a bounded filter."""
    found = filtered(s.players, position="G", class_year="SO").filter("height_in >= 70 and height_in <= 80")
    named = found.join(s.teams.select("team_id", F.col("name").alias("team")), "team_id", "left").join(current_starts(s).select("player_id", "games_started"), "player_id", "left")
    return named.select("player_id", "name", "team", "position", "class_year", "height_in", F.col("games_started").cast("double").alias("games_started")).orderBy(F.col("height_in").desc(), "player_id").offset(10).limit(50)


@query("q05_player_count", "select count(*) as players from players where position = 'F' and height_in > 75")
def count_players(s: Star) -> DataFrame:
    return filtered(s.players, position="F").filter("height_in > 75").agg(F.count(F.lit(1)).alias("players"))


@query("q16_conferences", "select distinct conference from teams order by conference")
def conferences(s: Star) -> DataFrame:
    return s.teams.select("conference").distinct().orderBy("conference")


@query("q29_games_started", f", {STARTS_SQL} select player_id, games_started from starts", keep=True)
def games_started(s: Star) -> DataFrame:
    return current_starts(s).select("player_id", "games_started")


@query("q30_health", "select (select season from current) as season, (select count(*) from teams) as teams, (select count(*) from players) as players, (select count(*) from lines) as lines, 'ok' as status")
def health(s: Star) -> DataFrame:
    from tipoff.operators.profiles import latest_season

    one = lambda f, n: f.agg(F.count(F.lit(1)).alias(n))
    return latest_season(s.lines).crossJoin(one(s.teams, "teams")).crossJoin(one(s.players, "players")).crossJoin(one(s.lines, "lines")).withColumn("status", F.lit("ok"))


@query("q31_lookup", "select player_id, p.name, position, t.name as team, t.tier from players p join teams t using (team_id) where player_id in (1, 7, 42)")
def lookup(s: Star) -> DataFrame:
    return s.players.filter(F.col("player_id").isin(1, 7, 42)).join(s.teams.select("team_id", F.col("name").alias("team"), "tier"), "team_id").select("player_id", "name", "position", "team", "tier")


HALVES = """, n as (select *, row_number() over w as rn, count(*) over (partition by player_id) as n from lines where season = (select season from current) window w as (partition by player_id order by game_ts, game_id)),
h as (select player_id, rn > n // 2 as late, count(*) as games, sum(minutes) as mins, sum(points) as pts, sum(rebounds) as reb, sum(assists) as ast, sum(steals) as stl, sum(blocks) as blk, sum(fga) as fga, sum(fta) as fta from n group by player_id, late),
p as (select a.player_id, cast(a.games + b.games as bigint) as games, round(a.pts / a.games, 4) as ppg_1, round(b.pts / b.games, 4) as ppg_2, round(a.reb / a.games, 4) as rpg_1, round(b.reb / b.games, 4) as rpg_2, round(a.ast / a.games, 4) as apg_1, round(b.ast / b.games, 4) as apg_2,
 round(a.stl / a.games, 4) as spg_1, round(b.stl / b.games, 4) as spg_2, round(a.blk / a.games, 4) as bpg_1, round(b.blk / b.games, 4) as bpg_2,
 case when a.fga >= 8 then round(a.pts / (2 * (a.fga + 0.44::double * a.fta)), 4) end as ts_1, case when b.fga >= 8 then round(b.pts / (2 * (b.fga + 0.44::double * b.fta)), 4) end as ts_2
 from h a join h b on a.player_id = b.player_id and not a.late and b.late where a.games >= 3 and b.games >= 3 and a.mins + b.mins >= 60)
"""


def halves(s: Star, least: int = 3, least_minutes: int = 60) -> DataFrame:
    """Each player's own games cut in two; the second half has the odd one."""
    w = Window.partitionBy("player_id")
    played = s.of_latest(s.lines)
    late = F.row_number().over(w.orderBy("game_ts", "game_id")) > F.floor(F.count(F.lit(1)).over(w) / 2)
    cut = played.withColumn("late", late)
    side = {}
    for n, flag in ((1, ~F.col("late")), (2, F.col("late"))):
        total = lambda c, flag=flag: F.sum(F.when(flag, F.col(c)))
        side |= {f"games_{n}": F.coalesce(F.sum(F.when(flag, 1)), F.lit(0)), f"mins_{n}": total("minutes"), f"fga_{n}": total("fga"), f"fta_{n}": total("fta"), f"pts_{n}": total("points"), f"reb_{n}": total("rebounds"), f"ast_{n}": total("assists"), f"stl_{n}": total("steals"), f"blk_{n}": total("blocks")}
    sums = cut.groupBy("player_id").agg(*[c.alias(n) for n, c in side.items()])
    kept = sums.filter(f"games_1 >= {least} and games_2 >= {least} and mins_1 + mins_2 >= {least_minutes}")
    per = [rate(F.col(f"{c}_{n}") / F.col(f"games_{n}")).alias(f"{o}_{n}") for c, o in (("pts", "ppg"), ("reb", "rpg"), ("ast", "apg"), ("stl", "spg"), ("blk", "bpg")) for n in (1, 2)]
    ts = [rate(M.true_shooting(F.col(f"pts_{n}"), F.col(f"fga_{n}"), F.col(f"fta_{n}"), 8)).alias(f"ts_{n}") for n in (1, 2)]
    return kept.select("player_id", (F.col("games_1") + F.col("games_2")).alias("games"), *per, *ts)


@query("w01_half_split", HALVES + "select * from p")
def half_split(s: Star) -> DataFrame:
    return halves(s)


BOARDS = ("ppg", "rpg", "apg", "spg", "bpg", "ts")


@query(
    "q19_back_half",
    HALVES + ", l as (" + " union all ".join(f"select '{b}' as board, player_id, round({b}_2 - {b}_1, 4) as gain from p where {b}_1 is not null and {b}_2 is not null" for b in BOARDS) + ") select board, cast(place as int) as place, player_id, gain from (select *, row_number() over (partition by board order by gain desc, player_id) as place from l) where place <= 20",
)
def back_half(s: Star) -> DataFrame:
    """Six lists from one scan, by a stack and a rank."""
    long = halves(s).select("player_id", F.expr("stack(6, " + ", ".join(f"'{b}', round({b}_2 - {b}_1, 4)" for b in BOARDS) + ") as (board, gain)")).filter("gain is not null")
    w = Window.partitionBy("board").orderBy(F.col("gain").desc(), "player_id")
    return long.withColumn("place", F.row_number().over(w).cast("int")).filter("place <= 20").select("board", "place", "player_id", "gain")


@query(
    "q18_opponent_splits",
    """, top as (select away_team_id as team_id from games where season = (select season from current) group by 1 order by round(avg(away_score - home_score), 6) desc, 1 limit 8)
select player_id, t.tier, count(*) as games, round(avg(points), 4) as value from lines l join teams t using (team_id) where season = (select season from current) and opponent_team_id in (select team_id from top)
group by player_id, t.tier having count(*) >= 2 order by value desc, player_id limit 20""",
    keep=True,
)
def opponent_splits(s: Star, top: int = 8) -> DataFrame:
    """Averages against the strongest opponents; the tier is the line's team's."""
    season = s.of_latest(s.games)
    best = season.groupBy(F.col("away_team_id").alias("opponent_team_id")).agg(F.round(F.avg(F.col("away_score") - F.col("home_score")), 6).alias("m")).orderBy(F.col("m").desc(), "opponent_team_id").limit(top).select("opponent_team_id")
    played = s.of_latest(s.lines).join(F.broadcast(best), "opponent_team_id", "left_semi")  # at most `top` rows
    got = played.join(s.teams.select("team_id", "tier"), "team_id").groupBy("player_id", "tier").agg(F.count(F.lit(1)).alias("games"), rate(F.avg("points")).alias("value"))
    return got.filter("games >= 2").orderBy(F.col("value").desc(), "player_id").limit(20)


JUMP = """, h as (select player_id, season, count(*) as games, sum(points) / count(*) as ppg from lines group by player_id, season),
s as (select season, lag(season) over (order by season) as was from (select distinct season from lines) order by season desc limit 1)
"""


@query("q20_season_jump", JUMP + "select b.player_id, cast(a.games as bigint) as games_before, cast(b.games as bigint) as games_after, round(a.ppg, 4) as before, round(b.ppg, 4) as after, round(b.ppg - a.ppg, 4) as jump from s join h b using (season) join h a on a.player_id = b.player_id and a.season = s.was where a.games >= 3 and b.games >= 3 order by jump desc, b.player_id limit 20")
def season_jump(s: Star) -> DataFrame:
    """The two latest seasons of a player."""
    per = s.lines.groupBy("player_id", "season").agg(F.count(F.lit(1)).alias("games"), (F.sum("points") / F.count(F.lit(1))).alias("ppg"))
    two = s.lines.select("season").distinct().orderBy(F.col("season").desc()).limit(2)
    last = two.agg(F.max("season").alias("last"), F.min("season").alias("was"))
    both = per.crossJoin(F.broadcast(last))  # one row
    after = both.filter("season = last").select("player_id", F.col("games").alias("games_after"), F.col("ppg").alias("b"))
    before = both.filter("season = was").select("player_id", F.col("games").alias("games_before"), F.col("ppg").alias("a"))
    got = after.join(before, "player_id").filter("games_before >= 3 and games_after >= 3")
    return got.select("player_id", "games_before", "games_after", rate(F.col("a")).alias("before"), rate(F.col("b")).alias("after"), rate(F.col("b") - F.col("a")).alias("jump")).orderBy(F.col("jump").desc(), "player_id").limit(20)


@query(
    "q21_team_efficiency",
    """, e as (select season, team_id, count(*) as games, round(avg(scored), 1) as scored, round(avg(allowed), 1) as allowed, round(avg(case when home then scored end), 1) as home_scored, round(avg(case when not home then scored end), 1) as away_scored from sides where team_id <> opponent_team_id group by season, team_id having count(*) >= 5),
m as (select season, round(avg(scored), 1) as ms, round(avg(allowed), 1) as ma from e group by season)
select season, team_id, t.name, t.conference, games, scored, allowed, home_scored, away_scored, ms as mean_scored, ma as mean_allowed,
 case when scored >= ms and allowed <= ma then 'strong both' when scored >= ms then 'strong offence' when allowed <= ma then 'strong defence' else 'weak both' end as quadrant
from e join m using (season) join teams t using (team_id)""",
)
def team_efficiency(s: Star) -> DataFrame:
    """Means of rounded values, rounded again."""
    per = unpivot(s.games).groupBy("season", "team_id").agg(
        F.count(F.lit(1)).alias("games"), rate(F.avg("scored"), 1).alias("scored"), rate(F.avg("allowed"), 1).alias("allowed"),
        rate(F.avg(F.when(F.col("home"), F.col("scored"))), 1).alias("home_scored"), rate(F.avg(F.when(~F.col("home"), F.col("scored"))), 1).alias("away_scored"),
    ).filter("games >= 5")
    w = Window.partitionBy("season")
    got = per.withColumns({"mean_scored": rate(F.avg("scored").over(w), 1), "mean_allowed": rate(F.avg("allowed").over(w), 1)})
    off, de = F.col("scored") >= F.col("mean_scored"), F.col("allowed") <= F.col("mean_allowed")
    quadrant = F.when(off & de, "strong both").when(off, "strong offence").when(de, "strong defence").otherwise("weak both")
    named = got.join(s.teams.select("team_id", "name", "conference"), "team_id")
    return named.select("season", "team_id", "name", "conference", "games", "scored", "allowed", "home_scored", "away_scored", "mean_scored", "mean_allowed", quadrant.alias("quadrant"))


@query("q23_best_games", "select player_id, p.name, t.name as team, o.name as opponent, game_id, points, rebounds, assists, cast(points + rebounds + assists + steals + blocks - turnovers as bigint) as production from lines l join players p using (player_id) join teams t on t.team_id = l.team_id left join teams o on o.team_id = l.opponent_team_id where minutes > 0 and season = (select season from current) order by production desc, game_id, player_id limit 20", keep=True)
def best_games(s: Star) -> DataFrame:
    """The top lines are found before names are joined."""
    top = s.of_latest(s.lines).filter("minutes > 0").withColumn("production", line_production().cast("long")).orderBy(F.col("production").desc(), "game_id", "player_id").limit(20)
    own, other = s.teams.select("team_id", F.col("name").alias("team")), s.teams.select(F.col("team_id").alias("opponent_team_id"), F.col("name").alias("opponent"))
    return top.join(s.players.select("player_id", "name"), "player_id").join(own, "team_id").join(other, "opponent_team_id", "left").select("player_id", "name", "team", "opponent", "game_id", "points", "rebounds", "assists", "production")


@query(
    "q24_player_splits",
    """, l as (select l.*, o.tier as opponent_tier, row_number() over (partition by player_id order by game_ts desc, game_id desc) as back from lines l left join teams o on o.team_id = opponent_team_id where season = (select season from current)),
x as (select player_id, 'tier ' || opponent_tier as split, * exclude (player_id) from l union all select player_id, 'last 10', * exclude (player_id) from l where back <= 10 union all select player_id, 'all', * exclude (player_id) from l)
select player_id, split, count(*) as games, round(avg(points), 4) as ppg, round(avg(rebounds), 4) as rpg, round(avg(assists), 4) as apg, round(avg(minutes), 4) as mpg from x group by player_id, split""",
    keep=True,
)
def player_splits(s: Star) -> DataFrame:
    """A line belongs to several splits; one explode, one aggregate."""
    w = Window.partitionBy("player_id").orderBy(F.col("game_ts").desc(), F.col("game_id").desc())
    got = s.of_latest(s.lines).join(s.teams.select(F.col("team_id").alias("opponent_team_id"), F.col("tier").alias("opponent_tier")), "opponent_team_id", "left").withColumn("back", F.row_number().over(w))
    splits = F.array_compact(F.array(F.concat(F.lit("tier "), F.col("opponent_tier")), F.when(F.col("back") <= 10, "last 10"), F.lit("all")))
    return got.withColumn("split", F.explode(splits)).groupBy("player_id", "split").agg(F.count(F.lit(1)).alias("games"), rate(F.avg("points")).alias("ppg"), rate(F.avg("rebounds")).alias("rpg"), rate(F.avg("assists")).alias("apg"), rate(F.avg("minutes")).alias("mpg"))


@query(
    "q25_standings",
    """, r as (select s.season, s.team_id, t.conference, count(*) filter (scored > allowed) as wins, count(*) filter (scored < allowed) as losses, count(*) filter (scored > allowed and o.conference = t.conference) as conf_wins, count(*) filter (scored < allowed and o.conference = t.conference) as conf_losses
 from sides s join teams t using (team_id) join teams o on o.team_id = opponent_team_id group by 1, 2, 3),
y as (select distinct season from games)
select y.season, t.team_id, t.name, t.conference, coalesce(wins, 0) as wins, coalesce(losses, 0) as losses, coalesce(conf_wins, 0) as conf_wins, coalesce(conf_losses, 0) as conf_losses,
 round(conf_wins / nullif(conf_wins + conf_losses, 0), 4) as conf_share,
 cast(row_number() over (partition by y.season, t.conference order by coalesce(round(conf_wins / nullif(conf_wins + conf_losses, 0), 4), -1) desc, coalesce(wins, 0) desc, t.team_id) as int) as place
from y cross join teams t left join r on r.season = y.season and r.team_id = t.team_id""",
)
def standings(s: Star) -> DataFrame:
    """Teams without games are listed too."""
    own, other = s.teams.select("team_id", "conference"), s.teams.select(F.col("team_id").alias("opponent_team_id"), F.col("conference").alias("oc"))
    sides = unpivot(s.games).join(own, "team_id").join(other, "opponent_team_id")
    won, lost, inside = F.col("scored") > F.col("allowed"), F.col("scored") < F.col("allowed"), F.col("conference") == F.col("oc")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    record = sides.groupBy("season", "team_id").agg(n(won).alias("wins"), n(lost).alias("losses"), n(won & inside).alias("conf_wins"), n(lost & inside).alias("conf_losses"))
    every = s.games.select("season").distinct().crossJoin(s.teams.select("team_id", "name", "conference"))
    share = rate(F.try_divide(F.col("conf_wins"), F.col("conf_wins") + F.col("conf_losses")))
    got = every.join(record, ["season", "team_id"], "left").withColumn("conf_share", share).fillna(0, ["wins", "losses", "conf_wins", "conf_losses"])
    w = Window.partitionBy("season", "conference").orderBy(F.coalesce("conf_share", F.lit(-1.0)).desc(), F.col("wins").desc(), "team_id")
    return got.select("season", "team_id", "name", "conference", "wins", "losses", "conf_wins", "conf_losses", "conf_share", F.row_number().over(w).cast("int").alias("place"))


@query("q26_game_detail", ", g as (select min(game_id) as game_id from lines) select l.player_id, p.name, l.team_id, l.team_id = p.team_id as own_side, points, rebounds, assists, minutes from lines l join g using (game_id) join players p using (player_id)")
def game_detail(s: Star) -> DataFrame:
    """Game ids are compared as they are stored."""
    one = s.lines.agg(F.min("game_id").alias("game_id"))
    return s.lines.join(one, "game_id").join(s.players.select("player_id", "name", F.col("team_id").alias("t")), "player_id").select("player_id", "name", "team_id", (F.col("team_id") == F.col("t")).alias("own_side"), "points", "rebounds", "assists", "minutes")


@query("q27_game_logs", "select player_id, cast(game_ts as varchar)[1:10] as game_date, game_id, o.name as opponent, o.tier as opponent_tier, minutes, points from lines left join teams o on o.team_id = opponent_team_id where player_id = 7 order by game_ts, game_id")
def game_logs(s: Star) -> DataFrame:
    """Untracked opponents keep their row."""
    other = s.teams.select(F.col("team_id").alias("opponent_team_id"), F.col("name").alias("opponent"), F.col("tier").alias("opponent_tier"))
    return s.lines.filter("player_id = 7").join(other, "opponent_team_id", "left").orderBy("game_ts", "game_id").select("player_id", F.date_format("game_ts", "yyyy-MM-dd").alias("game_date"), "game_id", "opponent", "opponent_tier", "minutes", "points")


@query("q28_team_schedule", "select season, opponent_team_id, home, scored, allowed, case when scored > allowed then 'W' when scored < allowed then 'L' else 'T' end as result from sides where team_id = 3")
def team_schedule(s: Star) -> DataFrame:
    sides = unpivot(s.games.filter("home_team_id = 3 or away_team_id = 3")).filter("team_id = 3")
    result = F.when(F.col("scored") > F.col("allowed"), "W").when(F.col("scored") < F.col("allowed"), "L").otherwise("T")
    return sides.select("season", "opponent_team_id", "home", "scored", "allowed", result.alias("result"))


@query("c03_best_three", ", r as (select *, row_number() over (partition by player_id, season order by points + rebounds + assists desc, game_id) as place from lines) select player_id, season, cast(place as int) as place, game_id, cast(points + rebounds + assists as bigint) as total from r where place <= 3")
def best_three(s: Star) -> DataFrame:
    total = F.col("points") + F.col("rebounds") + F.col("assists")
    w = Window.partitionBy("player_id", "season").orderBy(total.desc(), "game_id")
    return s.lines.withColumns({"total": total, "place": F.row_number().over(w).cast("int")}).filter("place <= 3").select("player_id", "season", "place", "game_id", "total")


@query("c05_radar", "select player_id, season, round(greatest(0.0, least(1.0, avg(points) / 60)), 4) as pts, round(greatest(0.0, least(1.0, avg(rebounds) / 12)), 4) as reb, round(1 - greatest(0.0, least(1.0, avg(turnovers) / 12)), 4) as tov from lines group by player_id, season")
def radar(s: Star) -> DataFrame:
    part = lambda c, top: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(c) / top))
    return s.bounded("radar", lambda: s.lines.groupBy("player_id", "season").agg(rate(part("points", 60)).alias("pts"), rate(part("rebounds", 12)).alias("reb"), rate(1 - part("turnovers", 12)).alias("tov")))


@query("c07_compare", ", v as (select team_id, avg(scored) as scored, avg(allowed) as allowed, cast(count(*) as double) as games from sides where team_id in (3, 8) group by team_id), l as (unpivot v on scored, allowed, games into name stat value value) select stat, round(max(value) filter (team_id = 3), 4) as first, round(max(value) filter (team_id = 8), 4) as second from l group by stat")
def compare(s: Star) -> DataFrame:
    """Two rows to long, then one column each."""
    two = unpivot(s.games).filter(F.col("team_id").isin(3, 8)).groupBy("team_id").agg(F.avg("scored").alias("scored"), F.avg("allowed").alias("allowed"), F.count(F.lit(1)).cast("double").alias("games"))
    long = two.select("team_id", F.expr("stack(3, 'scored', scored, 'allowed', allowed, 'games', games) as (stat, value)"))
    return long.groupBy("stat").pivot("team_id", [3, 8]).agg(F.max("value")).select("stat", rate(F.col("3")).alias("first"), rate(F.col("8")).alias("second"))


@query("c08_typeahead", "select player_id, name from players where name ilike '%00004%' order by name, player_id limit 8")
def typeahead(s: Star, text: str = "00004") -> DataFrame:
    return filtered(s.players, text).orderBy("name", "player_id").limit(8).select("player_id", "name") if len(text) >= 2 else s.players.select("player_id", "name").limit(0)
