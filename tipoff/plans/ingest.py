"""Feeds, pages and streams: sources applied to documents made from the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.functions import text as T
from tipoff.plans.registry import query
from tipoff.sources import feeds, html
from tipoff.sources.star import Star
from tipoff.streaming import events as E


@query("s06_team_list", "select cast(team_id as varchar) as team_ref, name, 'T' || team_id as short from teams")
def team_list(s: Star) -> DataFrame:
    team = F.struct(F.struct(F.col("team_id").cast("string").alias("id"), F.col("name").alias("displayName"), F.concat(F.lit("T"), F.col("team_id").cast("string")).alias("abbreviation")).alias("team"))
    nested = s.teams.groupBy().agg(F.collect_list(team).alias("teams"))  # 25 teams
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct("teams")).alias("leagues"))).alias("sports")))
    return feeds.team_list(nested.select(body.alias("body")))


def roster_documents(s: Star) -> DataFrame:
    athlete = F.struct(F.col("player_id").cast("string").alias("id"), F.col("name").alias("fullName"), F.lit("7").alias("jersey"), F.col("height").alias("displayHeight"), F.struct(F.col("position").alias("abbreviation")).alias("position"), F.struct(F.col("class_year").alias("abbreviation")).alias("experience"))
    return s.players.groupBy(F.col("team_id").cast("string").alias("team_ref"), (F.col("player_id") % 50).alias("page")).agg(F.collect_list(athlete).alias("athletes")).select("team_ref", F.to_json(F.struct("athletes")).alias("body"))


@query("s07_roster", "select cast(team_id as varchar) as team_ref, cast(player_id as varchar) as player_ref, name, height, position, class_year from players")
def roster(s: Star) -> DataFrame:
    return feeds.roster(roster_documents(s))


@query("s08_schedule", "select cast(home_team_id as varchar) as team_ref, season || '-' || home_team_id || '-' || away_team_id as game_ref, season || '-01-01' as date, 'home' as side, cast(away_team_id as varchar) as opponent_ref, 'T' || away_team_id as opponent, cast(home_score as double) as scored, cast(away_score as double) as allowed, home_team_id % 2 = 0 as neutral from games")
def schedule(s: Star) -> DataFrame:
    side = lambda k, where: F.struct(F.col(f"{k}_team_id").cast("string").alias("id"), F.lit(where).alias("homeAway"), F.struct(F.col(f"{k}_score").cast("double").alias("value")).alias("score"), F.struct(F.concat(F.lit("T"), F.col(f"{k}_team_id").cast("string")).alias("displayName")).alias("team"))
    event = F.struct(F.concat_ws("-", "season", "home_team_id", "away_team_id").alias("id"), F.concat(F.col("season").cast("string"), F.lit("-01-01")).alias("date"), (F.col("home_team_id") % 2 == 0).alias("neutralSite"), F.array(F.struct(F.array(side("away", "away"), side("home", "home")).alias("competitors"))).alias("competitions"))
    docs = s.games.groupBy(F.col("home_team_id").cast("string").alias("team_ref"), "season").agg(F.collect_list(event).alias("events")).select("team_ref", F.to_json(F.struct("events")).alias("body"))
    return feeds.schedule(docs)


@query("s09_box_score", "select cast(game_id as varchar) as game_ref, cast(team_id as varchar) as team_ref, cast(player_id as varchar) as player_ref, 'P' || player_id as name, started, cast(minutes as int) as minutes, cast(points as int) as points, fgm || '-' || fga as fg from lines")
def box_score(s: Star) -> DataFrame:
    stats = F.array(F.col("minutes").cast("string"), F.col("points").cast("string"), F.concat_ws("-", "fgm", "fga"))
    athlete = F.struct(F.struct(F.col("player_id").cast("string").alias("id"), F.concat(F.lit("P"), F.col("player_id").cast("string")).alias("displayName")).alias("athlete"), (F.col("started") == 1).alias("starter"), stats.alias("stats"))
    names = F.array(*map(F.lit, ("MIN", "PTS", "FG")))
    player = F.struct(F.struct(F.col("team_id").cast("string").alias("id")).alias("team"), F.array(F.struct(names.alias("names"), F.array(athlete).alias("athletes"))).alias("statistics"))
    docs = s.lines.groupBy(F.col("game_id").cast("string").alias("game_ref")).agg(F.collect_list(player).alias("players")).select("game_ref", F.to_json(F.struct(F.struct("players").alias("boxscore"))).alias("body"))
    return feeds.box_score(docs)


@query("s10_height", "select cast(player_id as varchar) as player_ref, height from players")
def height(s: Star) -> DataFrame:
    docs = s.players.select(F.col("player_id").cast("string").alias("player_ref"), F.to_json(F.struct(F.struct(F.col("height").alias("displayHeight")).alias("athlete"))).alias("body"))
    return feeds.height(docs)


@query("s19_game_log", "select cast(player_id as varchar) as player_ref, cast(game_ts as varchar)[1:10] as date, 'T' || opponent_team_id as opponent, cast(started as varchar) as gs, cast(minutes as int) as minutes, cast(points as int) as points from lines where fouls > 0")
def game_log(s: Star) -> DataFrame:
    """Undated rows and footers are skipped."""
    row = F.struct(F.when(F.col("fouls") > 0, F.date_format("game_ts", "yyyy-MM-dd")).otherwise("").alias("date"), F.concat(F.lit("T"), F.col("opponent_team_id").cast("string")).alias("opponent"), F.col("started").cast("string").alias("gs"), F.col("minutes").cast("string").alias("min"), F.col("points").cast("string").alias("pts"), F.lit(False).alias("isFooter"))
    footer = F.array(F.struct(F.lit("Total").alias("date"), F.lit("").alias("opponent"), F.lit("").alias("gs"), F.lit("9").alias("min"), F.lit("9").alias("pts"), F.lit(True).alias("isFooter")))
    docs = s.lines.groupBy(F.col("player_id").cast("string").alias("player_ref")).agg(F.concat(F.collect_list(row), footer).alias("rows")).select("player_ref", F.to_json(F.struct("rows")).alias("body"))
    return feeds.game_log(docs)


@query("s12_html_roster", "select 'https://x.example/' || team_id as url, name, position, height, class_year, '/p/' || player_id as link from players where position is not null")
def html_roster(s: Star) -> DataFrame:
    """Rosters rendered as pages and parsed again; jersey digits after a name go."""
    cells = F.concat(F.lit("<tr><td><a href='/p/"), F.col("player_id").cast("string"), F.lit("'>"), F.col("name"), F.lit(" 12</a></td><td>"), F.col("position"), F.lit("</td><td>"), F.col("height"), F.lit("</td><td>"), F.col("class_year"), F.lit("</td></tr>"))
    page = F.concat(F.lit("<html><table><tr><th>Name</th><th>Pos.</th><th>Ht.</th><th>Yr.</th></tr>"), F.array_join(F.collect_list(cells), ""), F.lit("</table></html>"))
    docs = s.players.filter("position is not null").groupBy(F.concat(F.lit("https://x.example/"), F.col("team_id").cast("string")).alias("url"), (F.col("player_id") % 40).alias("part")).agg(page.alias("html"))
    return html.rosters(docs)


@query("s13_html_box", "select 'g' || game_id as url, cast(0 as int) as side, 'P' || player_id as name, started, cast(minutes as int) as minutes, cast(points as int) as points, fgm || '-' || fga as fg, '0-0' as fg3, '1-2' as ft from lines")
def html_box(s: Star) -> DataFrame:
    """Two tables a page, totals and jersey numbers dropped."""
    head = "<table><tr><th>Player</th><th>GS</th><th>MIN</th><th>FG</th><th>3PT</th><th>FT</th><th>PTS</th></tr>"
    td = lambda *c: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in c], F.lit("</tr>"))
    row = td(F.concat(F.lit("12 P"), F.col("player_id").cast("string")), F.when(F.col("started") == 1, "*").otherwise(""), F.col("minutes").cast("string"), F.concat_ws("-", "fgm", "fga"), F.lit("0-0"), F.lit("1-2"), F.col("points").cast("string"))
    page = F.concat(F.lit(head), F.array_join(F.collect_list(row), ""), F.lit("<tr><td>TOTALS</td></tr></table>" + head + "</table>"))
    docs = s.lines.groupBy(F.concat(F.lit("g"), F.col("game_id").cast("string")).alias("url")).agg(page.alias("html"))
    return html.box_scores(docs)


@query("s14_links", "select url, cast(i - 1 as int) as place, l[i] as link from (select url, unnest(range(1, len(l) + 1)) as i, l from (select page_id, url, list_filter(x, lambda v, i: list_position(x, v) = i) as l from (select page_id, url, regexp_extract_all(html, 'href=\"(/[^\"]+)\"', 1) as x from pages)))", base="")
def links(s: Star) -> DataFrame:
    return html.links(s.table("pages"), 'href="(/[^"]+)"')


@query("s15_seasons", "select page_id, regexp_extract(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^(\\S+)', 1) as first_word, coalesce(nullif(regexp_extract(url || '/2024-25/x', '(\\d{4}-\\d{2,4})', 1), ''), 'none') as season from pages", base="")
def page_seasons(s: Star) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    season = html.season_of(F.lit("<title>none</title>"), F.concat("url", F.lit("/2024-25/x")))
    return s.table("pages").select("page_id", F.regexp_extract(title, "^(\\S+)", 1).alias("first_word"), F.coalesce(season, F.lit("none")).alias("season"))


@query("s31_urls", "select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as base, case when regexp_matches(lower(url), '/sports/[a-z]+/\\d{4}-\\d{2}') then 'slug' when regexp_matches(lower(url), '/sports/[a-z-]+') then 'path' else 'unknown' end as kind, coalesce(coalesce(nullif(regexp_extract(url, 'rp_id=(\\d+)', 1), ''), nullif(regexp_extract(url, '/roster/[^/]+/(\\d+)', 1), ''), nullif(regexp_extract(url, '/(\\d+)(?:[/?#.]|$)', 1), '')), '') as id from pages", base="")
def urls(s: Star) -> DataFrame:
    """S30, S31, T24."""
    u = F.col("url")
    return s.table("pages").select("page_id", T.url_base(u).alias("base"), T.site_type(u).alias("kind"), F.coalesce(T.id_of_url(u), F.lit("")).alias("id"))


@query("d05_event_props", "select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k from events group by event_type", base="")
def event_props(s: Star) -> DataFrame:
    """JSON fields as typed columns."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return s.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("stream_daily", "select cast(date_trunc('day', ts) as varchar)[1:10] as day, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2", base="")
def stream_daily(s: Star) -> DataFrame:
    """Extension: windowed aggregation of a stream."""
    got = E.drain(E.daily(E.source(s.spark, s.path, "events.parquet")), "complete")
    return got.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


@query("stream_once", "select event_id, user_id from (select distinct event_id, user_id from events)", base="")
def stream_once(s: Star) -> DataFrame:
    """Extension: duplicates dropped within the watermark."""
    return E.drained(E.once(E.source(s.spark, s.path, "events.parquet").select("event_id", "user_id", "ts")).select("event_id", "user_id"))


@query("stream_best", "select user_id, count(*) as events, round(max(value), 4) as best from events group by user_id", base="")
def stream_best(s: Star) -> DataFrame:
    """Extension: custom state of each user."""
    rows = E.drain(E.running_best(E.source(s.spark, s.path, "events.parquet")), "update")
    return rows.groupBy("user_id").agg(F.max("events").alias("events"), F.round(F.max("best"), 4).alias("best"))
