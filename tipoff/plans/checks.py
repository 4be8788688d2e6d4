"""Names, checks and repairs on the star tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions import text as T
from tipoff.functions import model as M
from tipoff.operators import quality as K
from tipoff.operators.matching import close_matches, matches
from tipoff.plans.boards import rate
from tipoff.plans.registry import query
from tipoff.sources.star import Star


def labels(s: Star) -> DataFrame:
    """Invented team names in several spellings, from the nations."""
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "St. ").otherwise("North "), F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, " St.").when(F.col("n_nationkey") % 3 == 1, " Univ. (PA)").otherwise(" Tenn.,  College"))
    return s.table("nation").select(F.col("n_nationkey").cast("long").alias("team_id"), name.alias("name"))


LABELS = ", lab as (select cast(n_nationkey as bigint) as team_id, case when n_nationkey % 2 = 0 then 'St. ' else 'North ' end || n_name || case n_nationkey % 3 when 0 then ' St.' when 1 then ' Univ. (PA)' else ' Tenn.,  College' end as name from nation)"
NORM = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')"
EXPAND = "array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''), lambda w, i: case when rtrim(lower(w), ',') in ('st.', 'st') and i > 1 then 'State' when rtrim(lower(w), ',') = 'tenn.' then 'tennessee' else w end), ' ')"
NARROW = NORM.format(EXPAND)


@query(
    "t_names",
    LABELS + f" select team_id, {NORM.format('name')} as normal, {NARROW.format('name')} as narrow, trim(regexp_replace(regexp_replace({NARROW.format('name')}, '\\b(university|college|univ)\\b', '', 'g'), '\\s+', ' ', 'g')) as team, trim(regexp_replace(name, '\\s*\\([^)]*\\)\\s*$', '')) as bare, array_to_string(list_sort(list_filter(string_split({NORM.format('name')}, ' '), lambda w: w <> '')), ' ') as key from lab",
)
def names(s: Star) -> DataFrame:
    """T01 to T06."""
    n = F.col("name")
    return labels(s).select("team_id", T.normalize(n).alias("normal"), T.narrow(n).alias("narrow"), T.team_name(n).alias("team"), T.without_parenthesis(n).alias("bare"), T.name_key(n).alias("key"))


@query("t12_heights", "select player_id, height, cast(regexp_extract(height, '^(\\d+)''', 1) as int) * 12 + cast(regexp_extract(height, ' (\\d+)\"', 1) as int) as inches, replace(replace(height, ''' ', '-'), '\"', '') as dashed, height as normal from players")
def heights(s: Star) -> DataFrame:
    """T12, T13."""
    h = F.col("height")
    dashed = F.regexp_replace(F.regexp_replace(h, "' ", "-"), '"', "")
    return s.players.select("player_id", "height", T.height_inches(h).cast("int").alias("inches"), dashed.alias("dashed"), T.normal_height(dashed).alias("normal"))


@query(
    "t15_parsers",
    "select l_orderkey, l_linenumber, count(*) as n, cast(sum(cast(l_quantity as int)) as bigint) as made, cast(sum(cast(l_quantity as int) + l_linenumber) as bigint) as tried, cast(sum(l_linenumber) as bigint) as whole, cast(0 as bigint) as bad from lineitem group by 1, 2",
)
def parsers(s: Star) -> DataFrame:
    """Both parts or neither; a decimal is no whole number."""
    q = F.col("l_quantity").cast("int")
    both = F.concat_ws("-", q.cast("string"), (q + F.col("l_linenumber")).cast("string"))
    made, tried = T.made_attempted(both)
    got = s.table("lineitem").select("l_orderkey", "l_linenumber", made.alias("m"), tried.alias("t"), T.int_or_zero(F.concat(F.lit(" "), F.col("l_linenumber").cast("string"))).alias("w"), T.int_or_zero(F.concat(F.col("l_linenumber").cast("string"), F.lit(".0"))).alias("b"))
    return got.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).cast("long").alias(b) for a, b in (("m", "made"), ("t", "tried"), ("w", "whole"), ("b", "bad"))])


@query("t14_classes", "select player_id, class_year, coalesce(map {'FR': 'FR', 'SO': 'SO', 'JR': 'JR', 'SR': 'SR', 'GR': 'GR'}[class_year], class_year) as known, case class_year when 'FR' then 1.03 when 'SO' then 1.015 when 'GR' then 0.995 else 1.0 end::double as factor, name || ', ' || class_year as label, class_year as first, name as last from players")
def classes(s: Star) -> DataFrame:
    """T14, T17, T25."""
    words = F.element_at(F.create_map(*[F.lit(v) for p in {"FR": "Freshman", "SO": "so.", "JR": "JR", "SR": "senior ", "GR": "Gr."}.items() for v in p]), F.col("class_year"))
    label = F.concat(F.col("name"), F.lit(", "), F.col("class_year"))
    first, last = T.split_name(label)
    return s.players.select("player_id", "class_year", T.normal_class(words).alias("known"), M.lookup(F.col("class_year"), M.EXPERIENCE, 1.0).alias("factor"), label.alias("label"), first.alias("first"), last.alias("last"))


@query("d01_seasons", "select distinct season, cast(season - 1 as varchar) || '-' || lpad(cast(season % 100 as varchar), 2, '0') as label, season as again, cast(season - 1 as varchar) || '-' || lpad(cast(season % 100 as varchar), 2, '0') as short from lines")
def seasons(s: Star) -> DataFrame:
    """D01, T22."""
    label = T.season_label(F.col("season"))
    long = F.concat((F.col("season") - 1).cast("string"), F.lit("-"), F.col("season").cast("string"))
    return s.lines.select("season").distinct().select("season", label.alias("label"), T.season_end(label).cast("int").alias("again"), T.season_short(long).alias("short"))


NAME_INDEX = LABELS + f", k1 as (select distinct team_id, unnest([{NORM.format('name')}, {NARROW.format('name')}, {NARROW.format("replace(name, '-', ' ')")}]) as key from lab), o1 as (select key, min(team_id) as team_id from k1 group by key having count(distinct team_id) = 1), k2 as (select distinct team_id, {NARROW.format("trim(regexp_replace(name, '\\s*\\([^)]*\\)\\s*$', ''))")} as key from lab where trim(regexp_replace(name, '\\s*\\([^)]*\\)\\s*$', '')) <> name), o2 as (select key, min(team_id) as team_id from k2 where key not in (select key from o1) group by key having count(distinct team_id) = 1)"


@query("t07_name_index", NAME_INDEX + " select * from o1 union all select * from o2")
def name_index(s: Star) -> DataFrame:
    """T07, T08's index."""
    return T.name_index(labels(s))


@query("t08_resolve", NAME_INDEX + f", w as (select regexp_replace(name, 'St\\.$', 'State') as opponent from lab), q as (select opponent, unnest([{NORM.format('opponent')}, {NARROW.format('opponent')}, {NARROW.format("replace(opponent, '-', ' ')")}]) as key, unnest([0, 1, 2]) as place from (select distinct opponent from w)), f as (select opponent, min_by(team_id, place) as team_id from q join (select * from o1 union all select * from o2) using (key) group by opponent) select opponent, team_id from w left join f using (opponent)")
def resolve(s: Star) -> DataFrame:
    """Names as games write them, against the index."""
    written = labels(s).select(F.regexp_replace("name", "St\\.$", "State").alias("opponent"))
    return T.resolve(written, T.name_index(labels(s)), "opponent")


def catalogue(s: Star) -> DataFrame:
    """A directory of invented team names: (name), distinct."""
    return s.table("part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name")).distinct()


def misspelt(name: Column) -> Column:
    """A name as a scorer may write it: without its fifth character, a brand without its sign."""
    return F.regexp_replace(F.concat(F.substring(name, 1, 4), F.substring(name, 6, 200)), "#", " ")


@query("t10_fuzzy")
def fuzzy(s: Star) -> DataFrame:
    """Against a brute force in tests; SQL has no matching-block ratio."""
    known = catalogue(s)
    written = known.select(misspelt(F.col("name")).alias("opponent")).unionByName(known.select(F.col("name").alias("opponent")))
    exact = known.select("name", F.col("name").alias("team"))
    overrides = known.filter("name like 'red %'").select(misspelt(F.col("name")).alias("name"), F.lit("by hand").alias("team")).groupBy("name").agg(F.max("team").alias("team"))
    return matches(written, "opponent", overrides, exact, known).select("opponent", "kind", "team")


@query("k35_diagnosis")
def diagnosis(s: Star) -> DataFrame:
    """The two nearest names from .6 on, for names that the directory doesn't have."""
    known = labels(s).select("name").unionByName(s.table("part").select(F.col("p_name").alias("name")))
    written = known.select(misspelt(F.col("name")).alias("name"))
    return close_matches(written, known, 0.6, 2).select("name", "place", "choice", F.round("ratio", 6).alias("ratio"))


@query("t20_histories", ", h as (select player_id, season, max(opponent_team_id) as team from lines group by 1, 2) select player_id, 'T' || cast(team as varchar) as team, season from h")
def histories(s: Star) -> DataFrame:
    """Rendered stints come back as one row a season."""
    team = s.lines.groupBy("player_id", "season").agg(F.max("opponent_team_id").alias("team"))
    w = Window.partitionBy("player_id").orderBy("season")
    joined = (F.lag("team").over(w).eqNullSafe(F.col("team"))) & (F.lag("season").over(w) == F.col("season") - 1)
    spans = team.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("island", F.sum("new").over(w)).groupBy("player_id", "island", "team").agg(F.min("season").alias("a"), F.max("season").alias("b"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", F.format_string("T%d (%d-%d)", "team", "a", "b").alias("t")))), lambda x: x.t), " -> ")
    return T.transfer_rows(spans.groupBy("player_id").agg(text.alias("history")), "history", 8).select("player_id", "team", "season")


# -- checks -----------------------------------------------------------------------------


@query(
    "k08_findings",
    """, f as (select 'ERROR' as severity, 'duplicate lines' as category, count(*) as n from (select player_id, game_id from lines group by 1, 2 having count(*) > 1)
 union all select 'ERROR', 'orphan teams', count(*) from lines where team_id not in (select team_id from teams)
 union all select 'ERROR', 'self play', count(*) from games where home_team_id = away_team_id
 union all select 'WARNING', 'roster sizes', count(*) from (select t.team_id, count(player_id) as n from teams t left join players p using (team_id) group by 1) where n < 6 or n > 26
 union all select 'WARNING', 'missing names', count(*) from players where name is null or trim(name) = ''
 union all select 'WARNING', 'impossible lines', count(*) from lines where fgm > fga or tfgm > tfga or ftm > fta or minutes > 55 or points > 65 or rebounds > 35) select * from f""",
)
def findings(s: Star) -> DataFrame:
    """K01 to K08."""
    bad = s.lines.filter("fgm > fga or tfgm > tfga or ftm > fta or minutes > 55 or points > 65 or rebounds > 35")
    return K.findings(
        {"duplicate lines": K.duplicates(s.lines, "player_id", "game_id"), "orphan teams": K.orphans(s.lines, "team_id", s.teams, "team_id"), "self play": K.self_play(s.games)},
        {"roster sizes": K.roster_sizes(s.players, s.teams), "missing names": K.missing(s.players, "name"), "impossible lines": bad},
    )


@query("k09_sanity", ", r as (select count(*) filter (fgm > fga or tfgm > tfga or ftm > fta) as a, count(*) filter (minutes > 55) as b, count(*) filter (points > 65) as c, count(*) filter (rebounds > 35) as d, count(*) filter (points <> 2 * (fgm - tfgm) + 3 * tfgm + ftm) as e, count(*) filter (minutes < 0 or minutes > 60) as f, cast(0 as bigint) as g from lines) select unnest(['made over attempts', 'minutes over 55', 'points over 65', 'rebounds over 35', 'points differ', 'minutes out of 0 to 60', 'negative']) as category, unnest([a, b, c, d, e, f, g]) as n from r")
def sanity(s: Star) -> DataFrame:
    return K.sanity(s.lines)


@query("k03_rosters", ", n as (select t.team_id, count(player_id) as players from teams t left join players p using (team_id) group by 1) select team_id, players, case when players = 0 then 'none' when players < 6 then 'small' else 'large' end as problem from n where players < 6 or players > 26")
def rosters(s: Star) -> DataFrame:
    return K.roster_sizes(s.players, s.teams)


@query("k11_dedupe_games", ", g as (select season, home_team_id, away_team_id, home_score, away_score, season * 10000 + home_team_id * 100 + away_team_id as game_id from games), d as (select * from g union all select season, away_team_id, home_team_id, away_score, home_score, null from g), k as (select *, row_number() over (partition by season, least(home_team_id, away_team_id), greatest(home_team_id, away_team_id), case when home_team_id > away_team_id then away_score else home_score end, case when home_team_id > away_team_id then home_score else away_score end order by game_id is null, game_id) as n from d) select season, home_team_id, away_team_id, home_score, away_score, cast(game_id as bigint) as game_id from k where n = 1")
def dedupe(s: Star) -> DataFrame:
    """Every game once more from the other side and without an id."""
    g = s.games.select("season", "home_team_id", "away_team_id", "home_score", "away_score", (F.col("season") * 10000 + F.col("home_team_id") * 100 + F.col("away_team_id")).cast("long").alias("game_id"))
    flipped = g.select("season", F.col("away_team_id").alias("home_team_id"), F.col("home_team_id").alias("away_team_id"), F.col("away_score").alias("home_score"), F.col("home_score").alias("away_score"), F.lit(None).cast("long").alias("game_id"))
    return K.dedupe_games(g.unionByName(flipped))


@query("k12_cascade", ", r as (select distinct game_id from lines where fouls = 0) select season, count(*) as lines, count(distinct player_id) as players from lines where game_id not in (select game_id from r) group by season")
def cascade(s: Star) -> DataFrame:
    """Removing games removes their lines; seasons are counted anew."""
    left = K.cascade(s.lines, s.lines.filter("fouls = 0"))
    return left.groupBy("season").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("player_id").alias("players"))


@query("k13_literal", "select season, count(*) as kept from (select distinct on (player_id, team_id, game_ts, minutes, points, rebounds, assists, steals, blocks, turnovers, fouls, fga, fgm, tfga, tfgm, fta, ftm) season from lines) group by season")
def literal(s: Star) -> DataFrame:
    """Every line twice, under another game id."""
    twice = s.lines.unionByName(s.lines.withColumn("game_id", F.col("game_id") + 1))
    return K.literal_duplicates(s.dealt(twice, "player_id", "game_ts")).groupBy("season").agg(F.count(F.lit(1)).alias("kept"))


@query("k15_ghosts", "select season, count(*) as ghosts from lines where assists = 1 and points < 5 group by season")
def ghosts(s: Star) -> DataFrame:
    """Lines emptied on purpose are found again."""
    zero = F.expr("assists = 1 and points < 5")
    emptied = s.lines.withColumns({c: F.when(zero, F.lit(0)).otherwise(F.col(c)) for c in ("minutes", *K.COUNTS)})
    return K.ghosts(emptied).groupBy("season").agg(F.count(F.lit(1)).alias("ghosts"))


@query("a20_season_rows", "select player_id, season, count(*) as games, cast(sum(started) as bigint) as games_started, max_by(team_id, (game_ts, game_id)) as team_id, max_by(opponent_team_id, (game_ts, game_id)) as last_opponent from lines group by 1, 2")
def season_rows(s: Star) -> DataFrame:
    """A20, K16."""
    return K.season_rows(s.lines)


@query("k17_boxes", ", b as (select team_id, opponent_team_id * 10000 + season as game_id, count(*) as players, cast(sum(minutes) as bigint) as minutes, cast(0 as bigint) as idle from lines group by team_id, opponent_team_id * 10000 + season) select team_id, game_id, players, minutes, idle from b where minutes >= 320")
def boxes(s: Star) -> DataFrame:
    """Here a season's meetings as one box."""
    season_game = s.lines.withColumn("game_id", F.col("opponent_team_id") * 10000 + F.col("season"))
    return K.merged_boxes(season_game)


@query("w10_clusters", ", c as (select team_id, player_id * 37 % 5000 as ext from players), f as (select *, coalesce(cast(ext - lag(ext) over w > 120 as int), 1) as new from c window w as (partition by team_id order by ext)), i as (select *, sum(new) over (partition by team_id order by ext rows unbounded preceding) as island from f) select team_id, cast(island as bigint) as island, count(*) as size, min(ext) as low, max(ext) as high from i group by 1, 2 having count(*) >= 4")
def clusters(s: Star) -> DataFrame:
    """W10, K18 to K20."""
    return K.clusters(s.players.select("team_id", (F.col("player_id") * 37 % 5000).alias("ext")), "team_id", "ext", 120, 4)


@query("k21_divisions", "select player_id, division, player_id % 3 = 0 and division <> 'D1' as changed from players join teams using (team_id)")
def divisions(s: Star) -> DataFrame:
    """A third of the rows say D1 whatever their team says."""
    joined = s.players.join(s.teams.select("team_id", "division"), "team_id").withColumn("division", F.when(F.col("player_id") % 3 == 0, "D1").otherwise(F.col("division")))
    return K.corrected(joined.select("player_id", "team_id", "division"), s.teams).select("player_id", "division", "changed")


@query("k23_fill", "select player_id, case when player_id % 4 = 0 then name || ' roster' else position end as position from players where position is not null")
def fill(s: Star) -> DataFrame:
    """Only blanks are filled."""
    blank = s.players.filter("position is not null").select("player_id", F.when(F.col("player_id") % 4 == 0, "").otherwise(F.col("position")).alias("position"))
    return K.fill_blank(blank, s.players.select("player_id", F.concat("name", F.lit(" roster")).alias("position")), "player_id", ["position"])


@query("k32_upsert", ", o as (select player_id, season, count(*) as games from lines group by 1, 2) select player_id, season, case when season = 1997 then games + 1000 else games end as games from o")
def upsert(s: Star) -> DataFrame:
    old = s.lines.groupBy("player_id", "season").agg(F.count(F.lit(1)).alias("games"))
    return K.upsert(old, old.filter("season = 1997").withColumn("games", F.col("games") + 1000), ["player_id", "season"])


@query("k26_external", ", p as (select player_id, 'N' || cast(player_id % 50 as varchar) as name, team_id, case when player_id % 3 = 0 then player_id end as external_id from players) select player_id from p where external_id is not null or not exists (select 1 from p q where lower(q.name) = lower(p.name) and q.team_id = p.team_id and q.external_id is not null)")
def external(s: Star) -> DataFrame:
    p = s.players.select("player_id", F.concat(F.lit("N"), (F.col("player_id") % 50).cast("string")).alias("name"), "team_id", F.when(F.col("player_id") % 3 == 0, F.col("player_id")).alias("external_id"))
    return K.one_external(p).select("player_id")


@query("k27_uncovered", ", e as (select distinct season * 10000 + home_team_id * 100 + away_team_id as game_id from games), c as (select distinct season * 10000 + team_id * 100 + opponent_team_id as game_id from lines where points > 60) select game_id from e where game_id not in (select game_id from c)")
def uncovered(s: Star) -> DataFrame:
    """K27, K28, J14."""
    games = s.games.select((F.col("season") * 10000 + F.col("home_team_id") * 100 + F.col("away_team_id")).alias("game_id"))
    lines = s.lines.filter("points > 60").select((F.col("season") * 10000 + F.col("team_id") * 100 + F.col("opponent_team_id")).alias("game_id"))
    return K.uncovered(games.distinct(), lines)


@query(
    "k29_identities",
    ", s as (select player_id as ref, 'n' || cast(player_id % 400 as varchar) as name_key, team_id, 'town' || cast(player_id % 7 as varchar) as hometown, case when player_id % 5 = 0 then player_id end as external_id from players), k as (select * from s where ref % 2 = 0), f as (select s.*, coalesce((select min(ref) from k where k.external_id = s.external_id), (select min(ref) from k where k.name_key = s.name_key and k.hometown = s.hometown), (select min(ref) from k where k.name_key = s.name_key and k.team_id = s.team_id)) as found from s), n as (select name_key, team_id, (select max(ref) from k) + row_number() over (order by name_key, team_id) as new_id from (select distinct name_key, team_id from f where found is null)) select ref, coalesce(found, new_id) as player_id from f left join n using (name_key, team_id)",
)
def identities(s: Star) -> DataFrame:
    """K29, K30, K36."""
    seen = s.players.select(F.col("player_id").alias("ref"), F.concat(F.lit("n"), (F.col("player_id") % 400).cast("string")).alias("name_key"), "team_id", F.concat(F.lit("town"), (F.col("player_id") % 7).cast("string")).alias("hometown"), F.when(F.col("player_id") % 5 == 0, F.col("player_id")).alias("external_id"))
    known = seen.filter("ref % 2 = 0").withColumnRenamed("ref", "player_id")
    return K.identities(seen, known).select("ref", "player_id")


@query("k31_our_side", ", s as (select game_id, started as side, player_id as name_key from lines), r as (select distinct player_id as name_key from players where team_id = 6), n as (select game_id, side, count(distinct name_key) as overlap from s join r using (name_key) group by 1, 2), m as (select *, max(overlap) over (partition by game_id) as top from n), t as (select *, count(*) over (partition by game_id) as ties from m where overlap = top) select game_id, side, overlap from t where ties = 1")
def our_side(s: Star) -> DataFrame:
    """The side of each game that one team's roster is on."""
    sides = s.lines.select("game_id", F.col("started").alias("side"), F.col("player_id").alias("name_key"))
    return K.our_side(sides, s.players.filter("team_id = 6").select(F.col("player_id").alias("name_key")))


@query("k10_unresolved", ", u as (select player_id, opponent_team_id as candidate from lines where minutes > 38) select player_id, min(candidate) as team_id from u group by player_id having count(distinct candidate) = 1")
def unresolved(s: Star) -> DataFrame:
    return K.unresolved(s.lines.filter("minutes > 38").select("player_id", F.lit(-1).alias("team_id"), F.col("opponent_team_id").alias("candidate")))


@query("k36_records", ", r as (select season, team_id, count(*) filter (scored > allowed) as w, count(*) filter (scored < allowed) as l from sides group by 1, 2) select season, team_id, cast(w as varchar) || '-' || cast(l as varchar) as record from r")
def records(s: Star) -> DataFrame:
    from tipoff.operators.ratings import unpivot

    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("string")
    return unpivot(s.games).groupBy("season", "team_id").agg(F.concat_ws("-", n(F.col("scored") > F.col("allowed")), n(F.col("scored") < F.col("allowed"))).alias("record"))


@query("f14_winners", "select season, home_team_id, away_team_id, coalesce(case when home_score > away_score then home_team_id when away_score > home_score then away_team_id end, -1) as winner_team_id from games")
def winners(s: Star) -> DataFrame:
    """A tie has no winner (here -1)."""
    w = M.winner(*map(F.col, ("home_team_id", "away_team_id", "home_score", "away_score")), F.lit(None).cast("long"))
    return s.games.select("season", "home_team_id", "away_team_id", F.coalesce(w, F.lit(-1)).cast("long").alias("winner_team_id"))


@query("f11_fields", "select player_id, coalesce(nullif(trim(case when player_id % 3 = 0 then ' ' else position end), ''), class_year) as field, case when player_id % 7 = 0 then 'yes' when player_id % 7 = 1 then 'no' else 'unknown' end as portal, case when player_id % 2 = 0 then 1 else 0 end as started from players")
def fields(s: Star) -> DataFrame:
    """F11 to F13."""
    flag = F.when(F.col("player_id") % 7 == 0, " Yes ").when(F.col("player_id") % 7 == 1, "FALSE").otherwise("?")
    known = F.coalesce(F.when(M.three_state(flag), "yes").otherwise(F.when(~M.three_state(flag), "no")), F.lit("unknown"))
    return s.players.select("player_id", M.first_text(F.when(F.col("player_id") % 3 == 0, " ").otherwise(F.col("position")), F.col("class_year")).alias("field"), known.alias("portal"), M.started_flag(F.when(F.col("player_id") % 2 == 0, "Y").otherwise("n")).alias("started"))


@query("m14_tiers", "select team_id, case when conference in ('ACC', 'Big 10', 'SEC', 'Big 12', 'Big East') then 'High-Major' when conference in ('American', 'Atlantic 10', 'MWC', 'WCC', 'Coastal', 'MVC') then 'Mid-Major' else 'Low-Major' end as tier from (select team_id, case when team_id % 3 = 0 then 'SEC' when team_id % 3 = 1 then 'WCC' else conference end as conference from teams)")
def tiers(s: Star) -> DataFrame:
    """M14, F08."""
    conference = F.when(F.col("team_id") % 3 == 0, "SEC").when(F.col("team_id") % 3 == 1, "WCC").otherwise(F.col("conference"))
    return s.teams.select("team_id", M.normal_tier(M.classify_tier(F.col("name"), conference)).alias("tier"))


@query("m09_old_curve", ", z as (select player_id, season, (sum(points) - avg(sum(points)) over (partition by season)) / coalesce(nullif(stddev_pop(sum(points)) over (partition by season), 0), 1.0) as z from lines group by 1, 2) select player_id, season, round(greatest(30.0, least(99.0, 60 + 12 * z + 3 * greatest(0.0, z) * greatest(0.0, z))), 1) as score from z")
def old_curve(s: Star) -> DataFrame:
    """M09, L04, X8."""
    w = Window.partitionBy("season")
    total = s.lines.groupBy("player_id", "season").agg(F.sum("points").cast("double").alias("p"))
    z = (F.col("p") - F.avg("p").over(w)) / F.coalesce(F.nullif(F.stddev_pop("p").over(w), F.lit(0.0)), F.lit(1.0))
    return total.withColumn("z", z).select("player_id", "season", M.shown(M.old_score_curve(F.col("z"))).alias("score"))


@query("m29_old_transfer", "select o_orderkey, round(greatest(0.7, least(1.12, 1 - g / 2500)) * 1.05 + 1e-9, 4) as production, round(30 * greatest(0.55, least(1.05, 1 - g / 3200)) + 1e-9, 4) as minutes, round(greatest(-6.0, least(3.0, -g / 400)) + 1e-9, 4) as shift, round(1 / (1 + exp(-(30 * greatest(0.55, least(1.05, 1 - g / 3200)) - 21) / 4)) + 1e-9, 4) as starter from (select o_orderkey, cast(o_orderkey % 3000 - 1500 as double) as g from orders)")
def old_transfer(s: Star) -> DataFrame:
    """M02, M29."""
    got = M.old_transfer((F.col("o_orderkey") % 3000 - 1500).cast("double"), F.lit(1.05), F.lit(30.0))
    return s.table("orders").select("o_orderkey", *[rate(c + 1e-9).alias(n) for n, c in got.items()])


@query("l01_old_roles", ", t as (select p.player_id, p.team_id, sum(minutes) / count(*) as m from lines l join players p using (player_id) where season = (select season from current) group by 1, 2), k as (select *, row_number() over (partition by team_id order by round(m, 6) desc, player_id) as place from t) select team_id, round(avg(m) filter (place <= 5), 3) as starter, round(max(m) filter (place = 6), 3) as sixth, round(avg(m) filter (place between 7 and 10), 3) as bench from k group by team_id", keep=True)
def old_roles(s: Star) -> DataFrame:
    """Roles by rank of minutes."""
    mean = s.of_latest(s.lines).groupBy("player_id").agg((F.sum("minutes") / F.count(F.lit(1))).alias("m")).join(s.players.select("player_id", "team_id"), "player_id")
    place = F.row_number().over(Window.partitionBy("team_id").orderBy(F.round("m", 6).desc(), "player_id"))
    part = lambda c: F.when(c, F.col("m"))
    return mean.withColumn("place", place).groupBy("team_id").agg(F.round(F.avg(part(F.col("place") <= 5)), 3).alias("starter"), F.round(F.max(part(F.col("place") == 6)), 3).alias("sixth"), F.round(F.avg(part(F.col("place").between(7, 10))), 3).alias("bench"))


@query("u01_tiers_of_players", ", a as (select distinct player_id from lines where season = (select season from current)), b as (select distinct player_id from lines) select player_id, case when player_id in (select player_id from a) then 'played' when player_id in (select player_id from b) then 'rostered' else 'sheet' end as kind from players", keep=True)
def inclusion(s: Star) -> DataFrame:
    """Disjoint branches, later ones without the earlier."""
    played = s.of_latest(s.lines).select("player_id").distinct()
    rostered = s.lines.select("player_id").distinct().join(played, "player_id", "left_anti")
    sheet = s.players.select("player_id").join(s.lines.select("player_id").distinct(), "player_id", "left_anti")
    return played.withColumn("kind", F.lit("played")).unionByName(rostered.withColumn("kind", F.lit("rostered"))).unionByName(sheet.withColumn("kind", F.lit("sheet")))
