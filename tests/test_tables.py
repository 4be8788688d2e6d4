"""Readers, writers, refresh and pages."""

import random

import pytest

from tests.conftest import SF
from tipoff.plans.refresh import RefreshError, refresh
from tipoff.sources import html, sheets
from tipoff.sources import tables as S
from tipoff.streaming import events as E


def frames(spark, self_play=False):
    teams = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "team_id long, name string")
    players = spark.createDataFrame([(i, f"p{i}", i % 3) for i in range(30)], "player_id long, name string, team_id long")
    games = spark.createDataFrame([("g1", "2025-26", 0, 0 if self_play else 1, 70, 60)], "game_id string, season string, home_team_id long, away_team_id long, home_score int, away_score int")
    lines = spark.createDataFrame([(1, "g1", "2025-26", 12)], "player_id long, game_id string, season string, points int")
    return {"teams": teams, "players": players, "games": games, "player_game_logs": lines}


def test_refresh_writes_and_swaps(spark, tmp_path):
    live = str(tmp_path / "live")
    for _ in range(2):
        refresh(spark, frames(spark), live)
    assert S.read_table(spark, live, "teams").count() == 3
    assert S.read_table(spark, live, "games").first().season == "2025-26"
    assert (tmp_path / "live.backup").exists()


def test_refresh_stops_at_errors(spark, tmp_path):
    with pytest.raises(RefreshError):
        refresh(spark, frames(spark, self_play=True), str(tmp_path / "live"))
    assert not (tmp_path / "live").exists()


def test_conform_adds_and_drops(spark):
    got = S.conform(spark.createDataFrame([(1, "x")], "TEAM_ID int, other string"), "team_id long, name string")
    assert got.dtypes == [("team_id", "bigint"), ("name", "string")] and got.first().name is None


def test_csv_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,\n,\n2,x\n")
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "a.csv")).orderBy("a").collect()] == [(1, None), (2, "x")]


def test_append_ignores_unknown_columns(spark, tmp_path):
    S.append_rows(spark.createDataFrame([("k", "v", 1)], "key string, value string, more int"), str(tmp_path), "meta")
    assert [tuple(r) for r in S.read_table(spark, str(tmp_path), "meta").collect()] == [("k", "v")]


def test_two_name_columns_and_broken_pages():
    page = "<table><tr><th>First</th><th>Last</th><th>Pos</th><th>Yr</th></tr><tr><td>Ann<td>Lee<td>G<td>FR</table>"
    assert html.roster_rows("u", page) == [("u", "Ann Lee", "G", None, "FR", None)]
    assert html.roster_rows("u", "<table><tr><td>nothing") == [] and html.roster_rows("u", None) == []


def test_labelled_template_and_marker_rows():
    page = "<table><tr><td><a href='/p/1'>Ann Lee</a></td><td>Pos: G</td><td>Yr: SO</td></tr></table>"
    assert html.labelled_rows("u", page) == [("u", "Ann Lee", "G", None, "SO", "/p/1")]
    head = "<tr><th>Player</th><th>MIN</th><th>FG</th><th>3PT</th><th>FT</th><th>PTS</th></tr>"
    box = f"<table>{head}<tr><td>STARTERS</td></tr><tr><td>#5 Ann</td><td>30</td><td>1-2</td><td>0-0</td><td>0-0</td><td>2</td></tr><tr><td>RESERVES</td></tr><tr><td>Bea</td><td>x</td><td>0-0</td><td>0-0</td><td>0-0</td><td>0</td></tr><tr><td>Totals</td></tr></table>"
    got = html.box_rows("u", box + box)
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [(0, "Ann", 1, 30), (0, "Bea", 0, 0), (1, "Ann", 1, 30), (1, "Bea", 0, 0)]
    assert html.box_rows("u", box) == []


def test_stream_upsert_versions(spark, tmp_path):
    write = E.upsert_into(str(tmp_path), ["user_id"])
    batch = lambda rows: spark.createDataFrame(rows, "user_id long, value double")
    write(batch([(1, 1.0), (2, 2.0)]), 0)
    write(batch([(2, 5.0), (3, 3.0)]), 1)
    write(batch([(2, 5.0), (3, 3.0)]), 1)
    got = spark.read.parquet(str(tmp_path / "v1"))
    assert sorted((r.user_id, r.value) for r in got.collect()) == [(1, 1.0), (2, 5.0), (3, 3.0)]


def test_game_links_guard(spark):
    pages = spark.createDataFrame([("u", "<a href='/box/1'>"), ("v", "<a href='/box/2'> <a href='/box/2'>")], "url string, html string")
    got = html.game_links(pages, "href='(/box/[0-9]+)'").collect()
    assert sorted((r.url, r.place, r.link) for r in got) == [("u", 0, "/box/1"), ("v", 0, "/box/2")]
    with pytest.raises(html.NoLinks):
        html.game_links(pages.union(spark.createDataFrame([("w", "slow down")], "url string, html string")), "href='(/box/[0-9]+)'")


def test_plain_pages_are_read_as_the_parser_reads_them():
    rng = random.Random(3)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<html>", "</html>", "x > y", " 12  P\n", "a"]
    odd = ["&amp;", "<a href='/p'>", "</a>", "<TD>", "<td class='b'>", "<!-- <td> -->", "<", "<script>", "<br/>"]
    plain = 0
    for n in range(400):
        page = "".join(rng.choices(bits + (odd if n % 2 else []), k=rng.randint(0, 30)))
        parser = html._Tables()
        parser.feed(page)
        parser.close()
        assert html.tables(page) == parser.tables, page
        plain += html._plain_tables(page) is not None
    assert plain >= 200


def test_sheets_are_read_as_wide_as_they_are(spark, tmp_path):
    (tmp_path / "a.csv").write_text('top\nkey,value,\nversion,"1,2",\n,,\n')
    assert sheets.width(spark, str(tmp_path / "a.csv")) == 4
    assert [tuple(r) for r in sheets.read_sheet(spark, str(tmp_path / "a.csv"), ["key", "value"]).collect()] == [("version", "1,2")]
    (tmp_path / "b.csv").write_text("key," * 200 + "\n")
    assert sheets.width(spark, str(tmp_path / "b.csv")) == sheets.MOST


def test_streams_end_in_files(spark, tmp_path):
    got = E.drained(E.once(E.source(spark, SF, "events.parquet")).select("event_id"))
    assert got.inputFiles() and got.count() == spark.read.parquet(f"{SF}/events.parquet").select("event_id").distinct().count()
