"""Partition refresh, id ledger, fetching and sheets."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tipoff.operators import ledger
from tipoff.operators import quality as K
from tipoff.sources import fetch, partitions, sheets


def seasons(spark, rows):
    return spark.createDataFrame(rows, "sport string, season int, player_id long, points long")


def files(spark, path):
    rows = spark.read.parquet(path).select("sport", "season", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).distinct().collect()
    return {(r.sport, r.season, r.f.rpartition("/")[2], r.t) for r in rows}


def test_only_touched_partitions_change(spark, tmp_path):
    live = str(tmp_path / "t")
    partitions.replace_partitions(seasons(spark, [(s, y, p, 1) for s in ("a", "b") for y in (1, 2) for p in range(5)]), live, ["sport", "season"])
    before = files(spark, live)
    changed = partitions.upsert_partitions(seasons(spark, [("a", 2, 3, 9), ("a", 2, 77, 9), ("c", 1, 1, 9)]), live, ["sport", "season"], ["player_id"])
    assert changed == ["sport=a/season=2", "sport=c/season=1"]
    same = {f for f in before if f[:2] != ("a", 2)}
    assert same < files(spark, live) and not {f for f in before if f[:2] == ("a", 2)} & files(spark, live)
    rows = {(r.sport, r.season, r.player_id): r.points for r in spark.read.parquet(live).collect()}
    assert len(rows) == 22 and rows["a", 2, 3] == rows["a", 2, 77] == rows["c", 1, 1] == 9 and rows["a", 2, 4] == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    assert not list((tmp_path / "t").rglob(".old-*"))


def test_gate_sees_only_what_changes(spark, tmp_path):
    live = str(tmp_path / "t")
    partitions.replace_partitions(seasons(spark, [("a", 1, 1, None), ("a", 2, 1, 5)]), live, ["sport", "season"])
    checks = lambda staged: K.findings({"no points": staged.filter("points is null")}, {})
    assert partitions.replace_partitions(seasons(spark, [("a", 2, 1, 6)]), live, ["sport", "season"], checks) == ["sport=a/season=2"]
    before = files(spark, live)
    with pytest.raises(partitions.PartitionError):
        partitions.replace_partitions(seasons(spark, [("a", 2, 1, 6), ("a", 3, 1, None)]), live, ["sport", "season"], checks)
    assert files(spark, live) == before and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_ids_stay(spark, tmp_path):
    path = str(tmp_path / "ids")
    frame = lambda names: spark.createDataFrame([(n, len(n or "")) for n in names], "name string, size int")
    read = lambda df: {r.name: r.ledger_id for r in df.collect()}
    first = read(ledger.assign(frame(["b", "d", None, "b"]), path))
    assert sorted(first.values()) == [1, 2, 3]
    # a call that died: a batch without its mark
    (tmp_path / "ids" / "batch-000001").mkdir()
    second = read(ledger.assign(frame(["a", "b", "c", "d", None]), path))
    assert {k: second[k] for k in first} == first and sorted(second.values()) == [1, 2, 3, 4, 5]
    again = ledger.assign(frame(["a", "c", "e"]).repartition(7), path)
    assert read(again) == read(again) and {k: v for k, v in read(again).items() if k != "e"} == {k: second[k] for k in ("a", "c")}
    assert len(ledger.batches(spark, path)) == 3


class Pages(BaseHTTPRequestHandler):
    asked: dict[str, int] = {}

    def do_GET(self):  # noqa: N802
        n = Pages.asked[self.path] = Pages.asked.get(self.path, 0) + 1
        kind = self.path.strip("/").split("-")[0]
        code = {"busy": 429 if n < 3 else 200, "broken": 500, "gone": 404, "later": 500 if n < 2 else 200}.get(kind, 200)
        self.send_response(code)
        if code == 429:
            self.send_header("Retry-After", "0")
        self.end_headers()
        self.wfile.write((b"x" if kind == "small" else b"page " * 50) if code == 200 else b"no")

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    Pages.asked = {}
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, site, tmp_path):
    names = ["fine-1", "fine-2", "busy-1", "broken-1", "gone-1", "later-1", "small-1"]
    work = spark.createDataFrame([(f"{site}/{n}",) for n in names] + [("no url",), (None,), (f"{site}/fine-1",)], "url string")
    ask = lambda: {r.url.rpartition("/")[2]: r for r in fetch.fetch(spark, work, str(tmp_path / "done"), 3, tries=3, wait=0.01, timeout=5, floor=10).collect()}
    got = ask()
    assert got.keys() == {*names, "no url"}
    assert {k for k, r in got.items() if r.error is None} == {"fine-1", "fine-2", "busy-1", "later-1"}
    assert got["fine-1"].bytes == 250 == len(got["fine-1"].body) and got["busy-1"].tries == 3 and got["later-1"].tries == 2
    assert (got["broken-1"].status, got["broken-1"].tries) == (500, 3) and (got["gone-1"].status, got["gone-1"].tries) == (404, 1)
    assert "10 are the least" in got["small-1"].error and got["no url"].error.startswith("ValueError") and got["fine-1"].fetched_at is not None
    counts = dict(Pages.asked)
    again = ask()
    assert again.keys() == got.keys() and again["fine-1"].fetched_at == got["fine-1"].fetched_at
    assert all(Pages.asked[p] == n for p, n in counts.items() if p[1:] in ("fine-1", "fine-2", "busy-1", "later-1"))
    assert Pages.asked["/gone-1"] == counts["/gone-1"] + 1


def test_waits_grow_and_follow_the_server():
    waits = []
    got = fetch.fetched("http://127.0.0.1:1/", fetch.Rules(tries=4, wait=1.0, timeout=0.2, longest=2.5), waits.append)
    assert got[2] is None and got[4] == 4 and waits == [1.0, 2.0, 2.5]


def test_sheet_types_and_header(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Season report\n,,\nNotes,x\nTeam ID, Name ,Win pct,,Code,ID,Team ID\n1,Ann,0.5,q,7,1,z\n2, Bo ,1,q,x7,,z\n,,,,,,\n3,"C, D",,q,9,3,z\n')
    got = sheets.read_sheet(spark, str(tmp_path / "s.csv"), ["team_id", "name"])
    assert got.dtypes == [("team_id", "bigint"), ("name", "string"), ("win_pct", "double"), ("code", "string"), ("id", "bigint")]
    assert sorted(map(tuple, got.collect())) == [(1, "Ann", 0.5, "7", 1), (2, " Bo ", 1.0, "x7", None), (3, "C, D", None, "9", 3)]
    with pytest.raises(ValueError):
        sheets.read_sheet(spark, str(tmp_path / "s.csv"), ["team_id", "nothing"])


def test_kinds_are_a_lattice(spark):
    cases = {"12": 0, "-3": 0, " 4 ": 0, "1.5": 1, ".5": 1, "2.": 1, "1e5": 1, "": 2, "1-2": 2, "nan": 2, "12345678901234567890": 1}
    got = {r.x: r.k for r in spark.createDataFrame([(k,) for k in cases], "x string").select("x", sheets.kind(F.col("x")).alias("k")).collect()}
    assert got == cases
