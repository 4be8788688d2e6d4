"""The command line gives the queries' rows."""

import io
import json

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tipoff.__main__ import main


def asked(*argv):
    out = io.StringIO()
    code = main(["--tables", SF, *argv], out)
    return code, [json.loads(line) for line in out.getvalue().splitlines()]


def test_commands(spark):
    code, rows = asked("needs", "--team", "3", "--top", "2")
    assert code == 0 and [r["place"] for r in rows] == [1, 2] and {r["team_id"] for r in rows} == {3}
    code, rows = asked("fits", "--team", "3", "--stats", "ppg,topg", "--top", "5")
    want = {r.player_id for r in entry.queries()["q11_fits"](spark, SF).orderBy("fit_score", ascending=False).limit(5).collect()}
    assert code == 0 and {r["player_id"] for r in rows} == want
    assert asked("trajectory", "--player", "-5") == (1, [])


@pytest.mark.parametrize("argv", [("fits", "--team", "3", "--stats", "height"), ("project", "--team", "3", "--player", "7", "--minutes", "50"), ("query", "nothing")])
def test_unusable_parameters(spark, argv):
    code, rows = asked(*argv)
    assert code == 2 and "error" in rows[0]


def test_any_query(spark):
    code, rows = asked("query", "q16_conferences")
    assert code == 0 and len(rows) == entry.queries()["q16_conferences"](spark, SF).count()
