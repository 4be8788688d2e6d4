"""Forms for tables beyond one worker, against plain ones."""

import difflib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from tipoff.operators import matching, ordering
from tipoff.operators import ratings as R


# -- fuzzy names -------------------------------------------------------------------------


def invented(seed, count):
    rng = random.Random(seed)
    parts = ["north", "state", "tech", "saint", "mary's", "college", "of", "the", "red", "a&m", "aaaa", "ab", "é", "-"]
    names = [" ".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(count)]
    for n in list(names):
        at = rng.randrange(len(n))
        names.append(n[:at] + rng.choice(["", "x", n[at] * 2]) + n[at + 1 :])
    return names + ["", "a", "b", "aa", "ab" * 40, "ba" * 40, "x" * 210, "x" * 205 + "yy"]


def test_matching_blocks_equal_difflib():
    rng = random.Random(4)
    names = invented(1, 60)
    some = [(rng.choice(names), rng.choice(names)) for _ in range(600)]
    some = [(a, b) for a, b in some if len(b) < matching.LONG]
    got = matching.matching([a for a, _ in some], [b for _, b in some])
    want = [sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in some]
    assert got.tolist() == want


def nearest(names, choices, cutoff, top):
    choices = sorted({c for c in choices if c})
    out = set()
    for n in {n for n in names if n}:
        for i, c in enumerate(difflib.get_close_matches(n, choices, top, cutoff), 1):
            out.add((n, i, c, round(difflib.SequenceMatcher(None, c, n).ratio(), 9)))
    return out


@pytest.mark.parametrize("cutoff,top,group", [(0.87, 1, 2000), (0.6, 2, 3), (0.95, 3, 1), (0.3, 2, 2000)])
def test_close_matches(spark, monkeypatch, cutoff, top, group):
    monkeypatch.setattr(matching, "GROUP", group)
    asked, offered = [*invented(2, 50), None], [*invented(2, 30), *invented(3, 30), None]
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {(r.name, r.place, r.choice, round(r.ratio, 9)) for r in matching.close_matches(frame(asked), frame(offered), cutoff, top).collect()}
    assert got == nearest([a for a in asked if a], [o for o in offered if o], cutoff, top)


def test_shared_grams_of_all_pairs(monkeypatch):
    """By tables of any width, against counters."""
    names, choices = invented(5, 20), invented(6, 20)
    for wide, size in ((2048, 1), (3, 1), (2048, 2), (7, 2)):
        monkeypatch.setattr(matching, "WIDE", wide)
        bag = lambda n: Counter(n[i : i + size] for i in range(len(n) - size + 1))
        assert matching.shared(names, choices, size).tolist() == [[(bag(a) & bag(b)).total() for b in choices] for a in names]


def test_blocks_of_many_pairs_take_time_in_proportion():
    names = [f"{a} Brand {i}" for i in range(5_000) for a in ("large ring", "hot bolt")]
    began = time.process_time()
    got = matching.matching(names, names[1:] + names[:1])
    assert time.process_time() - began < 8  # 16 s for 10,000 pairs when each asked for the longest of all
    assert got[0] == sum(m.size for m in difflib.SequenceMatcher(None, names[0], names[1]).get_matching_blocks())


def test_fuzzy_query_equals_difflib(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    known = sorted({f"{p.p_name} {p.p_brand} {p.p_type}" for p in parts})
    wrong = lambda n: (n[:4] + n[5:]).replace("#", " ")
    over = {wrong(n) for n in known if n.startswith("red ")}
    want = Counter()
    for n in [*map(wrong, known), *known]:
        near = difflib.get_close_matches(n, known, 1, 0.87)
        want[(n, "override", "by hand") if n in over else (n, "exact", n) if n in known else (n, "fuzzy", near[0]) if near else (n, "unmatched", None)] += 1
    assert Counter((r.opponent, r.kind, r.team) for r in entry.queries()["t10_fuzzy"](spark, SF).collect()) == want
    assert {k for _, k, _ in want} >= {"override", "exact", "fuzzy"}


def test_diagnosis_query_equals_difflib(spark):
    from tipoff.plans.checks import labels
    from tipoff.sources.star import Star

    known = [r.name for r in labels(Star(spark, SF)).select("name").collect()] + [r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    want = {(n, i, c, round(x, 6)) for n, i, c, x in nearest([(k[:4] + k[5:]).replace("#", " ") for k in known], known, 0.6, 2)}
    assert {tuple(r) for r in entry.queries()["k35_diagnosis"](spark, SF).collect()} == want


# -- places, ranks and percentiles -------------------------------------------------------


def test_places_are_those_of_one_window(spark):
    rng = np.random.default_rng(3)
    rows = [(None if g == 3 else int(g), int(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 4, 500), rng.integers(0, 20, 500), strict=True))]
    frame = spark.createDataFrame(rows, "g int, v int, id int")
    got = {r.id: r.place for r in ordering.numbered(frame, ["g"], [F.desc("v"), F.asc("id")], "place").collect()}
    for g in (None, 0, 1, 2):
        mine = sorted((-v, i) for h, v, i in rows if h == g)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))


def test_value_ranks_share_first_places(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 9, 400), strict=True))]
    got = {r.id: (r.place, r.place_of) for r in ordering.value_ranks(spark.createDataFrame(rows, "g int, v double, id int"), ["g"], "v", "place").collect()}
    for g, v, i in rows:
        group = [x for h, x, _ in rows if h == g]
        assert got[i] == (1 + sum(x > v for x in group), len(group))


@pytest.mark.parametrize("bins", [1024, 2])
def test_percentiles_are_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(ordering, "BINS", bins)
    rng = np.random.default_rng(5)
    groups = {"normal": rng.normal(size=333), "ties": rng.integers(0, 3, 100).astype(float), "one": np.array([7.0]), "wide": 10.0 ** rng.integers(-30, 30, 80), "few": np.array([1.0, 2.0]), "same": np.full(50, 0.1)}
    frame = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("normal", None)], "g string, x double")
    shares = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p99": 0.99, "first": 0.0, "last": 1.0}
    got = {r.g: r for r in ordering.percentiles(frame, ["g"], "x", shares).collect()}
    for k, v in groups.items():
        assert got[k].n == len(v)
        assert [got[k][s] for s in shares] == pytest.approx([np.quantile(v, p) for p in shares.values()], rel=1e-12)
    assert {r.g for r in ordering.percentiles(frame, ["g"], "x", shares, least=50).collect()} == {"normal", "ties", "wide", "same"}


# -- ratings -----------------------------------------------------------------------------


def schedule(spark, seed=1, teams=40, games=400):
    rng = np.random.default_rng(seed)
    rows = [(1 + int(s), int(a), int(b), int(x), int(y), i) for i, (s, a, b, x, y) in enumerate(zip(rng.integers(0, 3, games), rng.integers(0, teams, games), rng.integers(0, teams, games), rng.integers(40, 90, games), rng.integers(40, 90, games), strict=True)) if a != b]
    return spark.createDataFrame(rows, "season int, home_team_id long, away_team_id long, home_score long, away_score long, game_order long")


@pytest.mark.parametrize("damping,every", [(0.5, 1), (0.5, 4), (0.0, 1)])
def test_distributed_solver_is_the_solver(spark, damping, every):
    sides = R.unpivot(schedule(spark))
    key = lambda r: (r.season, r.team_id)
    a = {key(r): r for r in R.solve_ratings(sides, 25, 1e-2, damping).collect()}
    b = {key(r): r for r in R.solve_distributed(sides, 25, 1e-2, damping, every=every).collect()}
    assert a.keys() == b.keys()
    for k, r in a.items():
        if every == 1:
            assert (r.iterations, r.games) == (b[k].iterations, b[k].games)
            assert [b[k].off_rating, b[k].def_rating, b[k].rating, b[k].max_change] == pytest.approx([r.off_rating, r.def_rating, r.rating, r.max_change], abs=1e-8)
        else:
            assert b[k].rating == pytest.approx(r.rating, abs=0.1)


@pytest.mark.parametrize("epochs,together", [(1, 8), (3, 5)])
def test_waves_equal_the_loop(spark, epochs, together):
    games = schedule(spark, 2, teams=12, games=60)
    a = {(r.season, r.team_id): (r.elo, r.games) for r in R.elo(games, epochs=epochs).collect()}
    b = {(r.season, r.team_id): (r.elo, r.games) for r in R.elo_waves(games, epochs=epochs, together=together).collect()}
    assert a.keys() == b.keys()
    assert all(b[k][1] == n and b[k][0] == pytest.approx(x, abs=1e-8) for k, (x, n) in a.items())


def test_no_task_sorts_a_league(spark):
    plan = entry.queries()["w03_percentile"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
