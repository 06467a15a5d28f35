"""Exchanges of sites against brute force over every pair."""

import random

import pytest
from pyspark.sql import functions as F

from depotry.operators import assign, cost, interchange, solve
from test_assign import POINT, km

SITE = "dataset string, wh_ord long, wh_id string, lat double, lon double"
CANDIDATE = "dataset string, cand_ord long, lat double, lon double"


def objective(points, sites):
    return sum(p[5] * min(km(p[3], p[4], a, b) for a, b in sites) for p in points)


def instance(d, n, k, m, seed):
    rng = random.Random(seed)
    points = [(d, i, f"P{i}", rng.uniform(12, 13), rng.uniform(77, 78), rng.choice((0, 1, 5, rng.randint(0, 40)))) for i in range(n)]
    sites = [(d, i, f"W{i}", rng.uniform(12, 13), rng.uniform(77, 78)) for i in range(k)]
    candidates = [(d, i, *(points[i % n][3:5] if i % 2 else (rng.uniform(12, 13), rng.uniform(77, 78)))) for i in range(m)]
    return points, sites, candidates


@pytest.mark.parametrize("k", [1, 2, 4])
def test_profits_equal_brute_force(spark, k):
    both = [instance(d, 40, k, 12, s) for d, s in (("a", 1), ("b", 2))]
    frames = [spark.createDataFrame([r for x in both for r in x[i]], kind) for i, kind in enumerate((POINT, SITE, CANDIDATE))]
    got = {(r["dataset"], r["cand_ord"], r["wh_ord"]): r["profit"] for r in interchange.swap_profits(*frames).collect()}
    for points, sites, candidates in both:
        now = objective(points, [s[3:] for s in sites])
        for c in candidates:
            for s in sites:
                want = now - objective(points, [t[3:] for t in sites if t != s] + [c[2:]])
                assert got.pop((c[0], c[1], s[1])) == pytest.approx(want, abs=1e-6)
    assert not got


def test_ends_where_no_exchange_helps(spark):
    both = [instance("a", 60, 3, 25, 5), instance("b", 30, 2, 9, 6)]
    frames = [spark.createDataFrame([r for x in both for r in x[i]], kind) for i, kind in enumerate((POINT, SITE, CANDIDATE))]
    sites, made = interchange.interchange(*frames)
    assert made > 0
    found = {}
    for r in sites.collect():
        found.setdefault(r["dataset"], []).append((r["lat"], r["lon"]))
    for points, before, candidates in both:
        at = found[points[0][0]]
        assert len(at) == len(before)
        now = objective(points, at)
        assert now < objective(points, [s[3:] for s in before])
        for i in range(len(at)):
            for c in candidates:
                assert objective(points, at[:i] + at[i + 1 :] + [c[2:]]) >= now * (1 - 1e-8)


def test_place_is_never_above_the_driver_loop(spark):
    rng = random.Random(8)
    rows = [("d", i, f"P{i}", 12 + rng.gauss(0, 0.05) + i % 5 / 3, 77 + rng.gauss(0, 0.05) + i % 3 / 2, rng.randint(1, 9)) for i in range(400)]
    pts = spark.createDataFrame(rows, POINT).cache()
    sites, total = interchange.place(pts, 5)
    loop = spark.createDataFrame([("d", i, f"W{i}", a, b) for i, (a, b) in enumerate(solve.solve_large(pts, 5))], SITE)
    assert total <= cost.weighted_cost(assign.nearest(pts, loop)).first()["cost"] * (1 + 1e-9)
    assert sites.count() == 5
    assert total == pytest.approx(objective(rows, [(r["lat"], r["lon"]) for r in sites.collect()]))


def test_candidates_are_the_heaviest_of_their_cells(spark):
    pts = spark.createDataFrame([("d", i, f"P{i}", i / 10, i / 10, i % 7) for i in range(100)], POINT)
    got = interchange.spread_candidates(pts, 16).orderBy("cand_ord").collect()
    assert [r["cand_ord"] for r in got] == [0, 1, 2, 3]
    assert all(round(r["lat"] * 10) % 7 == 6 for r in got)


def test_limits_raise(spark, monkeypatch):
    monkeypatch.setattr(interchange, "MOST_CANDIDATES", 3)
    frames = [spark.createDataFrame(r, kind) for r, kind in zip(instance("a", 5, 2, 4, 1), (POINT, SITE, CANDIDATE), strict=True)]
    with pytest.raises(Exception, match="more than 3 candidates"):
        interchange.swap_profits(*frames).collect()


def test_rounds_that_do_not_rest_are_told(spark):
    pts = spark.createDataFrame([("d", i, f"P{i}", i / 50, (i * 7 % 50) / 50, 1) for i in range(50)], POINT)
    with pytest.warns(UserWarning, match="still moved"):
        solve.solve_large(pts, 3, rounds=1)
    assert pts.agg(F.count(F.lit(1))).first()[0] == 50


def test_any_number_of_candidates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(interchange, "MOST_CANDIDATES", 3)
    monkeypatch.setattr(interchange, "BLOCK", 4)
    monkeypatch.setattr(interchange, "PAIRS", 50)
    points, sites, candidates = instance("a", 40, 3, 21, 4)
    points += [(d, 100 + i, f"Q{i}", a, b, 3) for i, (d, _, _, a, b, _) in enumerate(points[:10])]  # two points at a place
    candidates += [(d, 100 + i, a, b) for d, i, a, b in candidates]  # and two candidates
    frames = [spark.createDataFrame(r, kind) for r, kind in zip((points, sites, candidates), (POINT, SITE, CANDIDATE), strict=True)]
    for sent in (1 << 20, 5):
        monkeypatch.setattr(interchange, "MOST_SENT", sent)
        got, made = interchange.interchange(*frames)
        at, turns = [s[3:] for s in sites], 0
        while True:
            now = objective(points, at)
            best = min((round(objective(points, at[:i] + at[i + 1 :] + [c[2:]]) - now, 9), c[1], i, c[2:]) for i in range(3) for c in candidates)
            if best[0] >= -1e-9 * now:
                break
            at[best[2]], turns = best[3], turns + 1
        assert [(r["lat"], r["lon"]) for r in got.orderBy("wh_ord").collect()] == at
        assert made == turns > 0
