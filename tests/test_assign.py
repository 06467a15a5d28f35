"""Nearest of many sites and the greedy assignment against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from depotry.operators import assign, interchange, scan

POINT = "dataset string, ord long, id string, lat double, lon double, orders long"
SITE = "dataset string, k int, wh_ord long, wh_id string, lat double, lon double"


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def spread(kind, rng, n):
    if kind == "even":
        return [(rng.uniform(10, 12), rng.uniform(70, 72)) for _ in range(n)]
    if kind == "clusters":
        centres = [(12.0, 77.0), (12.1, 77.1), (50.0, 8.0)]
        return [(a + rng.gauss(0, 0.02), b + rng.gauss(0, 0.02)) for a, b in (rng.choice(centres) for _ in range(n))]
    if kind == "world":
        return [(rng.choice((rng.uniform(-90, 90), 89.9, -89.9)), rng.choice((rng.uniform(-180, 180), 179.99, -179.99))) for _ in range(n)]
    return [(5.0, 5.0)] * n  # one place


@pytest.mark.parametrize(("kind", "n_sites", "n_points"), [("even", 300, 200), ("clusters", 300, 150), ("world", 200, 150), ("one", 50, 40), ("even", 1, 5)])
def test_nearest_of_many_equals_brute_force(spark, kind, n_sites, n_points):
    rng = random.Random(n_sites)
    sites = [("d", 0, i, f"S{i}", a, b) for i, (a, b) in enumerate(spread(kind, rng, n_sites))]
    sites += [("d", 0, n_sites + i, f"T{i}", *sites[i][4:]) for i in range(min(5, n_sites))]  # ties: the first site wins
    places = spread(kind, rng, n_points) + spread("world", rng, 20) + [s[4:] for s in sites[:5]]
    points = [("d", i, f"P{i}", a, b, 1) for i, (a, b) in enumerate(places)]
    got = {r["ord"]: r for r in assign.nearest_of_many(spark.createDataFrame(points, POINT), spark.createDataFrame(sites, SITE)).collect()}
    assert len(got) == len(points)
    for _, i, _, a, b, _ in points:
        best = min((km(a, b, s[4], s[5]), s[2]) for s in sites)
        assert math.isclose(got[i]["dist_km"], best[0], rel_tol=1e-9, abs_tol=1e-6)
        assert got[i]["wh_ord"] == best[1] or math.isclose(km(a, b, *sites[got[i]["wh_ord"]][4:]), best[0], rel_tol=1e-9, abs_tol=1e-6)


def turn_by_turn(points, sites, capacity):
    """Each point in turn, largest orders first: {(dataset, ord): wh_id}."""
    out = {}
    for d in {p[0] for p in points}:
        own = [s for s in sites if s[0] == d]
        room = {s[3]: capacity for s in own}
        for p in sorted((p for p in points if p[0] == d), key=lambda p: (-p[5], p[1])):
            ways = sorted((km(p[3], p[4], s[4], s[5]), s[2], s[3]) for s in own)
            pick = next((w for w in ways if room[w[2]] >= p[5]), ways[0])[2]
            room[pick] -= p[5]
            out[d, p[1]] = pick
    return out


@pytest.mark.parametrize(("n", "n_sites", "capacity", "width", "first"), [(60, 5, 150, 1 << 16, 8), (60, 6, 170, 16, 1), (30, 3, 20, 5, 2)])
def test_greedy_capacity_equals_brute_force(spark, monkeypatch, n, n_sites, capacity, width, first):
    monkeypatch.setattr(scan, "WIDTH", width)
    monkeypatch.setattr(assign, "WAYS_FIRST", first)
    rng = random.Random(n + n_sites)
    points = [(d, i, f"P{i}", rng.uniform(0, 1), rng.uniform(0, 1), rng.choice((0, 7, rng.randint(0, 30)))) for d in ("a", "b") for i in range(n)]
    sites = [(d, 5, i, f"W{i}", rng.uniform(0, 1), rng.uniform(0, 1)) for d in ("a", "b") for i in range(n_sites)]
    got = assign.greedy_capacity(spark.createDataFrame(points, POINT), spark.createDataFrame(sites, SITE), capacity).collect()
    assert {(r["dataset"], r["ord"]): r["wh_id"] for r in got} == turn_by_turn(points, sites, capacity)
    assert len(got) == 2 * n


def test_greedy_capacity_without_limit_or_points(spark):
    points = [("a", i, f"P{i}", 0.0, float(i), 1) for i in range(4)]
    sites = spark.createDataFrame([("a", 1, i, f"W{i}", 0.0, 3.0 * i) for i in range(2)], SITE)
    assert [r["wh_id"] for r in assign.greedy_capacity(spark.createDataFrame(points, POINT), sites, None).orderBy("ord").collect()] == ["W0", "W0", "W1", "W1"]
    assert assign.greedy_capacity(spark.createDataFrame([], POINT), sites, 3).collect() == []


def test_greedy_capacity_refuses_too_many_sites(spark, monkeypatch):
    monkeypatch.setattr(assign, "MOST_RANKED", 3)
    points = spark.createDataFrame([("a", 0, "P", 0.0, 0.0, 1)], POINT)
    with pytest.raises(Exception, match="too many sites"):
        assign.greedy_capacity(points, spark.createDataFrame([("a", 1, i, f"W{i}", 0.0, 0.0) for i in range(4)], SITE), 10).collect()


def test_prefix_sums_cut_groups(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.randint(-5, 9)) for g, n in (("a", 400), ("b", 3), ("c", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, i long, v long").repartition(4)
    for got in (scan.prefix_sums(frame, ["g"], ["i"], {"s": F.col("v")}), scan.bucketed_before(frame, ["g"], "i", "v", 400, "s", 16).withColumn("s", F.col("s") + F.col("v"))):
        assert {(r["g"], r["i"]): r["s"] for r in got.collect()} == {(g, i): sum(v for h, j, v in rows if h == g and j <= i) for g, i, _ in rows}


def test_greedy_of_many_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(assign, "MOST_RANKED", 3)
    monkeypatch.setattr(assign, "WAYS_FIRST", 2)
    monkeypatch.setattr(interchange, "BLOCK", 2)
    rng = random.Random(3)
    spots = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(12)]  # several points and sites at a place
    points = [("a", i, f"P{i}", *rng.choice(spots), rng.choice((0, 7, rng.randint(0, 30)))) for i in range(50)]
    sites = [("a", 5, i, f"W{i}", *spots[i % 5]) for i in range(9)]
    got = assign.greedy_of_many(spark.createDataFrame(points, POINT), spark.createDataFrame(sites, SITE), 70).collect()
    assert {(r["dataset"], r["ord"]): r["wh_id"] for r in got} == turn_by_turn(points, sites, 70)
    assert len(got) == 50


def test_sites_of_a_place_fill_in_one_round(spark, monkeypatch):
    """Rounds follow the places that push points on, not the sites of a place; parts of a group change nothing."""
    written, cut = [], assign.cut
    monkeypatch.setattr(assign, "cut", lambda df: written.append(1) or cut(df))
    monkeypatch.setattr(assign, "PART", 7)
    rng = random.Random(8)
    points = [("a", i, f"P{i}", 12.8, 77.4, rng.choice((0, 1, 2, 3))) for i in range(90)] + [("a", 90 + i, f"Q{i}", 12.9, 77.4, 2) for i in range(9)]
    sites = [("a", 5, i, f"W{i}", 12.8, 77.4) for i in range(30)] + [("a", 5, 30, "V", 12.9, 77.4), ("a", 5, 31, "X", 13.0, 77.4)]
    got = assign.greedy_of_many(spark.createDataFrame(points, POINT), spark.createDataFrame(sites, SITE), 6).collect()
    assert {(r["dataset"], r["ord"]): r["wh_id"] for r in got} == turn_by_turn(points, sites, 6)
    assert len(written) < 30


def test_places_that_tie_and_full_ones(spark):
    """Sites of two places as far away are taken in their order; without room the nearest takes all the same; what sites hold before counts."""
    points = [("a", i, f"P{i}", 0.0, 0.0, (5, 3, 3, 2, 2, 1, 0)[i % 7]) for i in range(35)]
    sites = [("a", 5, i, f"W{i}", 0.0, (-1.0, 1.0, 2.0)[i % 3]) for i in range(7)]
    got = assign.greedy_of_many(spark.createDataFrame(points, POINT), spark.createDataFrame(sites, SITE), 9).collect()
    assert {(r["dataset"], r["ord"]): r["wh_id"] for r in got} == turn_by_turn(points, sites, 9)
    held = spark.createDataFrame([("a", 0, 9)], "dataset string, site long, taken long")
    first = assign.greedy_of_many(spark.createDataFrame(points[:1], POINT), spark.createDataFrame(sites, SITE), 9, taken=held).collect()
    assert [r["wh_id"] for r in first] == ["W1"]
