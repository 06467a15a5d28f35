"""Capacitated assignment by auction against every assignment of small instances."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from depotry.operators import auction
from depotry.schema import RUPEE
from test_assign import POINT, SITE, km


def best_of_all(points, sites, capacity):
    way = [[p[5] * km(p[3], p[4], s[4], s[5]) for s in sites] for p in points]
    best = None
    for pick in itertools.product(range(len(sites)), repeat=len(points)):
        load = [0] * len(sites)
        for p, i in zip(points, pick, strict=True):
            load[i] += p[5]
        if max(load) <= capacity:
            total = sum(w[i] for w, i in zip(way, pick, strict=True))
            best = total if best is None else min(best, total)
    return best


def instance(d, n, k, seed):
    rng = random.Random(seed)
    points = [(d, i, f"P{i}", rng.uniform(12.8, 13.2), rng.uniform(77.4, 77.8), rng.randint(1, 9)) for i in range(n)]
    return points, [(d, k, i, f"W{i}", rng.uniform(12.8, 13.2), rng.uniform(77.4, 77.8)) for i in range(k)]


def test_near_the_best_of_all_assignments(spark):
    made = {d: instance(d, 8, 3, s) for d, s in (("a", 1), ("b", 2))}
    capacity = {d: -(-sum(p[5] for p in ps) * 12 // 30) for d, (ps, _) in made.items()}
    room = max(capacity.values())
    frames = [spark.createDataFrame([r for x in made.values() for r in x[i]], kind) for i, kind in enumerate((POINT, SITE))]
    rows, told = auction.auction(*frames, room, eps=(2.0, 0.2), profile=RUPEE)
    told = {r["dataset"]: r for r in told.collect()}
    assert rows.count() == 16
    for d, (points, sites) in made.items():
        best = best_of_all(points, sites, room)
        assert told[d]["overload"] == 0
        assert told[d]["bound"] <= best + 1e-6
        assert best - 1e-6 <= told[d]["cost"] <= best * 1.02


def test_demand_that_does_not_fit_is_told(spark):
    points, sites = instance("a", 6, 2, 9)
    frames = [spark.createDataFrame(x, kind) for x, kind in ((points, POINT), (sites, SITE))]
    total = sum(p[5] for p in points)
    rows, told = auction.auction(*frames, total // 3, eps=(5.0,), rounds=3, profile=RUPEE)
    assert rows.agg(F.sum("orders")).first()[0] == total
    assert told.first()["overload"] > 0
    with pytest.raises(ValueError, match="positive"):
        auction.auction(*frames, 0)


def test_one_site_and_ample_room(spark):
    points, sites = instance("a", 6, 3, 5)
    frames = [spark.createDataFrame(x, kind) for x, kind in ((points, POINT), (sites, SITE))]
    _, told = auction.auction(*frames, 1000, eps=(1.0,), profile=RUPEE)
    r = told.first()
    assert r["cost"] == pytest.approx(sum(p[5] * min(km(p[3], p[4], s[4], s[5]) for s in sites) for p in points))
    assert r["gap_pct"] == pytest.approx(0, abs=1e-9)
    one, told = auction.auction(frames[0], spark.createDataFrame(sites[:1], SITE), 1000, eps=(1.0,), profile=RUPEE)
    assert {r["wh_id"] for r in one.collect()} == {"W0"}
    assert told.first()["overload"] == 0
