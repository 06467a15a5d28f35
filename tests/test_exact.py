"""Best subsets by number: unranking, parts of points, ties, several data sets, against enumeration."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from depotry.operators import exact
from test_assign import POINT, km


def test_numbers_name_each_subset_once(spark):
    for n, k in ((7, 3), (9, 2), (6, 6), (12, 5), (5, 1), (30, 29), (70, 68)):
        total = math.comb(n, k)
        got = spark.range(total).select(exact.unranked(F.col("id"), k, n).alias("s")).collect()
        assert {tuple(r["s"]) for r in got} == set(itertools.combinations(range(n), k))
        assert len(got) == total
    # A longer table gives the same subsets: data sets of any size share one.
    assert [r["s"] for r in spark.range(20).select(exact.unranked(F.col("id"), 3, 6).alias("s")).collect()] == [r["s"] for r in spark.range(20).select(exact.unranked(F.col("id"), 3, 50).alias("s")).collect()]


def brute(rows, spots, k):
    """(cost, subset) of every subset of ``spots`` (ord, lat, lon)."""
    return [(sum(r[5] * min(km(r[3], r[4], a, b) for _, a, b in c) for r in rows), [o for o, _, _ in c]) for c in itertools.combinations(sorted(spots), k)]


def made(name, n, rng):
    ords = rng.sample(range(1000), n)
    return [(name, o, f"P{o}", 12.8 + rng.random() / 3, 77.4 + rng.random() / 3, rng.randint(0, 20)) for o in ords]


@pytest.mark.parametrize("width", [256, 4])
def test_best_subsets_equal_enumeration(spark, monkeypatch, width):
    monkeypatch.setattr(exact, "POINTS_A_PART", width)
    rng = random.Random(11)
    sets = {"a": made("a", 11, rng), "b": made("b", 6, rng), "c": made("c", 2, rng)}
    pts = spark.createDataFrame([r for v in sets.values() for r in v], POINT)
    for k in (1, 2, 3):
        got = {r["dataset"]: r for r in exact.pmedian(pts, k).collect()}
        assert set(got) == {d for d, v in sets.items() if len(v) >= k}
        for d, r in got.items():
            every = brute(sets[d], [(x[1], x[3], x[4]) for x in sets[d]], k)
            cost, chosen = min(every)
            assert r["objective"] == pytest.approx(cost, rel=1e-9)
            assert r["sites"] == chosen
            assert r["evaluated"] == len(every)
        assert {(r["dataset"], *r[1:]) for r in exact.subsets(pts, k).collect()} == {(d, *c) for d, v in sets.items() for c in itertools.combinations(sorted(x[1] for x in v), k)}


def test_lattice_equals_enumeration(spark, monkeypatch):
    monkeypatch.setattr(exact, "POINTS_A_PART", 5)
    rows = made("a", 17, random.Random(3))
    lat, lon = [r[3] for r in rows], [r[4] for r in rows]
    spots = [(i, min(lat) + (max(lat) - min(lat)) * (i // 4) / 3, min(lon) + (max(lon) - min(lon)) * (i % 4) / 3) for i in range(16)]
    got = exact.lattice(spark.createDataFrame(rows, POINT), 2, 4).first()
    assert (got["objective"], got["evaluated"]) == (pytest.approx(min(brute(rows, spots, 2))[0], rel=1e-9), 120)


def test_ties_repeats_and_empty(spark):
    same = [("a", o, f"P{o}", 12.9, 77.5, 3) for o in (5, 2, 9)]
    got = exact.pmedian(spark.createDataFrame(same, POINT), 2).first()
    assert (got["sites"], got["objective"], got["evaluated"]) == ([2, 5], 0.0, 3)
    none = spark.createDataFrame([], POINT)
    assert exact.pmedian(none, 2).count() == exact.subsets(none, 2).count() == exact.lattice(none, 1, 3).count() == 0


def test_no_join_of_subsets_with_points(spark):
    pts = spark.createDataFrame(made("a", 12, random.Random(1)), POINT)
    plan = exact.pmedian(pts, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Initial Plan")[0].split("HashAggregate")[-1]
    assert "NestedLoop" not in plan and "Cartesian" not in plan
