"""Grouped geometric medians against the dense solver and against the rule that decides them."""

import random

import numpy as np
import pytest

from depotry.operators import cost, medians, solve
from test_assign import POINT


def groups():
    rng = random.Random(3)
    rows = []
    for g in range(4):
        rows += [(f"g{g}", i, f"P{i}", 12 + rng.random() / 5, 77 + rng.random() / 5, rng.randint(0, 9)) for i in range(5 + 15 * g)]
    rows += [("heavy", i, "x", 12.0 + i / 10, 77.0 + (i * i % 7) / 10, 100 if i == 3 else 1) for i in range(7)]
    rows += [("start", i, "x", a, b, 1) for i, (a, b) in enumerate([(12.9, 77.6), (12.9, 77.6), (13.0, 77.6), (13.0, 77.6), (13.0, 77.7)])]
    rows += [("one", 0, "x", 12.5, 77.5, 4), ("same", 0, "x", 12.5, 77.5, 4), ("same", 1, "x", 12.5, 77.5, 2)]
    rows += [("none", 0, "x", 12.0, 77.0, 0), ("none", 1, "x", 13.0, 78.0, 0)]
    return rows


def test_equal_the_dense_solver(spark):
    rows = groups()
    got = {r["dataset"]: r for r in medians.geometric_medians(spark.createDataFrame(rows, POINT)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for d, r in got.items():
        own = np.array([(x[3], x[4], x[5]) for x in rows if x[0] == d], float)
        metric, w = solve.Metric(own[:, 0], own[:, 1]), own[:, 2]
        at = solve.medians(metric, w[:, None], rounds=5000)[0]
        cost = [float((metric.to(np.array(x)) * w).sum()) for x in ((r["lat"], r["lon"]), at)]
        assert r["rest"]
        assert cost[0] <= cost[1] * (1 + 1e-9) + 1e-9
        for step in (1e-4, 1e-6):
            for a, b in ((step, 0), (-step, 0), (0, step), (0, -step)):
                assert cost[0] <= float((metric.to(np.array((r["lat"] + a, r["lon"] + b))) * w).sum()) * (1 + 1e-10) + 1e-7
    assert (got["heavy"]["lat"], got["heavy"]["lon"]) == pytest.approx((12.3, 77.2), abs=1e-9)
    assert (got["none"]["lat"], got["none"]["lon"]) == (12.5, 77.5)


def test_a_group_that_does_not_rest_is_told(spark):
    rows = [r for r in groups() if r[0] == "g3"]
    assert not medians.geometric_medians(spark.createDataFrame(rows, POINT), rounds=1, tol_km=0.0).first()["rest"]


def test_the_first_of_equally_far_points(spark):
    pts = spark.createDataFrame([("d", i, x, 12.0, 77.0 + s, 1) for i, (x, s) in enumerate([("B", 0.5), ("A", -0.5), ("C", 0.0)])], POINT)
    assert cost.farthest(pts).first()["id"] == "A"
