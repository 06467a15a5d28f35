"""Capacitated plans: repair an overloaded plan, improve it, move its sites, keep the best.

Candidates are rows: a ladder of stricter targets times three rules for choosing repairs times
two limits for the improvement. Each is worked out in its own task and a small aggregate keeps
the best plan that fits, or else the least overloaded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotry.operators.solve import Metric, medians
from depotry.schema import ORDER_KM, Profile

RULES = ("cheapest", "resolve_first", "per_order")
ROUNDS = 10
RESULT = "dataset string, k int, target long, rule string, limit long, cost double, overload long, labels array<int>, centres array<struct<lat:double,lon:double>>, loads array<long>"


def ladder(orders: np.ndarray, k: int, capacity: int) -> list[int]:
    """Targets from the capacity down to what the largest point and an even split allow; coarser for more points."""
    floor = max(int(orders.max()), -(-int(orders.sum()) // k))
    steps = 24 if len(orders) <= 60 else 8 if len(orders) <= 200 else 3
    return sorted({capacity - (capacity - floor) * t // steps for t in range(steps + 1)}, reverse=True) if capacity > floor else [capacity]


def repair(orders: np.ndarray, d: np.ndarray, target: int, rule: str) -> np.ndarray:
    """Labels after moving points off overloaded sites, by ``rule``, until all fit; where no move fits, exchanges that lower the overload."""
    n, k = d.shape
    labels = d.argmin(1)
    for _ in range(4 * n * k):
        loads = np.bincount(labels, orders, k)
        over = loads > target
        rises = orders[:, None] * (d - d[np.arange(n), labels][:, None])
        legal = over[labels][:, None] & (loads[None, :] + orders[:, None] <= target)
        legal[np.arange(n), labels] = False
        if not over.any():
            break
        if not legal.any():
            if (pair := _exchange(orders, d, labels, loads, target)) is None:
                break
            labels[pair[0]], labels[pair[1]] = labels[pair[1]], labels[pair[0]]
            continue
        if rule == "resolve_first":
            enough = legal & (orders >= loads[labels] - target)[:, None]
            legal = enough if enough.any() else legal
        score = rises / np.maximum(orders, 1)[:, None] if rule == "per_order" else rises
        i, j = np.unravel_index(np.where(legal, score, np.inf).argmin(), d.shape)
        labels[i] = j
    return labels


def _exchange(orders: np.ndarray, d: np.ndarray, labels: np.ndarray, loads: np.ndarray, target: int) -> tuple[int, int] | None:
    """The cheapest exchange of two points among those that lower the overload most."""
    own = d[np.arange(len(labels)), labels]
    there = loads[labels][:, None] - orders[:, None] + orders[None, :]
    before = np.maximum(loads[labels] - target, 0)
    gain = before[:, None] + before[None, :] - np.maximum(there - target, 0) - np.maximum(there.T - target, 0)
    gain = np.where(labels[:, None] != labels[None, :], gain, 0)
    if gain.max() <= 0:
        return None
    rise = orders[:, None] * (d[:, labels] - own[:, None])
    i, j = np.unravel_index(np.where(gain == gain.max(), rise + rise.T, np.inf).argmin(), gain.shape)
    return int(i), int(j)


def improve(orders: np.ndarray, d: np.ndarray, labels: np.ndarray, limit: int) -> np.ndarray:
    """Labels that no single move and no exchange of two points makes cheaper within ``limit``; the best change first."""
    n, k = d.shape
    labels = labels.copy()
    while True:
        loads, own = np.bincount(labels, orders, k), d[np.arange(n), labels]
        move = orders[:, None] * (d - own[:, None])
        fits = loads[None, :] + orders[:, None] <= limit
        fits[np.arange(n), labels] = False
        move = np.where(fits, move, np.inf)
        there = d[:, labels]  # i at the site of j
        swap = orders[:, None] * (there - own[:, None])
        swap = swap + swap.T
        after = loads[labels][:, None] - orders[:, None] + orders[None, :]
        swap[(after > limit) | (after.T > limit) | (labels[:, None] == labels[None, :])] = np.inf
        if min(move.min(), swap.min()) >= -1e-9:
            return labels
        if move.min() <= swap.min():
            i, j = np.unravel_index(move.argmin(), move.shape)
            labels[i] = j
        else:
            i, j = np.unravel_index(swap.argmin(), swap.shape)
            labels[i], labels[j] = labels[j], labels[i]


def search(points: DataFrame, sites: DataFrame, capacity: int, profile: Profile = ORDER_KM) -> DataFrame:
    """All candidates, one row each."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    # A data set has few targets; they come from its sums alone.
    sizes = points.groupBy("dataset").agg(F.max("orders").alias("top"), F.sum("orders").alias("sum"), F.count(F.lit(1)).alias("n"))
    ks = sites.groupBy("dataset", "k").agg(F.array_sort(F.collect_list(F.struct("wh_ord", "lat", "lon"))).alias("centres"))
    floor = F.greatest(F.col("top"), F.ceil(F.col("sum") / F.col("k"))).cast("long")
    steps = F.when(F.col("n") <= 60, 24).when(F.col("n") <= 200, 8).otherwise(3)
    rungs = F.array_distinct(F.transform(F.sequence(F.lit(0), steps), lambda t: F.lit(capacity) - F.floor((F.lit(capacity) - floor) * t / steps)))
    jobs = ks.join(sizes, "dataset").withColumn("target", F.explode(F.when(floor < capacity, rungs).otherwise(F.array(F.lit(capacity).cast("long"))))).withColumn("rule", F.explode(F.array(*map(F.lit, RULES))))
    rows = points.select("dataset", "ord", "id", "lat", "lon", "orders").join(jobs.select("dataset", "k", "centres", "target", "rule"), "dataset")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        start = np.array([(c["lat"], c["lon"]) for c in pdf["centres"].iat[0]])
        orders, metric = pdf["orders"].to_numpy(), Metric(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), profile)
        first, out = repair(orders, metric.to(start), int(key[2]), key[3]), []
        for limit in {capacity, int(key[2])}:
            at, labels = start.copy(), improve(orders, metric.to(start), first, limit)
            for _ in range(ROUNDS):
                held = orders[:, None] * (labels[:, None] == np.arange(len(at)))
                new = medians(metric, held)
                at = np.where((held.sum(0) > 0)[:, None], new, at)
                again = improve(orders, metric.to(at), labels, capacity)
                if (again == labels).all():
                    break
                labels = again
            loads = np.bincount(labels, orders, len(at)).astype(int)
            by_ord = np.empty(len(pdf), int)
            by_ord[pdf["ord"].rank().astype(int).to_numpy() - 1] = labels
            cost = float((orders * metric.to(at)[np.arange(len(orders)), labels]).sum())
            out.append((key[0], key[1], key[2], key[3], limit, cost, max(0, int(loads.max()) - capacity), by_ord.tolist(), [{"lat": a, "lon": b} for a, b in at], loads.tolist()))
        return pd.DataFrame(out, columns=["dataset", "k", "target", "rule", "limit", "cost", "overload", "labels", "centres", "loads"])

    return rows.groupBy("dataset", "k", "target", "rule").applyInPandas(run, RESULT)


def best_plan(candidates: DataFrame) -> DataFrame:
    """The cheapest candidate that fits, else the least overloaded; over_capacity lists the sites that still overflow."""
    distinct = candidates.dropDuplicates(["dataset", "k", "labels"])
    order = Window.partitionBy("dataset", "k").orderBy("overload", F.round("cost", 9), "target", "rule")
    return distinct.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
