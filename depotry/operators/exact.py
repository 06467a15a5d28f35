"""Exact answers: best subset of points, certificate of a plan, best plan anywhere for few points."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotry.functions.geo import haversine
from depotry.operators.solve import Metric
from depotry.schema import RUPEE, Profile

#: Subsets that exact enumeration takes on; one limit for warm starts and proofs.
MOST_SUBSETS = 2_000_000
MOST_CONTINUOUS = 10
#: A part of a data set has about this many points, fewer where that many candidates would make more distances.
POINTS_A_PART, DISTANCES_A_PART = 256, 1 << 19
#: Candidates of all data sets that are broadcast, at 24 bytes each; more are joined by shuffle.
MOST_BROADCAST = 100_000


def distance_matrix(points: DataFrame, profile: Profile = RUPEE) -> DataFrame:
    """(dataset, i, j, km) over the points of each data set."""
    a = points.select("dataset", F.col("ord").alias("i"), F.col("lat").alias("_a"), F.col("lon").alias("_b"))
    b = points.select("dataset", F.col("ord").alias("j"), F.col("lat").alias("_c"), F.col("lon").alias("_d"))
    return a.join(b, "dataset").select("dataset", "i", "j", haversine(F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d"), profile).alias("km"))


def unranked(number: Column, k: int, most: int) -> Column:
    """array<int>: the ``k`` positions below ``most``, ascending, of subset ``number`` in the combinatorial number system.

    Subset c1 < .. < ck has the number C(c1, 1) + .. + C(ck, k). From k down, a position is the largest
    whose binomial is within what is left, found by halving. Numbers are those of at most ``MOST_SUBSETS``.
    """
    if k == 1:
        return F.array(number.cast("int"))
    table = _numbers(min(math.comb(c, i), MOST_SUBSETS + 1) for i in range(1, k + 1) for c in range(most))
    steps = F.sequence(F.lit(1), F.lit(most.bit_length()))

    def take(state: Column, i: Column) -> Column:
        row = (i - 1) * most

        def halve(h: Column, _: Column) -> Column:
            middle = F.floor((h["a"] + h["b"]) / 2).cast("int")
            within = (h["a"] < h["b"]) & (F.get(table, row + middle) <= state["left"])
            return F.when(within, F.struct((middle + 1).alias("a"), h["b"].alias("b"))).otherwise(F.struct(h["a"].alias("a"), middle.alias("b")))

        at = F.aggregate(steps, F.struct(F.lit(0).alias("a"), F.lit(most).alias("b")), halve, lambda h: h["a"] - 1)
        found = F.array(F.struct(state["left"].alias("left"), state["sites"].alias("sites"), at.alias("at")))
        return F.transform(found, lambda f: F.struct((f["left"] - F.get(table, row + f["at"])).alias("left"), F.concat(F.array(f["at"]), f["sites"]).alias("sites")))[0]

    start = F.struct(number.cast("long").alias("left"), F.expr("CAST(array() AS array<int>)").alias("sites"))
    return F.aggregate(F.sequence(F.lit(k), F.lit(1), F.lit(-1)), start, take, lambda state: state["sites"])


def _numbers(values: Iterable[int]) -> Column:
    """A constant array of whole numbers."""
    text = ",".join(map(str, values))
    return F.split(F.lit(text), ",").cast("array<bigint>") if text else F.expr("CAST(array() AS array<bigint>)")


def _counted(candidates: DataFrame, k: int) -> tuple[DataFrame, int, int]:
    """(dataset, cands, total) with the candidates by ``ord`` and the number of their subsets of ``k``; most candidates; data sets."""
    sizes = candidates.groupBy("dataset").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count(F.lit(1))).first()
    most, sets = sizes
    if math.comb(most, k) > MOST_SUBSETS:
        raise ValueError(f"C({most}, {k}) subsets are more than {MOST_SUBSETS}")
    held = candidates.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("ord", "lat", "lon"))).alias("cands"))
    total = F.size("cands").cast("long") if k == 1 else F.get(_numbers(math.comb(c, k) for c in range(most + 1)), F.size("cands"))
    return held.withColumn("total", total).where("total > 0"), most, sets


def subsets(points: DataFrame, k: int) -> DataFrame:
    """(dataset, s1 < .. < sk): the subsets of each data set, from even ranges of their numbers."""
    held, most, _ = _counted(points.select("dataset", "ord", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")), k)
    spread = _ranges(held.select("dataset", F.col("cands.ord").alias("ords"), "total"), 1)
    each = spread.withColumn("_n", F.explode(F.sequence("lo", "hi"))).select("dataset", "ords", unranked(F.col("_n"), k, most).alias("_s"))
    return each.select("dataset", *(F.get("ords", F.col("_s")[i]).alias(f"s{i + 1}") for i in range(k)))


def _ranges(rows: DataFrame, pieces: int) -> DataFrame:
    """``rows`` once for each range ``lo``..``hi`` of the numbers below ``total``, dealt out evenly.

    ``pieces`` rows or more are there for each data set, so that ranges are only as many as keep all cores at work.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    step = F.ceil(F.col("total") / F.lit(max(1, math.ceil(tasks / max(1, pieces))))).cast("long")
    cut_ = rows.withColumn("_step", step).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.col("_step"))))
    return cut_.withColumn("hi", F.least(F.col("lo") + F.col("_step"), F.col("total")) - 1).drop("_step").repartition(tasks)


def _best_subsets(points: DataFrame, candidates: DataFrame, k: int, weight: str, profile: Profile, places: int | None) -> DataFrame:
    """(dataset, sites, objective, evaluated): the best ``k`` of ``candidates`` for ``points``, the first of equals (to ``places``).

    A row is a part of the points and a range of subsets: it works out their distances once, then the
    cost of each subset for its points. No subset is joined with points, and costs are shuffled only
    where a data set has several parts of points.
    """
    held, most, sets = _counted(candidates, k)
    width = max(1, min(POINTS_A_PART, DISTANCES_A_PART // max(1, most)))
    largest = points.groupBy("dataset").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, math.ceil(largest / width))
    some = points.groupBy("dataset", F.pmod(F.xxhash64("ord"), F.lit(parts)).alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col("ord"), F.col("lat"), F.col("lon"), F.col(weight).cast("double").alias("w")))).alias("pts"))
    few = sets * most <= MOST_BROADCAST
    rows = _ranges(some.join(F.broadcast(held) if few else held, "dataset"), parts * sets)
    km = F.flatten(F.transform("cands", lambda c: F.transform("pts", lambda q: haversine(q["lat"], q["lon"], c["lat"], c["lon"], profile))))

    def costs(near: Column) -> Column:
        count = F.size("pts")

        def of(chosen: Column) -> Column:
            def at(i: int, q: Column) -> Column:
                return F.get(near, chosen[i] * count + q)

            return F.aggregate(F.sequence(F.lit(0), count - 1), F.lit(0.0), lambda sum_, q: sum_ + F.get(F.col("pts.w"), q) * (F.least(*(at(i, q) for i in range(k))) if k > 1 else at(0, q)))

        return F.transform(F.sequence("lo", "hi"), lambda n: F.transform(F.array(unranked(n, k, most)), of)[0])

    # One-element arrays carry distances and subsets into one lambda each, so that they are made once.
    told = rows.select("dataset", "lo", F.transform(F.array(km), costs)[0].alias("costs"))
    each = told.select("dataset", "lo", F.posexplode("costs").alias("at", "objective")).select("dataset", (F.col("lo") + F.col("at")).alias("number"), "objective")
    totals = each if parts == 1 else each.groupBy("dataset", "number").agg(F.sum("objective").alias("objective"))
    value = F.col("objective") if places is None else F.round("objective", places)
    # Positions are in the order of ``ord``, so the first subset of equals is that of the first positions.
    best = totals.groupBy("dataset").agg(F.min(F.struct(value.alias("r"), unranked(F.col("number"), k, most).alias("at"), "objective")).alias("b"), F.count(F.lit(1)).alias("evaluated"))
    named = best.join(held.select("dataset", F.col("cands.ord").alias("_ords")), "dataset")
    return named.select("dataset", F.transform("b.at", lambda i: F.get("_ords", i)).alias("sites"), "b.objective", "evaluated")


def pmedian(points: DataFrame, k: int, weight: str = "orders", profile: Profile = RUPEE) -> DataFrame:
    """(dataset, sites, objective, evaluated): best k of the points themselves, the first of equals.

    The number of subsets is checked before the plan is made.
    """
    return _best_subsets(points, points.select("dataset", "ord", "lat", "lon"), k, weight, profile, 9)


def sites_of(points: DataFrame, best: DataFrame) -> DataFrame:
    """The chosen points of ``pmedian`` as sites."""
    chosen = best.select("dataset", F.posexplode("sites").alias("wh_ord", "ord"), F.size("sites").alias("k"))
    return chosen.join(points.select("dataset", "ord", "lat", "lon"), ["dataset", "ord"]).select("dataset", "k", "wh_ord", F.concat(F.lit("W"), F.col("wh_ord") + 1).alias("wh_id"), "lat", "lon")


def certificate(points: DataFrame, sites: DataFrame, weight: str = "orders", reach_km: float = 2.0, steps: int = 21, profile: Profile = RUPEE) -> DataFrame:
    """(dataset, probes, objective, best_probe, best_gain_pct, is_local_optimum).

    Every site is tried at ``steps`` x ``steps`` places of a square of ``reach_km`` around it, its
    own included, the others staying: enough for a gain of at most 1e-7 percent to pass.
    """
    others = sites.select("dataset", "wh_ord", "lat", "lon")
    grid = [(-reach_km + 2 * reach_km * i / (steps - 1)) for i in range(steps)]
    step = math.radians(1) * profile.radius_km
    offsets = F.explode(F.array(*(F.lit(g) for g in grid)))
    probes = others.withColumn("_y", offsets).withColumn("_x", offsets).select("dataset", "wh_ord", "_x", "_y", (F.col("lat") + F.col("_y") / step).alias("plat"), (F.col("lon") + F.col("_x") / (F.lit(step) * F.cos(F.radians("lat")))).alias("plon"))
    # Distance of each point to the nearest of the other sites, by the site that moves.
    fixed = points.select("dataset", "ord", F.col("lat").alias("_a"), F.col("lon").alias("_b"), F.col(weight).alias("_w")).join(others, "dataset")
    fixed = fixed.withColumn("_km", haversine(F.col("_a"), F.col("_b"), F.col("lat"), F.col("lon"), profile))
    every = fixed.groupBy("dataset", "ord", "_a", "_b", "_w").agg(F.collect_list(F.struct("wh_ord", "_km")).alias("_all"))
    # A point keeps one row for each site that may move, at most the sites of its plan.
    stay = every.withColumn("_one", F.explode("_all")).select("dataset", "ord", "_a", "_b", "_w", F.col("_one.wh_ord").alias("wh_ord"), F.col("_one._km").alias("_own"), F.array_min(F.transform(F.filter("_all", lambda s: s["wh_ord"] != F.col("_one.wh_ord")), lambda s: s["_km"])).alias("_rest"))
    moved = probes.join(stay, ["dataset", "wh_ord"]).withColumn("_km", haversine(F.col("_a"), F.col("_b"), F.col("plat"), F.col("plon"), profile))
    cost = moved.groupBy("dataset", "wh_ord", "_x", "_y").agg(F.sum(F.col("_w") * F.least("_km", "_rest")).alias("cost"))
    now = every.select("dataset", (F.col("_w") * F.array_min(F.transform("_all", lambda s: s["_km"]))).alias("c")).groupBy("dataset").agg(F.sum("c").alias("objective"))
    best = cost.groupBy("dataset").agg(F.min("cost").alias("best_probe"), F.count(F.lit(1)).alias("probes")).join(now, "dataset")
    gain = F.when(F.col("objective") > 0, 100 * (F.col("objective") - F.col("best_probe")) / F.col("objective")).otherwise(F.lit(0.0))
    return best.withColumn("best_gain_pct", gain).withColumn("is_local_optimum", gain <= 1e-7).select("dataset", "probes", "objective", "best_probe", "best_gain_pct", "is_local_optimum")


def lattice(points: DataFrame, k: int, resolution: int = 14, weight: str = "orders", profile: Profile = RUPEE) -> DataFrame:
    """``pmedian`` over the corners of a grid on the points' bounding box."""
    cells = resolution * resolution
    if math.comb(cells, k) > MOST_SUBSETS:
        raise ValueError(f"C({cells}, {k}) subsets are more than {MOST_SUBSETS}")
    box = points.groupBy("dataset").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    spot = box.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    at = spot.select("dataset", F.col("_i").cast("long").alias("ord"), (F.col("s") + (F.col("n") - F.col("s")) * F.floor(F.col("_i") / resolution) / (resolution - 1)).alias("lat"), (F.col("w") + (F.col("e") - F.col("w")) * (F.col("_i") % resolution) / (resolution - 1)).alias("lon"))
    return _best_subsets(points, at, k, weight, profile, None)


def golden_medians(metric: Metric, weights: np.ndarray, precision_km: float = 1e-3) -> np.ndarray:
    """Geometric medians (m, 2) by golden sections, one inside the other, over the points' bounding box.

    Slower than reweighted means and sharing nothing with them, so that each can check the other:
    the cost is convex in either coordinate for points this close together.
    """
    ratio, w = (math.sqrt(5) - 1) / 2, np.maximum(weights, 0)
    low, high = (np.array([f(metric.lat), f(metric.lon)]) for f in (np.min, np.max))
    turns = max(1, math.ceil(math.log(max(1e-12, precision_km / 111.2 / 50) / max(1e-9, float((high - low).max()))) / math.log(ratio)))

    def section(cost, axis: int) -> np.ndarray:  # noqa: ANN001
        a, b = np.full(w.shape[1], low[axis]), np.full(w.shape[1], high[axis])
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        fc, fd = cost(c), cost(d)
        for _ in range(turns):
            left = fc < fd
            a, b = np.where(left, a, c), np.where(left, d, b)
            new = np.where(left, b - ratio * (b - a), a + ratio * (b - a))
            f = cost(new)
            c, d, fc, fd = np.where(left, new, d), np.where(left, c, new), np.where(left, f, fd), np.where(left, fc, f)
        return (a + b) / 2

    def along(lat: np.ndarray) -> np.ndarray:
        return section(lambda lon: (metric.to(np.stack([lat, lon], axis=1)) * w).sum(0), 1)

    lat = section(lambda x: (metric.to(np.stack([x, along(x)], axis=1)) * w).sum(0), 0)
    return np.stack([lat, along(lat)], axis=1)


def continuous_optimum(points: DataFrame, ks: tuple[int, ...], weight: str = "orders", profile: Profile = RUPEE) -> DataFrame:
    """(dataset, k, objective, groups): best placement anywhere for at most ten points a data set.

    The cost of every group of points is its median's; the best split into k groups is a
    recursion over sets, each set taking the group that holds its first member.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        n = len(pdf)
        if n > MOST_CONTINUOUS:
            raise ValueError(f"{n} points are more than {MOST_CONTINUOUS}")
        member = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        w, metric = pdf[weight].to_numpy(float), Metric(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), profile)
        held = w[:, None] * member.T
        at = golden_medians(metric, held)
        spots = np.stack([metric.lat, metric.lon], axis=1)
        cost = np.minimum((metric.to(at) * held).sum(0), (metric.to(spots).T @ held).min(0))
        cost[0] = 0
        rows, full = [], (1 << n) - 1
        best, pick = [cost.copy()], [np.arange(1 << n)]
        for _ in range(2, max(ks) + 1):
            value, choice = best[-1].copy(), np.zeros(1 << n, np.int64)
            choice[:] = pick[-1]
            for mask in range(1, 1 << n):
                first, sub = mask & -mask, mask
                while sub:
                    if sub & first and cost[sub] + best[-1][mask ^ sub] < value[mask] - 1e-12:
                        value[mask], choice[mask] = cost[sub] + best[-1][mask ^ sub], sub
                    sub = (sub - 1) & mask
            best.append(value)
            pick.append(choice)
        for k in ks:
            groups, mask, level = [], full, k - 1
            while mask:
                groups.append(int(pick[level][mask]))
                mask ^= groups[-1]
                level = max(0, level - 1)
            rows.append((pdf["dataset"].iat[0], k, float(best[k - 1][full]), groups))
        return pd.DataFrame(rows, columns=["dataset", "k", "objective", "groups"])

    return points.groupBy("dataset").applyInPandas(solve, "dataset string, k int, objective double, groups array<long>")


def partitions(n: int, k: int) -> int:
    """Ways to part n points into k groups, none of them empty."""
    return sum((-1) ** (k - j) * math.comb(k, j) * j**n for j in range(k + 1)) // math.factorial(k)
