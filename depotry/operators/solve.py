"""Iterative placement: many small instances, one task each, or one large instance as a driver loop.

A small instance (a data set, a demand variant, a K) is solved by NumPy in one task of
``applyInPandas``; all restarts of it advance together as arrays. A large instance keeps its
points in Spark: each pass is a projection onto literal centres and one small aggregate.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotry.functions.geo import haversine
from depotry.operators.scan import prefix_sums
from depotry.schema import ORDER_KM, RUPEE, Profile
from depotry.storage import cut

WARM_SUBSETS = 200_000
#: A centre less than so many km from a point stands on it.
ON_POINT = 1e-9
#: Up to so many points a median is also compared with every point.
POINTS_TRIED = 400
PLACED = "dataset string, variant string, k int, wh_ord int, wh_id string, lat double, lon double, objective double"


class Metric:
    """Distances from fixed points."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, profile: Profile = RUPEE):
        self.lat, self.lon, self.profile = np.asarray(lat, float), np.asarray(lon, float), profile
        self.cos = np.cos(np.radians(self.lat))

    def to(self, centres: np.ndarray) -> np.ndarray:
        """km from each point (first axis) to centres (..., 2)."""
        c = np.radians(np.asarray(centres, float))
        shape = (-1,) + (1,) * (c.ndim - 1)
        lat, lon = np.radians(self.lat).reshape(shape), np.radians(self.lon).reshape(shape)
        a = np.sin((c[..., 0] - lat) / 2) ** 2 + self.cos.reshape(shape) * np.cos(c[..., 0]) * np.sin((c[..., 1] - lon) / 2) ** 2
        root = np.sqrt(a)
        arc = np.arcsin(np.minimum(1, root)) if self.profile.arc == "asin" else np.arctan2(root, np.sqrt(np.maximum(0, 1 - a)))
        return 2 * self.profile.radius_km * arc


def medians(metric: Metric, weights: np.ndarray, rounds: int = 400, tol: float = 1e-12) -> np.ndarray:
    """Geometric medians (m, 2) for m columns of weights, all at once.

    Reweighted means; where an iterate lands on a point, that point is the answer only if no
    pull of the others beats its own weight, else the iterate is moved off along that pull.
    """
    p = np.stack([metric.lat, metric.lon], axis=1)
    w = np.maximum(weights, 0)
    total = w.sum(0)
    at = np.where(total[:, None] > 0, (w.T @ p) / np.maximum(total, 1e-300)[:, None], p.mean(0))
    live = np.flatnonzero(total > 0)
    stretch = np.cos(np.radians(metric.lat.mean())) if len(p) else 1.0
    for _ in range(rounds):
        if not len(live):
            break
        d = metric.to(at[live])
        on = d < 1e-9
        pull = np.where(on, 0, w[:, live] / np.where(on, 1, d))
        sums = pull.sum(0)
        moved = np.where(sums[:, None] > 0, (pull.T @ p) / np.maximum(sums, 1e-300)[:, None], at[live])
        here = (w[:, live] * on).sum(0)
        gap = moved - at[live]
        force = sums * np.hypot(gap[:, 0], gap[:, 1] * stretch) * math.radians(1) * metric.profile.radius_km
        # Vardi and Zhang: the step shrinks by the share of the pull that the point itself holds.
        share = np.where(here > 0, np.minimum(1, here / np.maximum(force, 1e-300)), 0)
        new = at[live] + (1 - share)[:, None] * gap
        still = np.abs(new - at[live]).max(1) < tol
        at[live] = new
        live = live[~still]
    if len(p) <= POINTS_TRIED:
        # Where the answer is a point itself the steps close in on it slowly; the point is exact.
        own = metric.to(p).T @ w
        best = own.argmin(0)
        better = own[best, np.arange(w.shape[1])] < (metric.to(at) * w).sum(0)
        at = np.where(better[:, None], p[best], at)
    return at


def _seeds(metric: Metric, w: np.ndarray, k: int, runs: int, rng: np.random.Generator, heaviest: bool) -> np.ndarray:
    """(runs, k, 2) centres drawn far from one another, in proportion to weight times squared distance."""
    p = np.stack([metric.lat, metric.lon], axis=1)
    base = np.maximum(w, 1) if heaviest else np.maximum(w, 0) + 1e-12
    first = np.full(runs, int(w.argmax())) if heaviest else rng.choice(len(p), runs, p=base / base.sum())
    chosen = [first]
    near = metric.to(p[first])
    for _ in range(1, k):
        odds = base[:, None] * near**2
        odds = np.where(odds.sum(0) > 0, odds, 1.0)
        draw = (odds.cumsum(0) < rng.random(runs) * odds.sum(0)).sum(0).clip(0, len(p) - 1)
        chosen.append(draw)
        near = np.minimum(near, metric.to(p[draw]))
    return p[np.stack(chosen, axis=1)]


@dataclass(frozen=True)
class Search:
    """How a placement is searched for."""

    restarts: int = 12
    rounds: int = 80
    seed: int = 7
    exact_start: bool = True
    top_start: bool = False
    fill_empty: bool = False  # an empty cluster jumps to the point that pays most
    means: bool = False  # weighted means for medians: the k-means control


def order_km_search(n: int) -> Search:
    """The order-km model's search for n points."""
    return Search(restarts=30 if n <= 100 else 12 if n <= 300 else 6, rounds=100, seed=20260919, exact_start=False, top_start=True, fill_empty=True)


def place(metric: Metric, w: np.ndarray, k: int, search: Search = Search()) -> tuple[np.ndarray, np.ndarray, float]:
    """(centres, labels, objective) of the best plan found; a start that no refinement beats counts too."""
    p, n = np.stack([metric.lat, metric.lon], axis=1), len(w)
    k = max(1, min(int(k), n))
    starts = [_seeds(metric, w, k, search.restarts, np.random.default_rng(search.seed), not search.top_start)]
    if search.top_start:
        starts.append(p[np.argsort(-w, kind="stable")[:k]][None])
    if search.exact_start and not search.means and math.comb(n, k) <= WARM_SUBSETS:
        starts.append(p[best_subset(metric, w, k)[0]][None])
    best = (math.inf, starts[0][0])
    for start in np.concatenate(starts):
        at, labels = start.copy(), None
        for turn in range(search.rounds):
            d = metric.to(at)
            new = d.argmin(1)
            cost = float((w * d[np.arange(n), new]).sum())
            if cost < best[0] - 1e-12 and (turn == 0 or not search.means):
                best = (cost, at.copy())
            if labels is not None and (new == labels).all():
                break
            labels = new
            held = w[:, None] * (labels[:, None] == np.arange(k))
            empty = held.sum(0) <= 0
            if search.means:
                moved = (held.T @ p) / np.maximum(held.sum(0), 1e-300)[:, None]
            else:
                moved = medians(metric, held)
            moved[empty] = at[empty]
            if search.fill_empty:
                for c in np.flatnonzero(np.bincount(labels, minlength=k) == 0):
                    moved[c] = p[(w * d[np.arange(n), labels]).argmax()]
            at = moved
        d = metric.to(at)
        cost = float((w * d.min(1)).sum())
        if cost < best[0] - 1e-12:
            best = (cost, at)
    return best[1], metric.to(best[1]).argmin(1), best[0]


def best_subset(metric: Metric, w: np.ndarray, k: int) -> tuple[list[int], float]:
    """Best k of the points themselves, in blocks of subsets."""
    d = metric.to(np.stack([metric.lat, metric.lon], axis=1)) * w[:, None]
    best, block = (math.inf, list(range(k))), []

    def test(some: list[tuple[int, ...]]) -> None:
        nonlocal best
        index = np.array(some)
        cost = d[:, index].min(2).sum(0)
        i = int(cost.argmin())
        if cost[i] < best[0] - 1e-12:
            best = (float(cost[i]), list(some[i]))

    for s in combinations(range(len(w)), k):
        block.append(s)
        if len(block) == 4096:
            test(block)
            block = []
    if block:
        test(block)
    return best[1], best[0]


def solve_grouped(points: DataFrame, ks: tuple[int, ...], weight: str = "orders", profile: Profile = RUPEE, means: bool = False, search: Search | None = None) -> DataFrame:
    """Sites of the best plan found for each (dataset, variant, k); one task an instance.

    ``points`` may have a ``variant``; K is clamped to the number of points.
    """
    if "variant" not in points.columns:
        points = points.withColumn("variant", F.lit(""))
    rows = points.select("dataset", "variant", "ord", "id", "lat", "lon", F.col(weight).cast("double").alias("w")).withColumn("k", F.explode(F.array(*(F.lit(int(k)) for k in ks))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id" if profile is ORDER_KM or profile.name == "order_km" else "ord")
        how = search or (order_km_search(len(pdf)) if profile.name == "order_km" else Search())
        if means:
            how = Search(how.restarts, how.rounds, how.seed, means=True)
        centres, _, cost = place(Metric(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), profile), pdf["w"].to_numpy(), key[2], how)
        return pd.DataFrame([(key[0], key[1], key[2], i, f"W{i + 1}", lat, lon, cost) for i, (lat, lon) in enumerate(centres)], columns=["dataset", "variant", "k", "wh_ord", "wh_id", "lat", "lon", "objective"])

    return rows.groupBy("dataset", "variant", "k").applyInPandas(run, PLACED)


def _by_run(points: DataFrame, centres: dict[int, np.ndarray], profile: Profile) -> DataFrame:
    """Every point once for each run, with ``near``: (distance, number) of the run's nearest centre."""
    runs = points.sparkSession.createDataFrame([(r, [(float(a), float(b)) for a, b in at]) for r, at in centres.items()], "run int, spots array<struct<a:double,b:double>>")
    spots = F.transform("spots", lambda s, i: F.struct(haversine(F.col("lat"), F.col("lon"), s["a"], s["b"], profile).alias("d"), i.alias("c")))
    return points.crossJoin(F.broadcast(runs)).withColumn("near", F.array_min(spots)).drop("spots")


def _seeds_large(points: DataFrame, k: int, search: Search, profile: Profile) -> dict[int, np.ndarray]:
    """k centres for each restart, drawn over all points as ``_seeds`` does: k passes, one row a restart each.

    A draw in proportion to odds is the point with the least -log(u) / odds, u by a hash of the point.
    """
    first = points.agg(F.max_by(F.struct("lat", "lon"), F.struct("w", "h")).alias("p")).first()["p"]
    centres = {r: np.array([[first["lat"], first["lon"]]]) for r in range(search.restarts)}
    for turn in range(1, k):
        odds = F.greatest("w", F.lit(1.0)) * F.pow("near.d", F.lit(2))
        u = (F.pmod(F.xxhash64("h", "run", F.lit(turn), F.lit(search.seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
        drawn = _by_run(points, centres, profile).where(odds > 0).groupBy("run").agg(F.min_by(F.struct("lat", "lon"), F.struct(-F.log(u) / odds, F.col("h"))).alias("p")).collect()
        new = {r["run"]: r["p"] for r in drawn}  # none where every point is a centre already
        centres = {r: np.vstack([at, new[r] if r in new else at[0]]) for r, at in centres.items()}
    return centres


def solve_large(points: DataFrame, k: int, weight: str = "orders", profile: Profile = RUPEE, rounds: int = 400, tol_km: float = 1e-3, means: bool = False) -> list[tuple[float, float]]:
    """Centres for one instance of any size, as a driver loop over aggregates of k rows a restart.

    All restarts are drawn over all points and advance together: every pass assigns all points
    and takes one reweighted step for all centres of the restarts that still move. The last pass
    scores every restart on all points. After the draws, points of one place are one row.
    """
    rows = cut(points.select("lat", "lon", F.col(weight).cast("double").alias("w"), F.xxhash64("dataset", "ord").alias("h")))
    return _refined(_by_place(rows), _seeds_large(rows, k, Search(), profile), rounds, tol_km, means, profile)


def _by_place(rows: DataFrame) -> DataFrame:
    """(lat, lon, w): one row a place with the weight of all points there; the steps and costs of centres are the same."""
    spread = rows.sparkSession.sparkContext.defaultParallelism
    return cut(rows.groupBy("lat", "lon").agg(F.sum("w").alias("w")).repartition(spread))


def refine_large(points: DataFrame, centres: list[tuple[float, float]], weight: str = "orders", profile: Profile = RUPEE, rounds: int = 400, tol_km: float = 1e-3) -> list[tuple[float, float]]:
    """The centres after reweighted steps until they rest, points assigned anew in each."""
    rows = _by_place(points.select("lat", "lon", F.col(weight).cast("double").alias("w")))
    return _refined(rows, {0: np.array(centres, float)}, rounds, tol_km, False, profile)


def _refined(rows: DataFrame, centres: dict[int, np.ndarray], rounds: int, tol_km: float, means: bool, profile: Profile) -> list[tuple[float, float]]:
    live = set(centres)
    for _ in range(rounds):
        on = F.col("near.d") < ON_POINT
        pull = F.col("w") if means else F.when(on, F.lit(0.0)).otherwise(F.col("w") / F.col("near.d"))
        near = _by_run(rows, {r: centres[r] for r in sorted(live)}, profile)
        sums = near.groupBy("run", F.col("near.c").alias("c")).agg(F.sum(pull).alias("s"), F.sum(pull * F.col("lat")).alias("a"), F.sum(pull * F.col("lon")).alias("b"), F.sum(F.when(on, F.col("w")).otherwise(F.lit(0.0))).alias("here")).collect()  # k rows a restart
        new = {r: centres[r].copy() for r in live}
        for r in sums:
            if r["s"] > 0:
                at = centres[r["run"]][r["c"]]
                gap = np.array([r["a"] / r["s"], r["b"] / r["s"]]) - at
                force = r["s"] * math.hypot(gap[0], gap[1] * math.cos(math.radians(at[0]))) * math.radians(1) * profile.radius_km
                # The points under a centre hold it back by their weight: it leaves only if the others pull harder.
                held = 0.0 if means else min(1.0, r["here"] / max(force, 1e-300))
                new[r["run"]][r["c"]] = at + (1 - held) * gap
        live = {r for r in live if np.abs(new[r] - centres[r]).max() * 111.2 >= tol_km}
        centres |= new
        if not live:
            break
    else:
        warnings.warn(f"{len(live)} of {len(centres)} starts still moved by more than {tol_km} km after {rounds} rounds", stacklevel=3)
    costs = _by_run(rows, centres, profile).groupBy("run").agg(F.sum(F.col("w") * F.col("near.d")).alias("cost")).collect()  # a row a restart
    best = min(costs, key=lambda r: (r["cost"], r["run"]))["run"]
    return [(float(a), float(b)) for a, b in centres[best]]


def median_steps(points: DataFrame, steps: int, weight: str = "orders", profile: Profile = RUPEE) -> DataFrame:
    """(dataset, lat, lon) after so many reweighted steps from the weighted mean, in Spark's functions alone.

    Every step is one partial aggregate by data set joined back as a row, so points of any number
    stay where they are.
    """
    w = F.col(weight).cast("double")
    at = points.groupBy("dataset").agg((F.sum(w * F.col("lat")) / F.sum(w)).alias("_a"), (F.sum(w * F.col("lon")) / F.sum(w)).alias("_b"))
    for _ in range(steps):
        pull = w / F.greatest(haversine(F.col("lat"), F.col("lon"), F.col("_a"), F.col("_b"), profile), F.lit(1e-9))
        at = points.join(at, "dataset").groupBy("dataset").agg((F.sum(pull * F.col("lat")) / F.sum(pull)).alias("_a"), (F.sum(pull * F.col("lon")) / F.sum(pull)).alias("_b"))
    return at.select("dataset", F.col("_a").alias("lat"), F.col("_b").alias("lon"))


def means_steps(points: DataFrame, sites: DataFrame, steps: int, weight: str = "orders", profile: Profile = RUPEE) -> DataFrame:
    """(dataset, wh_ord, wh_id, lat, lon): weighted k-means from given sites, a fixed number of rounds; sites without points stay."""
    from depotry.operators.assign import nearest

    at = sites.select("dataset", "wh_ord", "wh_id", "lat", "lon")
    for _ in range(steps):
        w = F.col(weight).cast("double")
        moved = nearest(points, at, profile).groupBy("dataset", "wh_ord").agg((F.sum(w * F.col("lat")) / F.sum(w)).alias("_a"), (F.sum(w * F.col("lon")) / F.sum(w)).alias("_b"))
        at = at.join(moved, ["dataset", "wh_ord"], "left").select("dataset", "wh_ord", "wh_id", F.coalesce("_a", "lat").alias("lat"), F.coalesce("_b", "lon").alias("lon"))
    return at


def flat_means(points: DataFrame, k: int, restarts: int = 20, rounds: int = 100, seed: int = 20260919, profile: Profile = ORDER_KM) -> DataFrame:
    """PLACED of plain k-means on degrees, every point alike: the usual baseline. The restart with the least weighted cost counts; one task a data set."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        p, w, n = pdf[["lat", "lon"]].to_numpy(float), pdf["orders"].to_numpy(float), min(k, len(pdf))
        metric, rng, best = Metric(p[:, 0], p[:, 1], profile), np.random.default_rng(seed), (math.inf, p[:n])
        for _ in range(restarts):
            at = p[rng.choice(len(p), n, replace=False)]
            for _ in range(rounds):
                near = ((p[:, None] - at) ** 2).sum(2).argmin(1)
                held = near[:, None] == np.arange(n)
                new = np.where(held.any(0)[:, None], held.T @ p / np.maximum(held.sum(0), 1)[:, None], at)
                if (new == at).all():
                    break
                at = new
            cost = float((w * metric.to(at).min(1)).sum())
            if cost < best[0]:
                best = (cost, at)
        return pd.DataFrame([(key[0], "", n, i, f"W{i + 1}", a, b, best[0]) for i, (a, b) in enumerate(best[1])], columns=["dataset", "variant", "k", "wh_ord", "wh_id", "lat", "lon", "objective"])

    return points.select("dataset", "id", "lat", "lon", "orders").groupBy("dataset").applyInPandas(run, PLACED)


def roulette(points: DataFrame, share: float, weight: str = "orders") -> DataFrame:
    """(dataset, id, upto): the first point by ``ord`` at which the running sum of weights reaches ``share`` of the total."""
    s = prefix_sums(points, ["dataset"], ["ord"], {"upto": F.col(weight)})
    total = points.groupBy("dataset").agg(F.sum(weight).alias("_total"))
    reached = s.join(total, "dataset").where(F.col("upto") >= share * F.col("_total"))
    return reached.groupBy("dataset").agg(F.min_by(F.struct("id", "upto"), "ord").alias("p")).select("dataset", "p.id", "p.upto")
