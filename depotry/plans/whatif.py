"""Scenarios, sweeps over K, stress, ladder, proof and verification, composed from the operators.

Prices never move sites: a point's weight is its trips times one constant. So sites are solved
once for each data set, demand and K, and any number of price points are joined to them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotry.functions.geo import haversine, mulberry
from depotry.operators import assign, capacity, cost, exact, solve
from depotry.schema import ORDER_KM, RUPEE, Config, Profile

PLAN = ("dataset", "variant", "k")


def demand_scenarios(points: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Points under every scenario (``variant``): growth, tilted by how far a point lies from the centre."""
    centre = points.groupBy("dataset").agg(F.avg("lat").alias("_clat"), F.avg("lon").alias("_clon"))
    far = points.join(centre, "dataset").withColumn("_d", haversine(F.col("lat"), F.col("lon"), F.col("_clat"), F.col("_clon")))
    top = far.groupBy("dataset").agg(F.greatest(F.max("_d"), F.lit(1e-9)).alias("_top"))
    spread = far.join(top, "dataset").crossJoin(F.broadcast(scenarios.select("scenario", "growth", "bias")))  # a handful of scenarios
    tilt = F.col("bias") * (F.col("_d") / F.col("_top") - 0.5) * 2
    grown = F.greatest(F.lit(0.0), F.col("growth") * (1 + 0.5 * tilt))
    same = (F.col("growth") == 1) & (F.col("bias") == 0)
    orders = F.when(same, F.col("orders")).otherwise(F.greatest(F.lit(0), F.round(F.col("orders") * grown)).cast("long"))
    return spread.select("dataset", F.col("scenario").alias("variant"), "ord", "id", "lat", "lon", orders.alias("orders"))


def perturbed(points: DataFrame, trials: int, swing: float, seed: int, profile: Profile = RUPEE) -> DataFrame:
    """Points under seeded trials (``variant`` 0 and up): orders moved by up to ``swing`` (a share) each way.

    Draw ``trial * n + position`` belongs to a point, so trials and points draw in any order.
    """
    size = points.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    rank = Window.partitionBy("dataset").orderBy("ord")
    drawn = points.withColumn("_i", F.row_number().over(rank)).join(size, "dataset").withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    u = mulberry(seed, F.col("_t") * F.col("_n") + F.col("_i"))
    moved = F.col("orders") * (1 + (2 * u - 1) * F.lit(float(swing)))
    whole = F.bround(moved) if profile.name == "order_km" else F.round(moved)
    return drawn.select("dataset", F.col("_t").cast("string").alias("variant"), "ord", "id", "lat", "lon", F.greatest(F.lit(0), whole).cast("long").alias("orders"))


def with_variant(points: DataFrame) -> DataFrame:
    return points if "variant" in points.columns else points.withColumn("variant", F.lit(""))


def solved(points: DataFrame, ks: tuple[int, ...], config: Config, means: bool = False) -> DataFrame:
    """Sites for every data set, variant and K by the rupee weights, rounded to six places before anything is priced."""
    sites = solve.solve_grouped(cost.cost_weight(with_variant(points), config), ks, "weight", RUPEE, means=means)
    return sites.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


def priced(points: DataFrame, sites: DataFrame, config: Config) -> DataFrame:
    """Breakdown of every plan in ``sites``."""
    rows = cost.row_cost(_nearest_by_plan(points, sites), config)
    return cost.breakdown(rows, sites, config, PLAN)


def _nearest_by_plan(points: DataFrame, sites: DataFrame, profile: Profile = RUPEE) -> DataFrame:
    plans = sites.select(*PLAN).distinct()
    return assign.nearest(with_variant(points).join(plans, ["dataset", "variant"]), sites, profile, PLAN)


def k_sweep(points: DataFrame, most: int, config: Config) -> DataFrame:
    """(dataset, variant, k, delivery, infrastructure, total, improvement_pct, optimal_k) for K = 1 to ``most`` (ten at most)."""
    points = with_variant(points).cache()
    size = F.broadcast(points.groupBy("dataset").agg(F.countDistinct("ord").alias("_n")))
    sites = solved(points, tuple(range(1, min(most, 10) + 1)), config).join(size, "dataset").where("k <= _n").drop("_n")
    one = Window.partitionBy("dataset", "variant").orderBy("k")
    every = Window.partitionBy("dataset", "variant")
    plans = priced(points, sites.cache(), config).withColumn("_base", F.first("total").over(one))
    best = F.min(F.struct(F.round("total", 6).alias("t"), "k")).over(every)["k"]
    return plans.select(*PLAN, "delivery", "infrastructure", "total", cost.improvement_pct(F.col("_base"), F.col("total")).alias("improvement_pct"), best.alias("optimal_k"))


def saving_vs_previous(sweep: DataFrame, by: tuple[str, ...] = ("dataset",), order: str = "k", value: str = "cost") -> DataFrame:
    """``saving_vs_prev_pct``: null for the first."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return sweep.withColumn("saving_vs_prev_pct", F.when(before > 0, 100 * (before - F.col(value)) / before))


def elbow(sweep: DataFrame, by: tuple[str, ...] = ("dataset",), value: str = "cost") -> DataFrame:
    """(by, k): the K farthest below the chord from first to last; the last of fewer than three; the first of a flat curve."""
    curve = sweep.groupBy(*by).agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min_by(value, "k").alias("c0"), F.max_by(value, "k").alias("c1"), F.count(F.lit(1)).alias("n"))
    x = (F.col("k") - F.col("k0")) / F.nullif(F.col("k1") - F.col("k0"), F.lit(0))
    y = (F.col(value) - F.col("c1")) / F.nullif(F.col("c0") - F.col("c1"), F.lit(0))
    bent = sweep.join(curve, list(by)).withColumn("_gap", F.round((1 - x) - y, 12))
    pick = F.when(F.first("n") < 3, F.max("k")).when(F.first("c0") == F.first("c1"), F.min("k")).otherwise(F.max(F.struct("_gap", (-F.col("k")).alias("m")))["m"] * -1)
    return bent.groupBy(*by).agg(pick.alias("k"))


def order_km_sweep(points: DataFrame, most: int) -> DataFrame:
    """The order-km model's sweep: (dataset, k, cost, km_per_order, saving_vs_prev_pct)."""
    sites = solve.solve_grouped(points, tuple(range(1, most + 1)), profile=ORDER_KM)
    totals = points.groupBy("dataset").agg(F.sum("orders").alias("_o"), F.count(F.lit(1)).alias("_n"))
    plans = sites.groupBy("dataset", "k").agg(F.first("objective").alias("cost")).join(totals, "dataset").where("k <= _n")
    return saving_vs_previous(plans.select("dataset", "k", "cost", (F.col("cost") / F.greatest("_o", F.lit(1))).alias("km_per_order")))


def verdict_of_regret(mean: Column) -> Column:
    return F.when(mean < 1, "holds up").when(mean < 3, "small regret").when(mean < 7, "some regret").otherwise("rethink")


def regret(points: DataFrame, sites: DataFrame, trials: int, swing: float, seed: int, profile: Profile = RUPEE, weight: Config | None = None, within: float = 5.0) -> DataFrame:
    """(dataset, k, trials, mean_regret_pct, worst_regret_pct, within_pct, verdict): kept sites against sites solved for each trial."""
    moved = perturbed(points, trials, swing, seed, profile)
    moved = cost.cost_weight(moved, weight) if weight else moved.withColumn("weight", F.col("orders").cast("double"))
    ks = tuple(r["k"] for r in sites.select("k").distinct().collect())
    ideal = solve.solve_grouped(moved, ks, "weight", profile).groupBy(*PLAN).agg(F.first("objective").alias("ideal"))
    plans = sites.select("dataset", "k", "wh_ord", "wh_id", "lat", "lon")
    held = assign.nearest(moved.join(plans.select("dataset", "k").distinct(), "dataset"), plans, profile, ("dataset", "k"))
    kept = held.groupBy(*PLAN).agg(F.sum(F.col("weight") * F.col("dist_km")).alias("kept"))
    gap = F.when(F.col("ideal") > 0, 100 * (F.col("kept") - F.col("ideal")) / F.col("ideal")).otherwise(F.lit(0.0))
    each = kept.join(ideal, list(PLAN)).withColumn("_r", F.greatest(gap, F.lit(0.0)))
    out = each.groupBy("dataset", "k").agg(F.count(F.lit(1)).alias("trials"), F.avg("_r").alias("mean_regret_pct"), F.max("_r").alias("worst_regret_pct"), (100 * F.count_if(F.col("_r") <= within) / F.count(F.lit(1))).alias("within_pct"))
    return out.withColumn("verdict", verdict_of_regret(F.col("mean_regret_pct")))


def proof(points: DataFrame, k: int, config: Config) -> DataFrame:
    """One row a data set: heuristic, best subset, certificate, k-means control, verdict and claim.

    The penalty of k-means comes twice: on delivery alone and on the total with rent.
    """
    weighted = cost.cost_weight(points, config).cache()
    sites = solve.solve_grouped(weighted, (k,), "weight", RUPEE).cache()
    means = solve.solve_grouped(weighted, (k,), "weight", RUPEE, means=True).groupBy("dataset").agg(F.first("objective").alias("kmeans"))
    found = sites.groupBy("dataset").agg(F.first("objective").alias("heuristic"), F.count(F.lit(1)).alias("_k"))
    sizes = {r["dataset"]: r["n"] for r in points.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a data set
    fits = [d for d, n in sizes.items() if math.comb(n, min(k, n)) <= exact.MOST_SUBSETS]
    best = exact.pmedian(weighted.where(F.col("dataset").isin(fits)), k, "weight").select("dataset", F.col("objective").alias("discrete"), "evaluated")
    local = exact.certificate(weighted, sites, "weight").select("dataset", "probes", "best_gain_pct", "is_local_optimum")
    rows = found.join(means, "dataset").join(local, "dataset").join(best, "dataset", "left")
    beats = F.coalesce(F.col("heuristic") <= F.col("discrete") * (1 + 1e-9), F.lit(False))
    rent = F.lit(float(config.rent_per_day)) * F.col("_k")
    verdict = F.when(F.lit(k == 1), F.when(F.col("is_local_optimum"), "globally-optimal").otherwise("failed")).when(beats & F.col("is_local_optimum"), "certified").when(beats | F.col("is_local_optimum"), "partially-certified").otherwise("failed")
    claim = F.when(verdict == "globally-optimal", F.format_string("The 1-median problem is convex; none of %d nearby places is better.", F.col("probes").cast("int"))).when(verdict == "certified", F.format_string("At least as good as all %d subsets of the points, and none of %d nearby places is better.", F.coalesce("evaluated", F.lit(0)).cast("int"), F.col("probes").cast("int"))).when(
        verdict == "partially-certified", F.when(F.col("is_local_optimum"), "No nearby place is better; a subset of the points is, or they are too many to try.").otherwise("As good as every subset of the points, but a nearby place is better.")
    ).otherwise("A nearby place is better: more restarts are needed.")
    return rows.select(
        "dataset", F.lit(k).alias("k"), "heuristic", "discrete", "evaluated", (100 * (F.col("discrete") - F.col("heuristic")) / F.col("discrete")).alias("continuous_advantage_pct"), "probes", "best_gain_pct", "is_local_optimum", "kmeans",
        (100 * (F.col("kmeans") - F.col("heuristic")) / F.nullif("heuristic", F.lit(0.0))).alias("kmeans_delivery_penalty_pct"), (100 * (F.col("kmeans") - F.col("heuristic")) / (F.col("heuristic") + rent)).alias("kmeans_total_penalty_pct"), verdict.alias("verdict"), claim.alias("claim"),
    )


def centre_baseline(points: DataFrame) -> DataFrame:
    """(dataset, rung, label, cost): one depot at the centre of the map; order-km."""
    centre = cost.centroids(points).select("dataset", F.lit(0).cast("long").alias("wh_ord"), F.lit("W1").alias("wh_id"), F.col("lat_centre").alias("lat"), F.col("lon_centre").alias("lon"))
    return cost.weighted_cost(assign.nearest(points, centre, ORDER_KM)).select("dataset", F.lit(0).alias("rung"), F.lit("centre").alias("label"), "cost")


def comparison_ladder(points: DataFrame, k: int) -> DataFrame:
    """(dataset, rung, label, cost, improvement_pct, saving_vs_prev_pct): centre of the map, plain k-means on degrees, optimised; order-km."""
    naive, means = centre_baseline(points), solve.flat_means(points, k)
    best = solve.solve_grouped(points, (k,), profile=ORDER_KM)
    rungs = naive
    for i, (label, plan) in enumerate((("k-means", means), ("optimised", best)), 1):
        rungs = rungs.unionByName(plan.groupBy("dataset").agg(F.first("objective").alias("cost")).select("dataset", F.lit(i).alias("rung"), F.lit(label).alias("label"), "cost"))
    base = F.first("cost").over(Window.partitionBy("dataset").orderBy("rung"))
    return saving_vs_previous(rungs.withColumn("improvement_pct", cost.improvement_pct(base, F.col("cost"))), order="rung")


def verify(points: DataFrame, plan_cost: DataFrame, k: int, tolerance_pct: float = 0.1, continuous: bool = True) -> DataFrame:
    """(dataset, plan_cost, discrete, continuous, gap_pct, verdict) of plan_cost(dataset, cost): PASS, FAIL or SKIP, order-km.

    Raises if the best plan anywhere is dearer than the best subset, which cannot be.
    """
    discrete = exact.pmedian(points, k, profile=ORDER_KM).select("dataset", F.col("objective").alias("discrete"))
    totals = points.groupBy("dataset").agg(F.sum("orders").alias("_o"), F.count(F.lit(1)).alias("_n"))
    out = plan_cost.join(discrete, "dataset").join(totals, "dataset")
    if continuous:
        few = points.join(totals.where(F.col("_n") <= exact.MOST_CONTINUOUS).select("dataset"), "dataset", "left_semi")
        out = out.join(exact.continuous_optimum(few, (k,), profile=ORDER_KM).select("dataset", F.col("objective").alias("continuous")), "dataset", "left")
    else:
        out = out.withColumn("continuous", F.lit(None).cast("double"))
    wrong = F.col("continuous") > F.col("discrete") * (1 + 1e-6) + F.col("_o") * 0.001
    bar = F.coalesce(F.when(wrong, F.raise_error(F.lit("the continuous optimum is above the discrete one")).cast("double")).otherwise(F.col("continuous")), F.col("discrete"))
    gap = F.when(bar > 0, 100 * (F.col("cost") - bar) / bar).otherwise(F.lit(0.0))
    fine = (F.col("cost") <= bar * (1 + tolerance_pct / 100) + F.col("_o") * 0.001) & (F.col("cost") >= F.coalesce("continuous", F.lit(0.0)) * (1 - 1e-6) - F.col("_o") * 0.001)
    verdict = F.when(F.col("continuous").isNull() & F.lit(continuous), F.when(F.col("cost") <= F.col("discrete") * (1 + tolerance_pct / 100), "PASS").otherwise("SKIP")).when(fine, "PASS").otherwise("FAIL")
    return out.select("dataset", F.col("cost").alias("plan_cost"), "discrete", "continuous", gap.alias("gap_pct"), verdict.alias("verdict"))


def spot_check(points: DataFrame, k: int, samples: int = 5, size: int = 8, seed: int = 0, tolerance_pct: float = 0.1) -> DataFrame:
    """``verify`` of the solver on random small parts of each data set."""
    drawn = points.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("_n", F.row_number().over(Window.partitionBy("dataset", "_s").orderBy(F.xxhash64(F.lit(seed), "_s", "ord"))))
    parts = drawn.where(F.col("_n") <= size).withColumn("dataset", F.concat_ws("#", "dataset", "_s")).drop("_s", "_n").cache()
    costs = solve.solve_grouped(parts, (k,), profile=ORDER_KM).groupBy("dataset").agg(F.first("objective").alias("cost"))
    return verify(parts, costs, k, tolerance_pct)


def cross_check(points: DataFrame, k: int, tolerance_pct: float = 1.0) -> DataFrame:
    """``verify`` where it is cheap: up to ten points and K of three; SKIP elsewhere."""
    sizes = points.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    few = points.join(sizes.where((F.col("_n") <= exact.MOST_CONTINUOUS) & F.lit(k <= 3)), "dataset", "left_semi").cache()
    costs = solve.solve_grouped(few, (min(k, 3),), profile=ORDER_KM).groupBy("dataset").agg(F.first("objective").alias("cost"))
    done = verify(few, costs, min(k, 3), tolerance_pct).select("dataset", "gap_pct", "verdict")
    return sizes.select("dataset").join(done, "dataset", "left").withColumn("verdict", F.coalesce("verdict", F.lit("SKIP")))


def agreement(points: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """The two models' solvers on plain order weights: objectives, and the share of points in matched clusters.

    Clusters are matched by the points that they share, so a different order of sites is no difference.
    """
    plans = {p.name: solve.solve_grouped(points, ks, profile=p).cache() for p in (RUPEE, ORDER_KM)}
    labels = {n: assign.nearest(points.join(s.select("dataset", "k").distinct(), "dataset"), s, RUPEE, ("dataset", "k")).select("dataset", "k", "ord", F.col("wh_ord").alias(n)) for n, s in plans.items()}
    both = labels["rupee"].join(labels["order_km"], ["dataset", "k", "ord"])
    shared = both.groupBy("dataset", "k", "rupee", "order_km").agg(F.count(F.lit(1)).alias("n"))
    top = shared.groupBy("dataset", "k", "rupee").agg(F.max("n").alias("n")).groupBy("dataset", "k").agg(F.sum("n").alias("same"))
    size = points.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    cost_of = [s.groupBy("dataset", "k").agg(F.first("objective").alias(f"cost_{n}")) for n, s in plans.items()]
    return top.join(cost_of[0], ["dataset", "k"]).join(cost_of[1], ["dataset", "k"]).join(size, "dataset").withColumn("same_share", F.col("same") / F.col("_n")).drop("same", "_n")


def run(points: DataFrame, k: int, config: Config = Config()) -> dict[str, DataFrame]:
    """The rupee pipeline: sites, assignment, priced rows, one summary row a data set."""
    points = points.cache()
    sites = solved(points, (1, k), config).cache()
    plan = sites.where(F.col("k") == k) if k > 1 else sites
    at = plan.select("dataset", "k", "wh_ord", "wh_id", "lat", "lon")
    if config.capacity:
        greedy = assign.greedy_capacity(points, at, config.capacity)
        near = points.join(greedy.select("dataset", "ord", "wh_id", "dist_km"), ["dataset", "ord"])
        assigned = assign.lookup(near, at)
    else:
        assigned = assign.nearest(points, at)
    load = assign.loads(assigned, at)
    rows = cost.row_cost(assigned, config)
    base = priced(points, sites.where("k = 1"), config).select("dataset", F.col("total").alias("base_total"), F.col("vehicle_km").alias("base_vehicle_km"))
    control = priced(points, solved(points, (k,), config, means=True), config).select("dataset", F.col("total").alias("kmeans_total"), F.col("delivery").alias("kmeans_delivery"))
    totals = cost.breakdown(rows, at, config).join(base, "dataset").join(control, "dataset").join(assign.over_capacity(load, config.capacity), "dataset")
    totals = totals.withColumn("improvement_pct", cost.improvement_pct(F.col("base_total"), F.col("total"))).withColumn("placement_gain_pct", 100 * (F.col("kmeans_total") - F.col("total")) / F.col("kmeans_total"))
    labels = assign.relabel(load, at).select("dataset", "wh_id", "label")
    return {"sites": at.join(labels, ["dataset", "wh_id"]), "assignment": assigned.join(labels, ["dataset", "wh_id"]), "load": load, "rows": rows, "summary": cost.impact(totals, config)}


def run_order_km(points: DataFrame, k: int, limit: int | None = None, cost_per_km: float | None = None, co2_g_per_km: float | None = None) -> dict[str, DataFrame]:
    """The order-km pipeline, capacitated if ``limit`` is given."""
    sites = solve.solve_grouped(points, (k,), profile=ORDER_KM).cache()
    ladder = comparison_ladder(points, k)
    naive = ladder.where("rung = 0").select("dataset", F.col("cost").alias("base_order_km"))
    if limit:
        plan = capacity.best_plan(capacity.search(points, sites, limit)).select("dataset", F.col("cost").alias("order_km"), "overload", "loads")
    else:
        plan = sites.groupBy("dataset").agg(F.first("objective").alias("order_km"))
    return {"sites": sites, "ladder": ladder, "summary": cost.impact_order_km(plan.join(naive, "dataset"), cost_per_km, co2_g_per_km)}


def pair_sites(left: DataFrame, right: DataFrame, profile: Profile = RUPEE) -> DataFrame:
    """(dataset, k, left_id, right_id, km): every left site in turn takes the nearest right one still free.

    A fold over the sites of two plans, at most a few dozen each.
    """
    def side(s: DataFrame, name: str) -> DataFrame:
        return s.groupBy("dataset", "k").agg(F.array_sort(F.collect_list(F.struct("wh_ord", "wh_id", "lat", "lon"))).alias(name))

    none = F.expr("CAST(array() AS array<struct<left_id:string,right_id:string,km:double>>)")

    def take(done: Column, a: Column) -> Column:
        free = F.filter("r", lambda b: ~F.exists(done, lambda d: d["right_id"] == b["wh_id"]))
        near = F.array_min(F.transform(free, lambda b: F.struct(haversine(a["lat"], a["lon"], b["lat"], b["lon"], profile).alias("km"), b["wh_ord"].alias("o"), b["wh_id"].alias("i"))))
        return F.when(F.size(free) > 0, F.concat(done, F.array(F.struct(a["wh_id"].alias("left_id"), near["i"].alias("right_id"), near["km"].alias("km"))))).otherwise(done)

    both = side(left, "l").join(side(right, "r"), ["dataset", "k"])
    return both.select("dataset", "k", F.explode(F.aggregate("l", none, take)).alias("p")).select("dataset", "k", "p.*")


def rising_steps(sweep: DataFrame, by: tuple[str, ...] = ("dataset",), value: str = "delivery") -> DataFrame:
    """Rows of a sweep whose value is above that of the K before: none, if the placement is sound."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy("k"))
    return sweep.withColumn("_before", before).where(F.col(value) > F.col("_before") * (1 + 1e-9)).drop("_before")


def co2_matches_fuel(vehicles: DataFrame) -> DataFrame:
    """(vehicle, grams_per_litre, consistent): within 3 g of petrol's or diesel's; null for fleets without fuel."""
    # Grams of CO2 a litre of petrol and of diesel.
    litre = F.col("co2_g_per_km") / F.nullif("fuel_per_km", F.lit(0.0))
    near = [F.abs(F.col("co2_g_per_km") - F.col("fuel_per_km") * g) <= 3 for g in (2310.0, 2680.0)]
    return vehicles.select("vehicle", litre.alias("grams_per_litre"), F.when(F.col("fuel_per_km") > 0, near[0] | near[1]).alias("consistent"))


def headline(points: DataFrame, config: Config = Config(), k: int = 3) -> DataFrame:
    """(dataset, k, total, per_order, saving_pct, is_optimal): K, and the cheapest K, against one depot."""
    sweep = k_sweep(points, 8, config)
    orders = points.groupBy("dataset").agg(F.sum("orders").alias("_o"))
    base = sweep.where("k = 1").select("dataset", F.col("total").alias("_base"))
    rows = sweep.where((F.col("k") == k) | (F.col("k") == F.col("optimal_k"))).join(base, "dataset").join(orders, "dataset")
    return rows.select("dataset", "k", "total", (F.col("total") / F.greatest("_o", F.lit(1))).alias("per_order"), cost.improvement_pct(F.col("_base"), F.col("total")).alias("saving_pct"), (F.col("k") == F.col("optimal_k")).alias("is_optimal"))
