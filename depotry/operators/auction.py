"""Capacitated assignment by auction: points bid for sites, sites keep the highest bids that fit, prices rise.

A point looks at distance plus price, bids for the best site the price at which it would be as happy
with its second, and ``eps`` more. A site keeps its bids, highest first, while the orders fit; the
highest bid that it turns down becomes its price. A round is one projection of the points that are
out, one running sum of bids by site in two levels (no task holds a site's points) and a maximum by
site, so nothing grows with a data set but the points themselves. Coarse bids end a price war soon,
finer ones start again from prices a little below. Any prices give a lower bound on every plan,
whole or split, so a plan comes with its proven gap.

Then whole points move, or change places in pairs, wherever that is cheaper and fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotry.functions.geo import haversine
from depotry.operators import assign
from depotry.operators.scan import prefix_sums
from depotry.schema import ORDER_KM, Profile
from depotry.storage import cut

MOST_SITES = 512
#: Points of each (site, other site) that are tried in pairs, cheapest first.
TRIED = 32
STATE = ("dataset", "ord", "id", "lat", "lon", "orders", "km", "site", "level")


def opened(points: DataFrame, sites: DataFrame, profile: Profile = ORDER_KM) -> tuple[DataFrame, DataFrame]:
    """(state, prices): all points out, ``km`` their distances by site in order; all prices zero."""
    packed = sites.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("wh_ord", "lat", "lon"))).alias("_sites"))
    packed = cut(packed.withColumn("_sites", F.when(F.size("_sites") <= MOST_SITES, F.col("_sites")).otherwise(F.raise_error(F.lit(f"more than {MOST_SITES} sites in an auction")))))
    km = F.transform("_sites", lambda s: haversine(F.col("lat"), F.col("lon"), s["lat"], s["lon"], profile))
    state = points.select("dataset", "ord", "id", "lat", "lon", "orders").join(packed, "dataset").withColumn("km", km).drop("_sites")
    state = state.withColumn("site", F.lit(None).cast("int")).withColumn("level", F.lit(None).cast("double"))
    return cut(state.select(*STATE)), packed.select("dataset", F.transform("_sites", lambda s: F.lit(0.0)).alias("prices"))


def bid_round(state: DataFrame, prices: DataFrame, capacity: int, eps: float) -> tuple[DataFrame, DataFrame]:
    """(state, prices) after the points that are out have bid and the sites have chosen."""
    value = F.array_sort(F.transform("km", lambda d, i: F.struct((d + F.get("prices", i)).alias("v"), i.alias("i"))))
    best, second = F.col("_v")[0], F.get("_v", F.lit(1))
    bids = state.join(prices, "dataset").withColumn("_v", F.slice(value, 1, 2)).withColumn("_out", F.col("site").isNull())
    raise_ = F.coalesce(second["v"] - best["v"], F.lit(0.0)) + F.lit(float(eps))
    bids = bids.withColumn("level", F.when(F.col("_out"), F.get("prices", best["i"]) + raise_).otherwise(F.col("level"))).withColumn("site", F.when(F.col("_out"), best["i"]).otherwise(F.col("site")))
    told = cut(prefix_sums(bids.select(*STATE), ["dataset", "site"], [F.desc("level"), "ord"], {"_upto": F.col("orders")}).withColumn("_no", F.col("_upto") > capacity))
    raised = told.where("_no").groupBy("dataset", "site").agg(F.max("level").alias("p")).groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("site", "p"))).alias("_p"))
    new = F.transform("prices", lambda p, i: F.greatest(p, F.coalesce(F.try_element_at("_p", i), p)))
    prices = cut(prices.join(raised, "dataset", "left").select("dataset", F.when(F.col("_p").isNull(), F.col("prices")).otherwise(new).alias("prices")))
    keep = [F.when(~F.col("_no"), F.col(c)).alias(c) for c in ("site", "level")]
    return told.select(*STATE[:-2], *keep), prices


def lower_bound(state: DataFrame, prices: DataFrame, capacity: int) -> DataFrame:
    """(dataset, bound): no plan within the capacity costs less, by the prices."""
    least = F.array_min(F.transform("km", lambda d, i: d + F.get("prices", i)))
    held = state.join(prices, "dataset").groupBy("dataset").agg(F.sum(F.col("orders") * least).alias("_s"), F.first("prices").alias("_p"))
    return held.select("dataset", F.greatest(F.lit(0.0), F.col("_s") - F.lit(float(capacity)) * F.aggregate("_p", F.lit(0.0), lambda a, p: a + p)).alias("bound"))


def _moves(state: DataFrame, capacity: int) -> DataFrame:
    """(dataset, a, b, rise, ords, to): the cheapest move of a point from ``a`` to ``b`` or exchange of two that fits and is cheaper than nothing."""
    load = state.groupBy("dataset", "site").agg(F.sum("orders").alias("load"))
    ways = state.select("dataset", "ord", "orders", F.col("site").alias("a"), F.posexplode("km").alias("b", "_to"), F.get("km", F.col("site")).alias("_own")).where("a <> b")
    rise = ways.select("dataset", "a", "b", "ord", "orders", (F.col("orders") * (F.col("_to") - F.col("_own"))).alias("rise"))
    room = load.select("dataset", F.col("site").alias("b"), F.col("load").alias("lb"))
    single = rise.join(room, ["dataset", "b"], "left").where((F.coalesce("lb", F.lit(0)) + F.col("orders") <= capacity) & (F.col("rise") < -1e-9))
    single = single.groupBy("dataset", "a", "b").agg(F.min(F.struct("rise", "ord")).alias("m")).select("dataset", "a", "b", "m.rise", F.array("m.ord").alias("ords"), F.array("b").alias("to"))
    # The cheapest few of each pair of sites, found without ordering all points of a site in one task.
    share = F.pmod(F.xxhash64("ord"), F.lit(64))
    near = rise.withColumn("_s", share).withColumn("_n", F.row_number().over(Window.partitionBy("dataset", "a", "b", "_s").orderBy("rise", "ord"))).where(F.col("_n") <= TRIED)
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("dataset", "a", "b").orderBy("rise", "ord"))).where(F.col("_n") <= TRIED).drop("_s", "_n")
    back = near.select("dataset", F.col("b").alias("a"), F.col("a").alias("b"), F.col("ord").alias("ord2"), F.col("orders").alias("orders2"), F.col("rise").alias("rise2"))
    own = load.select("dataset", F.col("site").alias("a"), F.col("load").alias("la"))
    pair = near.where("a < b").join(back, ["dataset", "a", "b"]).join(own, ["dataset", "a"]).join(room, ["dataset", "b"])
    pair = pair.where((F.col("la") - F.col("orders") + F.col("orders2") <= capacity) & (F.col("lb") - F.col("orders2") + F.col("orders") <= capacity) & (F.col("rise") + F.col("rise2") < -1e-9))
    pair = pair.groupBy("dataset", "a", "b").agg(F.min(F.struct((F.col("rise") + F.col("rise2")).alias("rise"), "ord", "ord2")).alias("m")).select("dataset", "a", "b", "m.rise", F.array("m.ord", "m.ord2").alias("ords"), F.array("b", "a").alias("to"))
    return single.unionByName(pair)


def improve(state: DataFrame, capacity: int, rounds: int = 100) -> DataFrame:
    """``state`` after moves and exchanges, until none is cheaper: each round makes the best ones that touch different sites."""
    for _ in range(rounds):
        best = Window.partitionBy("dataset", "_one").orderBy("rise", "a", "b")
        some = cut(_moves(state, capacity))
        # A change counts if it is the best of both its sites: at most one change a site.
        sides = some.withColumn("_one", F.explode(F.array("a", "b"))).withColumn("_n", F.row_number().over(best))
        made = sides.groupBy("dataset", "a", "b", "rise", "ords", "to").agg(F.max("_n").alias("_n")).where("_n = 1")
        go = cut(made.select("dataset", F.explode(F.arrays_zip("ords", "to")).alias("m")).select("dataset", F.col("m.ords").alias("ord"), F.col("m.to").alias("_new")))
        if not go.limit(1).count():
            return state
        state = cut(state.join(go, ["dataset", "ord"], "left").withColumn("site", F.coalesce("_new", "site")).select(*STATE))
    return state


def auction(points: DataFrame, sites: DataFrame, capacity: int, eps: tuple[float, ...] = (2.0, 0.5, 0.1), rounds: int = 200, profile: Profile = ORDER_KM, polish: bool = True) -> tuple[DataFrame, DataFrame]:
    """(assignment: dataset, ord, id, orders, wh_id, dist_km; summary: dataset, cost, bound, gap_pct, overload).

    ``rounds`` ends a phase whose demand does not fit; points that are still out then go to the
    nearest site with room, largest first, or to the nearest if none has: only they overload.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    state, prices = opened(points, sites, profile)
    bound, before = None, 0.0
    for step in eps:
        # Sites with low prices are open again; all points bid anew.
        prices = prices.withColumn("prices", F.transform("prices", lambda p: F.greatest(F.lit(0.0), p - F.lit(2 * before))))  # noqa: B023
        state, before = state.withColumn("site", F.lit(None).cast("int")).withColumn("level", F.lit(None).cast("double")), step
        for _ in range(rounds):
            state, prices = bid_round(state, prices, capacity, step)
            if not state.where("site IS NULL").limit(1).count():
                break
        new = lower_bound(state, prices, capacity)
        bound = cut(new if bound is None else bound.unionByName(new).groupBy("dataset").agg(F.max("bound").alias("bound")))
    state = cut(_whole(state, sites, capacity, profile))
    if polish:
        state = improve(state, capacity)
    numbered = sites.withColumn("site", F.row_number().over(Window.partitionBy("dataset").orderBy("wh_ord")) - 1).select("dataset", "site", "wh_id")  # MOST_SITES a data set
    out = state.join(numbered, ["dataset", "site"]).select("dataset", "ord", "id", "orders", "wh_id", F.get("km", F.col("site")).alias("dist_km"))
    return out, summary(out, bound, capacity)


def _whole(state: DataFrame, sites: DataFrame, capacity: int, profile: Profile) -> DataFrame:
    """``state`` with the points that are out placed greedily in the room that is left."""
    out = state.where("site IS NULL")
    if not out.limit(1).count():
        return state
    taken = state.where("site IS NOT NULL").groupBy("dataset", "site").agg(F.sum("orders").alias("taken"))
    placed = assign.greedy_capacity(out, sites, capacity, profile, taken)
    number = sites.withColumn("_new", F.row_number().over(Window.partitionBy("dataset").orderBy("wh_ord")) - 1).select("dataset", "wh_id", "_new")
    new = placed.join(number, ["dataset", "wh_id"]).select("dataset", "ord", "_new")
    return state.join(new, ["dataset", "ord"], "left").withColumn("site", F.coalesce("site", "_new")).select(*STATE)


def summary(assigned: DataFrame, bound: DataFrame, capacity: int) -> DataFrame:
    """(dataset, cost, bound, gap_pct, overload) of an assignment; overload is the most that any site has too much."""
    load = assigned.groupBy("dataset", "wh_id").agg(F.sum("orders").alias("load"), F.sum(F.col("orders") * F.col("dist_km")).alias("cost"))
    total = load.groupBy("dataset").agg(F.sum("cost").alias("cost"), F.greatest(F.lit(0), F.max("load") - capacity).cast("long").alias("overload"))
    gap: Column = F.when(F.col("bound") > 0, 100 * (F.col("cost") - F.col("bound")) / F.col("bound"))
    return total.join(bound, "dataset").select("dataset", "cost", "bound", gap.alias("gap_pct"), "overload")
