"""Points to sites: nearest site, loads, flags, relabelling, greedy capacity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotry.functions.geo import haversine
from depotry.operators.scan import bucketed_before, prefix_sums
from depotry.schema import RUPEE, Profile
from depotry.storage import cut

#: Sites of one plan that travel as one array beside each of its points; more go through the grid.
MOST_IN_ARRAY = 512
#: Sites in a grid cell, about; cells of a level side by side in one of the next; cells of the widest level.
SITES_A_CELL, GRID_STEP, TOP_CELLS = 4, 4, 16
#: Sites of a data set that the greedy assignment ranks for a point; how many of them a point looks at first.
MOST_RANKED, WAYS_FIRST = 4096, 8
#: Turns of a part: groups of points are cut there, so that no row holds more; places times ranks up to which all places are widened at once.
PART, MOST_WIDENED = 1 << 20, 1_000_000
_OPEN = (1 << 63) - 1
_TOLD, _ENDS = "array<struct<x: bigint, over: boolean, turns: array<bigint>>>", "array<struct<t: bigint, i: bigint>>"
_FILLED = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("r", pa.int64()), ("i", pa.int64())]))]


def distances(points: DataFrame, sites: DataFrame, profile: Profile = RUPEE) -> DataFrame:
    """Every (point, site) pair of a data set with ``dist_km``; an equi-join on the data set."""
    s = sites.select("dataset", "wh_ord", "wh_id", F.col("lat").alias("wh_lat"), F.col("lon").alias("wh_lon"))
    return points.join(s, "dataset").withColumn("dist_km", haversine(F.col("lat"), F.col("lon"), F.col("wh_lat"), F.col("wh_lon"), profile))


def nearest(points: DataFrame, sites: DataFrame, profile: Profile = RUPEE, plan: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Each point with its nearest site of its plan (the first of equals): wh_ord, wh_id, wh_lat, wh_lon, dist_km.

    A plan's sites are one array row, so the points are never shuffled when the plans are few;
    the distance test runs over the array in the JVM. Plans of more than MOST_IN_ARRAY sites
    raise: use ``nearest_of_many``.
    """
    packed = sites.groupBy(*plan).agg(F.collect_list(F.struct("wh_ord", "wh_id", F.col("lat").alias("wh_lat"), F.col("lon").alias("wh_lon"))).alias("_sites"))
    bounded = packed.withColumn("_sites", F.when(F.size("_sites") <= MOST_IN_ARRAY, F.col("_sites")).otherwise(F.raise_error(F.lit("too many sites in a plan: use nearest_of_many"))))

    def measured(s):  # noqa: ANN001, ANN202
        return F.struct(haversine(F.col("lat"), F.col("lon"), s["wh_lat"], s["wh_lon"], profile).alias("dist_km"), s["wh_ord"].alias("wh_ord"), s["wh_id"].alias("wh_id"), s["wh_lat"].alias("wh_lat"), s["wh_lon"].alias("wh_lon"))

    best = points.join(bounded, list(plan)).withColumn("_best", F.array_min(F.transform("_sites", measured)))
    return best.select(*points.columns, *(F.col(f"_best.{c}") for c in ("wh_ord", "wh_id", "wh_lat", "wh_lon", "dist_km")))


def _degree(profile: Profile) -> float:
    """Kilometres of a degree of latitude."""
    return profile.radius_km * math.pi / 180


def _box_km(lat: Column, lon: Column, box: Column, profile: Profile) -> Column:
    """No site in the box (south, north, west, east) is nearer than this to the point."""
    up = F.radians(F.greatest(box["south"] - lat, lat - box["north"], F.lit(0.0)))
    # Longitudes meet again after 360 degrees; at half of that no gap is wider.
    gap = F.greatest(F.least(*(F.greatest(box["west"] + turn - lon, lon - box["east"] - turn, F.lit(0.0)) for turn in (-360.0, 0.0, 360.0))), F.lit(0.0))
    wide = F.sin(F.radians(F.least(gap, F.lit(180.0))) / 2)
    narrow = F.least(F.cos(F.radians(box["south"])), F.cos(F.radians(box["north"])))
    h = F.pow(F.sin(up / 2), F.lit(2)) + F.greatest(F.cos(F.radians(lat)) * narrow, F.lit(0.0)) * wide * wide
    return 2 * profile.radius_km * F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (1 - 1e-9) - 1e-9


def _spot(step: float, lat: str = "lat", lon: str = "lon") -> list[Column]:
    return [F.floor(F.col(c) / F.lit(step)).cast("long") for c in (lat, lon)]


def nearest_of_many(points: DataFrame, sites: DataFrame, profile: Profile = RUPEE) -> DataFrame:
    """``nearest`` for one large set of sites: an equi-join on grid cells, and for what that leaves open a search from wide cells to narrow ones.

    Cells are so wide that one holds about SITES_A_CELL sites. A point looks at the sites of its
    own and the eight cells around it; what it finds is final when nothing outside that block can
    be nearer. The others (far from all sites, or near the edge of the map) go down a pyramid of
    cells GRID_STEP times as narrow at each level, and keep those cells alone that could hold a
    site nearer than the nearest they know of. Sites at one place count once, the first of them.
    Points must have an ``ord`` of their own.
    """
    s = sites.groupBy(F.col("lat").alias("wh_lat"), F.col("lon").alias("wh_lon")).agg(F.min(F.struct("wh_ord", "wh_id")).alias("_s")).select("_s.*", "wh_lat", "wh_lon")
    s = cut(s)
    size = s.agg(F.count(F.lit(1)).alias("n"), F.min("wh_lat").alias("south"), F.max("wh_lat").alias("north"), F.min("wh_lon").alias("west"), F.max("wh_lon").alias("east")).first()
    if not size["n"]:
        return nearest(points, sites, profile)
    high, wide = max(size["north"] - size["south"], 1e-6), max(size["east"] - size["west"], 1e-6)
    step = max(1e-6, min(45.0, math.sqrt(high * wide * SITES_A_CELL / size["n"])))

    around = F.sequence(F.lit(-1), F.lit(1))
    row, col = _spot(step)
    asked = points.withColumn("_dr", F.explode(around)).withColumn("_dc", F.explode(around)).withColumn("_r", row + F.col("_dr")).withColumn("_c", col + F.col("_dc"))
    row, col = _spot(step, "wh_lat", "wh_lon")
    held = s.withColumn("_r", row).withColumn("_c", col)
    found = F.struct(haversine(F.col("lat"), F.col("lon"), F.col("wh_lat"), F.col("wh_lon"), profile).alias("dist_km"), "wh_ord", "wh_id", "wh_lat", "wh_lon")
    met = asked.join(held, ["_r", "_c"], "left").groupBy(*points.columns).agg(F.min(F.when(F.col("wh_ord").isNotNull(), found)).alias("_b"))
    # Outside the block a site is a cell away in latitude, or in longitude within two cells of latitude.
    beside = F.cos(F.radians("lat")) * F.cos(F.radians(F.least(F.abs("lat") + 2 * step, F.lit(90.0))))
    clear = F.least(F.lit(step * _degree(profile)), 2 * profile.radius_km * F.asin(F.sqrt(F.greatest(beside, F.lit(0.0))) * F.sin(F.radians(F.lit(step)) / 2)))
    sure = (F.abs("lon") + 2 * step < 180) & (F.col("_b.dist_km") < clear * (1 - 1e-9))
    met = cut(met.withColumn("_sure", F.coalesce(sure, F.lit(False))))
    ready = met.where("_sure").select(*points.columns, "_b.wh_ord", "_b.wh_id", "_b.wh_lat", "_b.wh_lon", "_b.dist_km")
    left = met.where("NOT _sure").drop("_sure")
    return ready.unionByName(_descended(left, points.columns, held, step, profile)) if left.limit(1).count() else ready


def _descended(left: DataFrame, columns: list[str], held: DataFrame, step: float, profile: Profile) -> DataFrame:
    """The nearest site of every point of ``left`` (with ``_b``, the nearest known so far, or null)."""
    box = F.struct(F.min("wh_lat").alias("south"), F.max("wh_lat").alias("north"), F.min("wh_lon").alias("west"), F.max("wh_lon").alias("east"))
    site = F.struct("wh_ord", "wh_id", "wh_lat", "wh_lon")
    levels = [cut(held.groupBy("_r", "_c").agg(box.alias("box"), F.min(site).alias("rep")))]
    while levels[-1].count() > TOP_CELLS:
        up = levels[-1].groupBy(F.floor(F.col("_r") / GRID_STEP).cast("long").alias("_r"), F.floor(F.col("_c") / GRID_STEP).cast("long").alias("_c"))
        merged = F.struct(*(f(f"box.{c}").alias(c) for c, f in (("south", F.min), ("north", F.max), ("west", F.min), ("east", F.max))))
        levels.append(cut(up.agg(merged.alias("box"), F.min("rep").alias("rep"))))
    top = levels.pop()
    open_ = cut(left).withColumn("_cell", F.explode(F.array(*(F.struct(F.lit(r["_r"]).alias("_r"), F.lit(r["_c"]).alias("_c")) for r in top.select("_r", "_c").collect()))))  # TOP_CELLS at most
    open_ = open_.select(*columns, "_b", F.col("_cell._r").alias("_pr"), F.col("_cell._c").alias("_pc"))

    def measured(s: Column) -> Column:
        km = haversine(F.col("lat"), F.col("lon"), s["wh_lat"], s["wh_lon"], profile)
        return F.struct(km.alias("dist_km"), s["wh_ord"].alias("wh_ord"), s["wh_id"].alias("wh_id"), s["wh_lat"].alias("wh_lat"), s["wh_lon"].alias("wh_lon"))

    each = Window.partitionBy("dataset", "ord")
    for level in reversed(levels):
        below = level.withColumn("_pr", F.floor(F.col("_r") / GRID_STEP).cast("long")).withColumn("_pc", F.floor(F.col("_c") / GRID_STEP).cast("long"))
        seen = open_.join(below, ["_pr", "_pc"]).withColumn("_b", F.min(F.least(F.coalesce("_b", measured(F.col("rep"))), measured(F.col("rep")))).over(each))
        open_ = cut(seen.where(_box_km(F.col("lat"), F.col("lon"), F.col("box"), profile) <= F.col("_b.dist_km")).select(*columns, "_b", F.col("_r").alias("_pr"), F.col("_c").alias("_pc")))
    last = open_.join(held.withColumnsRenamed({"_r": "_pr", "_c": "_pc"}), ["_pr", "_pc"])
    best = last.groupBy(*columns).agg(F.min(measured(F.struct("wh_ord", "wh_id", "wh_lat", "wh_lon"))).alias("_b"))
    return best.select(*columns, "_b.wh_ord", "_b.wh_id", "_b.wh_lat", "_b.wh_lon", "_b.dist_km")


def lookup(assigned: DataFrame, sites: DataFrame, plan: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Assignments (id, wh_id) with their sites' positions; unknown sites drop out."""
    s = sites.select(*plan, "wh_id", F.col("lat").alias("wh_lat"), F.col("lon").alias("wh_lon"))
    return assigned.join(s, [*plan, "wh_id"])


def unknown_sites(assigned: DataFrame, sites: DataFrame, plan: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Assignments to sites that the plan does not have."""
    return assigned.join(sites.select(*plan, "wh_id"), [*plan, "wh_id"], "left_anti")


def unseeded(points: DataFrame, seeds: DataFrame) -> DataFrame:
    """Points at places where no seed stands yet."""
    return points.join(seeds.select("dataset", "lat", "lon"), ["dataset", "lat", "lon"], "left_anti")


def used_sites(assigned: DataFrame, plan: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """(plan, used): how many sites serve a point."""
    return assigned.groupBy(*plan).agg(F.countDistinct("wh_id").alias("used"))


def loads(assigned: DataFrame, sites: DataFrame, plan: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Orders of every site, zero for sites without points."""
    own = assigned.groupBy(*plan, "wh_id").agg(F.sum("orders").alias("load"))
    return sites.select(*plan, "wh_ord", "wh_id").join(own, [*plan, "wh_id"], "left").withColumn("load", F.coalesce("load", F.lit(0)).cast("long"))


def over_capacity(load: DataFrame, capacity: int | None, plan: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """(plan, over_capacity): always an array, empty where nothing overflows or there is no limit."""
    over = F.when(F.col("load") > F.lit(capacity), F.col("wh_id")) if capacity else F.lit(None).cast("string")
    return load.groupBy(*plan).agg(F.array_sort(F.collect_list(over)).alias("over_capacity"))


def out_of_radius(assigned: DataFrame, limit_km: float | None, road_factor: float, profile: Profile = RUPEE) -> DataFrame:
    """Points beyond the limit; a flag, assignments stay."""
    km = F.col("dist_km") * (road_factor if profile.radius_on_road else 1.0)
    return assigned.where(km > F.lit(limit_km)) if limit_km else assigned.limit(0)


def ranked_sites(points: DataFrame, sites: DataFrame, profile: Profile = RUPEE) -> DataFrame:
    """All sites of every point by distance, first of equals first."""
    order = Window.partitionBy("dataset", "ord").orderBy("dist_km", "wh_ord")
    return distances(points, sites, profile).withColumn("rank", F.row_number().over(order))


def relabel(load: DataFrame, sites: DataFrame, plan: tuple[str, ...] = ("dataset",), stable: bool = True) -> DataFrame:
    """(plan, wh_id, label): W1.. by falling load; ties by site order, or by position if not ``stable``."""
    ties = ("wh_ord",) if stable else ("lat", "lon")
    order = Window.partitionBy(*plan).orderBy(F.desc("load"), *ties)
    placed = load.join(sites.select(*plan, "wh_id", "lat", "lon"), [*plan, "wh_id"])
    return placed.select(*plan, "wh_id", "load", F.concat(F.lit("W"), F.row_number().over(order)).alias("label"))


def greedy_capacity(points: DataFrame, sites: DataFrame, capacity: int | None, profile: Profile = RUPEE, taken: DataFrame | None = None) -> DataFrame:
    """(dataset, ord, id, wh_id, dist_km): largest orders first, each to the nearest site with room, else to the nearest.

    What a point gets depends on all before it, yet it is worked out for all at once: every round
    takes the choices of the last as given, sums at every site what earlier points take there, and
    lets each point choose anew. A point's choice is final once all before it stand still, and when
    nothing moves any more all choices are those of the points in turn. Rounds follow the chains of
    points that push one another away (tens, as measured), not the number of points. Points that
    are settled leave the rounds as a sum at their site. Points look at their ``WAYS_FIRST`` nearest
    sites and at more only if those are full. Up to MOST_RANKED sites a data set; more raise: use
    ``greedy_of_many``. ``taken`` (dataset,
    site, taken) is what sites hold before, by their place in order from 0.
    """
    packed = sites.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("wh_ord", "wh_id", "lat", "lon"))).alias("_sites"))
    packed = cut(packed.withColumn("_sites", F.when(F.size("_sites") <= MOST_RANKED, F.col("_sites")).otherwise(F.raise_error(F.lit("too many sites for a greedy assignment")))))
    ways = F.transform("_sites", lambda s, i: F.struct(haversine(F.col("lat"), F.col("lon"), s["lat"], s["lon"], profile).alias("km"), s["wh_ord"].alias("wh_ord"), i.cast("long").alias("i"), s["wh_id"].alias("wh_id")))

    def nearest_ways(reach: Column) -> Column:
        return F.slice(F.array_sort(ways), F.lit(1), reach)

    def more(told: DataFrame) -> DataFrame:
        return told.join(packed, "dataset").withColumn("_ways", F.when(F.col("_short"), nearest_ways(F.size("_ways") * 4)).otherwise(F.col("_ways")))

    start = _in_turn(points).join(packed, "dataset").withColumn("_n", F.size("_sites").cast("long")).withColumn("_ways", nearest_ways(F.lit(WAYS_FIRST)))
    return _greedy(start.drop("_sites"), capacity, taken, more)


def greedy_of_many(points: DataFrame, sites: DataFrame, capacity: int | None, profile: Profile = RUPEE, taken: DataFrame | None = None) -> DataFrame:
    """``greedy_capacity`` for any number of points and sites, place by place.

    Points of one place with equal orders (a group) look at the same places in the same order, and sites of one
    place fill in their order, so a round needs no pairs of points and sites: groups tell the places that they
    look at who comes, a place works out from their numbers at which turn each of its sites closes for each size
    of orders, and groups choose anew by these turns. Rounds follow the chains of places that push points on to one
    another, not the sites of a place. Places that tie are compared by the site that is open in turn. Time follows
    the pairs of different places (``_nearest_places``) and rounds. Points without a position or with no or negative
    orders are an error.
    """
    number = prefix_sums(sites.select("dataset", "wh_ord", "wh_id", "lat", "lon"), ["dataset"], ["wh_ord", "wh_id", "lat", "lon"], {"i": F.lit(1).cast("long")})
    held = cut(number.withColumn("i", F.col("i") - 1))
    room = held.withColumn("room", F.lit(capacity or 0).cast("long"))
    if taken is not None:
        room = room.join(taken.select("dataset", F.col("site").alias("i"), "taken"), ["dataset", "i"], "left").withColumn("room", F.col("room") - F.coalesce("taken", F.lit(0)))
    spots = cut(room.groupBy("dataset", "lat", "lon").agg(F.min("i").alias("cand_ord"), F.array_sort(F.collect_list(F.struct("i", "room"))).alias("_own")))
    sizes = spots.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    placed = [F.when(F.col("lat").isNull() | F.col("lon").isNull(), F.raise_error(F.lit("a point has no position")).cast("double")).otherwise(F.col(c)).alias(c) for c in ("lat", "lon")]
    size = F.when(F.col("orders") >= 0, F.col("orders")).otherwise(F.raise_error(F.lit("a point has no or negative orders")).cast("long")).cast("long")
    turns = cut(_in_turn(points).select("dataset", "ord", "id", *placed, size.alias("orders"), "_pos"))

    groups = turns.groupBy("dataset", "lat", "lon", "orders", F.floor(F.col("_pos") / PART).alias("part")).agg(F.array_sort(F.collect_list("_pos")).alias("turns"))
    near = _nearest_places(turns.select("dataset", "lat", "lon").distinct().withColumn("want", F.lit(WAYS_FIRST)), spots, profile).drop("want")
    state = groups.join(sizes, "dataset").join(near, ["dataset", "lat", "lon"]).select("*", F.lit(1).cast("long").alias("look"), F.expr(f"CAST(array() AS {_TOLD})").alias("told"), F.lit(True).alias("moved"), F.lit(False).alias("short"))
    state, closings = cut(_told(state, None)), None
    while capacity:
        moving = state.agg(F.max("moved").alias("moved"), F.max(F.col("short") & (F.col("look") > F.size("ranks")) & (F.size("ranks") < F.col("n"))).alias("wide")).first()
        if not moving["moved"]:
            break
        if moving["wide"]:
            state = _widened(state, spots, profile)
        closings = cut(_closings(state, spots))
        state = cut(_told(state, closings))

    came = state.select("dataset", "orders", F.explode("told").alias("t")).select("dataset", "orders", "t.*")
    if closings is not None:
        came = came.join(closings, ["dataset", "x", "orders"], "left")
        site = F.when(F.col("over"), F.col("x")).otherwise(F.get(F.filter("ends", lambda e: e["t"] >= F.col("_pos")), F.lit(0))["i"])
    else:
        site = F.col("x")
    chosen = came.withColumn("_pos", F.explode("turns")).select("dataset", "_pos", site.alias("i"))
    at = held.select("dataset", "i", "wh_id", F.col("lat").alias("_a"), F.col("lon").alias("_b"))
    km = haversine(F.col("lat"), F.col("lon"), F.col("_a"), F.col("_b"), profile)
    return turns.join(chosen, ["dataset", "_pos"]).join(at, ["dataset", "i"]).select("dataset", "ord", "id", "wh_id", km.alias("dist_km"))


def _told(state: DataFrame, closings: DataFrame | None) -> DataFrame:
    """``state`` after each group has chosen anew: ``told`` has what it tells each place it looks at, ``moved`` whether that changed.

    A group looks at its nearest ``look`` places and their ties. A place without ``closings`` counts as open.
    What finds no room there looks further from the next round on (``short``); if there is nothing further, it goes
    to the nearest site all the same (``over``).
    """
    by = ["dataset", "lat", "lon", "orders", "part"]
    seen = F.filter("ranks", lambda r: r["km"] <= F.element_at("ranks", F.least(F.col("look").cast("int"), F.size("ranks")))["km"])
    state = state.withColumn("_seen", seen)
    if closings is not None:
        asked = state.select(*by, F.explode("_seen").alias("r")).select(*by, "r.*").join(closings, ["dataset", "x", "orders"], "left")
        met = asked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("km", "x", "ends"))).alias("_met"))
        state = state.join(met, by)
    else:
        state = state.withColumn("_met", F.transform("_seen", lambda r: F.struct(r["km"].alias("km"), r["x"].alias("x"), F.lit(None).cast(_ENDS).alias("ends"))))
    state = state.withColumn("_last", F.size("_seen") >= F.col("n")).drop("_seen")
    kept = [*by, "n", "ranks", "look", "turns"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = {c: b.column(i) for i, c in enumerate([*kept, "_met", "_last"])}
            at, flat = column["turns"].offsets.to_numpy(), column["turns"].values.to_numpy()
            sizes, x, over, parts, short = [0], [], [], [], []
            for r, (met, last) in enumerate(zip(column["_met"].to_pylist(), column["_last"].to_pylist(), strict=True)):
                turns, lo = flat[at[r] : at[r + 1]], 0
                for j, place in enumerate(met):
                    if j and place["km"] == met[j - 1]["km"]:
                        continue
                    tier = [(p["x"], [(_OPEN, p["x"])] if p["ends"] is None else [(e["t"], e["i"]) for e in p["ends"]]) for p in met[j:] if p["km"] == place["km"]]
                    till = max([e[-1][0] for _, e in tier if e], default=0)
                    hi = lo + int(np.searchsorted(turns[lo:], till, "right"))
                    mine = turns[lo:hi]
                    if len(tier) == 1:
                        came = [mine]
                    else:
                        first = np.stack([np.array([i for _, i in e] + [_OPEN])[np.searchsorted([t for t, _ in e], mine)] for _, e in tier])
                        came = [mine[first.argmin(0) == k] for k in range(len(tier))]
                    x += [p for p, _ in tier]
                    over += [False] * len(tier)
                    parts += came
                    lo = hi
                short.append(lo < len(turns) and not last)
                if lo < len(turns) and last:
                    x.append(min(p["x"] for p in met if p["km"] == met[0]["km"]))
                    over.append(True)
                    parts.append(turns[lo:])
                sizes.append(len(x))
            ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            turns = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int64()))
            told = pa.StructArray.from_arrays([pa.array(x, pa.int64()), pa.array(over, pa.bool_()), turns], ["x", "over", "turns"])
            told = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), told)
            yield pa.RecordBatch.from_arrays([*(column[c] for c in by), told, pa.array(short, pa.bool_())], [*by, "_new", "short"])

    types = {f.name: f.dataType.simpleString() for f in state.schema}
    new = state.select(*kept, "_met", "_last").mapInArrow(choose, ", ".join(f"{c} {types[c]}" for c in by) + f", _new {_TOLD}, short boolean")
    out = state.drop("_met", "_last", "moved", "short").join(new, by)
    moved = F.col("short") | (F.col("_new") != F.col("told"))
    return out.select(*kept, F.col("_new").alias("told"), moved.alias("moved"), "short").withColumn("look", F.when(F.col("short"), F.col("look") * 4).otherwise(F.col("look")))


def _closings(state: DataFrame, spots: DataFrame) -> DataFrame:
    """(dataset, x, orders, ends): the sites of a place that points of this size meet open, in order, each with the last turn that finds it so."""
    by = ["dataset", "x", "orders", "part"]
    came = state.select("dataset", "orders", "part", F.explode("told").alias("t")).select(*by[:1], "t.x", *by[2:], "t.over", "t.turns")
    all_ = F.array_sort(F.flatten(F.collect_list(F.when(~F.col("over"), F.col("turns")))))
    came = cut(came.groupBy(*by).agg(all_.alias("all"), F.sum(F.when(F.col("over"), F.size("turns")).otherwise(0)).alias("over")))
    level = F.struct((-F.col("orders")).alias("q"), "part", F.size("all").cast("long").alias("n"), "over")
    filled = came.groupBy("dataset", "x").agg(F.array_sort(F.collect_list(level)).alias("levels")).join(spots.select("dataset", F.col("cand_ord").alias("x"), "_own"), ["dataset", "x"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                own = b.column(3).slice(r, 1).flatten()
                sites, room = (np.array(own.field(c).to_numpy()) for c in ("i", "room"))
                levels = [np.array(b.column(2).slice(r, 1).flatten().field(c).to_numpy()) for c in ("q", "part", "n", "over")]
                edges = np.flatnonzero(np.diff(levels[0], prepend=levels[0][0] - 1)).tolist() + [len(levels[0])]
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    q, upto = -int(levels[0][a]), np.cumsum(levels[2][a:z])
                    total = int(upto[-1])
                    takes = np.where(room >= q, np.minimum(room // max(q, 1), total + 1) if q else total + 1, 0)
                    till = np.cumsum(takes)
                    used = np.flatnonzero(takes)
                    full = used[till[used] <= total]
                    ends = [[] for _ in range(a, z)]
                    for k, rank in zip(np.searchsorted(upto, till[full]).tolist(), zip(till[full].tolist(), sites[full].tolist(), strict=True), strict=True):
                        ends[k].append({"r": rank[0] - (int(upto[k - 1]) if k else 0), "i": rank[1]})
                    if len(full) < len(used):
                        ends[-1].append({"r": 0, "i": int(sites[used[len(full)]])})
                    rows += [(b.column(0)[r].as_py(), b.column(1)[r].as_py(), q, int(levels[1][a + k]), e) for k, e in enumerate(ends)]
                    room = room - q * np.clip(total - (till - takes), 0, takes)
                    room[0] -= q * int(levels[3][a:z].sum())  # those who find no room anywhere
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FILLED, strict=True)], [*by, "at"])

    told = filled.select("dataset", "x", "levels", "_own").mapInArrow(fill, "dataset string, x long, orders long, part long, at array<struct<r: bigint, i: bigint>>")
    ends = F.transform("at", lambda e: F.struct(F.when(e["r"] == 0, F.lit(_OPEN)).otherwise(F.element_at("all", e["r"].cast("int"))).alias("t"), e["i"].alias("i")))
    return came.join(told, by).groupBy("dataset", "x", "orders").agg(F.array_sort(F.flatten(F.collect_list(ends))).alias("ends"))


def _widened(state: DataFrame, spots: DataFrame, profile: Profile) -> DataFrame:
    """``state`` with more ``ranks`` where groups look further than these go; everywhere if that makes MOST_WIDENED entries at most."""
    want = F.col("short") & (F.col("look") > F.size("ranks")) & (F.size("ranks") < F.col("n"))
    asked = state.where(want).groupBy("dataset", "lat", "lon").agg((8 * F.max("look")).cast("int").alias("want"))
    most, every = asked.agg(F.max("want")).first()[0], state.select("dataset", "lat", "lon").distinct()
    if every.count() * most <= MOST_WIDENED:
        asked = every.withColumn("want", F.lit(most))
    found = _nearest_places(asked, spots, profile).select("dataset", "lat", "lon", F.col("ranks").alias("_more"))
    return cut(state.join(found, ["dataset", "lat", "lon"], "left").withColumn("ranks", F.when(F.size("_more") > F.size("ranks"), F.col("_more")).otherwise(F.col("ranks"))).drop("_more"))


def _nearest_places(places: DataFrame, spots: DataFrame, profile: Profile) -> DataFrame:
    """``places`` (dataset, lat, lon, want) with ``ranks``: km and number (x) of the nearest ``want`` spots and of what ties with the last, in order.

    A block of places keeps, of each block of spots, the nearest ``want`` and what ties with them.
    """
    from depotry.operators.interchange import PLACES, blocks, meeting, numbers
    from depotry.operators.interchange import spots as positions
    from depotry.operators.solve import Metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                rows, there = b.column(1).slice(r, 1).flatten(), b.column(2).slice(r, 1).flatten()
                km, n = Metric(*positions(rows).T, profile).to(positions(there)), np.minimum(numbers(rows, "want").astype(int), len(there))
                last = np.sort(km, axis=1)[np.arange(len(n)), n - 1]
                i, j = np.nonzero(km <= last[:, None] * (1 + 1e-9) + 1e-9)
                i, j = pa.array(i), pa.array(j)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[r], len(i)), *(rows.field(c).take(i) for c in ("lat", "lon", "want")), there.field("cand_ord").take(j)], ["dataset", "lat", "lon", "want", "cand_ord"])

    met = meeting(cut(blocks(places)), spots.select("dataset", "cand_ord", "lat", "lon"), PLACES).select("dataset", "_places", "_candidates")
    near = met.mapInArrow(run, "dataset string, lat double, lon double, want int, cand_ord long")
    where = spots.select("dataset", "cand_ord", F.col("lat").alias("_a"), F.col("lon").alias("_b"))
    by = ["dataset", "lat", "lon", "want"]
    near = near.join(where, ["dataset", "cand_ord"]).select(*by, F.struct(haversine(F.col("lat"), F.col("lon"), F.col("_a"), F.col("_b"), profile).alias("km"), F.col("cand_ord").alias("x")).alias("s"))
    near = near.groupBy(*by).agg(F.array_sort(F.collect_list("s")).alias("s"))
    far = F.element_at("s", F.least(F.col("want"), F.size("s")))["km"]
    return near.withColumn("_far", far).select(*by, F.filter("s", lambda s: s["km"] <= F.col("_far")).alias("ranks"))


def _in_turn(points: DataFrame) -> DataFrame:
    """Points with their place in the order of serving (``_pos``, from 1)."""
    return prefix_sums(points.select("dataset", "ord", "id", "lat", "lon", "orders"), ["dataset"], [F.desc("orders"), "ord"], {"_pos": F.lit(1).cast("long")})


def _greedy(start: DataFrame, capacity: int | None, taken: DataFrame | None, more: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rounds. ``start`` has each point's nearest sites (``_ways``) of all (``_n``); ``more`` widens ``_ways`` where ``_short``."""

    def chosen(state: DataFrame) -> DataFrame:
        return state.withColumn("_way", F.element_at("_ways", F.col("pick") + 1)).select("dataset", "ord", "id", F.col("_way.wh_id").alias("wh_id"), F.col("_way.km").alias("dist_km"))

    state = start.withColumn("pick", F.lit(0)).withColumn("moved", F.lit(True))
    if not capacity:
        return chosen(state)
    state, done = cut(state), []
    gone = taken  # and what settled points hold
    active = state.count()
    last = state.agg(F.max("_pos")).first()[0] or 0
    while active:
        options = state.select("dataset", "_pos", "orders", "pick", F.posexplode("_ways").alias("j", "w"))
        rows = options.select("dataset", F.col("w.i").alias("site"), "_pos", "orders", "j", F.when(F.col("j") == F.col("pick"), F.col("orders")).otherwise(F.lit(0)).alias("taken"))
        if gone is not None:
            rows = rows.unionByName(gone.select("dataset", "site", F.lit(0).cast("long").alias("_pos"), F.lit(0).cast("long").alias("orders"), F.lit(-1).alias("j"), "taken"))
        fits = bucketed_before(rows, ["dataset", "site"], "_pos", "taken", last).where((F.col("j") >= 0) & (F.col("before") + F.col("orders") <= capacity))
        best = fits.groupBy("dataset", "_pos").agg(F.min("j").alias("_best"))
        short = F.col("_best").isNull() & (F.size("_ways") < F.col("_n"))  # none so far, but there are sites left to look at
        pick = F.coalesce("_best", F.lit(0))
        told = state.drop("moved").join(best, ["dataset", "_pos"], "left").withColumn("_short", short).withColumn("moved", (pick != F.col("pick")) | F.col("_short")).withColumn("pick", pick)
        state = cut(more(told).select(*state.columns))
        # Places are dense, so what is settled of a data set is what lies before its first move.
        told = state.groupBy("dataset").agg(F.min(F.when(F.col("moved"), F.col("_pos"))).alias("_first"), F.min("_pos").alias("_low"), F.count(F.lit(1)).alias("_n"))
        settled = told.agg(F.sum(F.coalesce(F.col("_first") - F.col("_low"), F.col("_n")))).first()[0]
        if 2 * settled >= active:
            told = cut(state.join(told.select("dataset", "_first"), "dataset").withColumn("_final", F.col("_first").isNull() | (F.col("_pos") < F.col("_first"))))
            ready = told.where("_final").drop("_first", "_final")
            held = ready.groupBy("dataset", F.element_at("_ways", F.col("pick") + 1)["i"].alias("site")).agg(F.sum("orders").alias("taken"))
            gone = cut((held if gone is None else gone.select("dataset", "site", "taken").unionByName(held)).groupBy("dataset", "site").agg(F.sum("taken").alias("taken")))
            state, active = told.where("NOT _final").drop("_first", "_final"), active - settled
            done.append(ready)
    return chosen(reduce(DataFrame.unionByName, done, state))
