"""Placement by exchange: one site leaves for one candidate, the best pair of all, until no pair helps.

Every point knows its nearest and second nearest site. One pass over the points gives the profit of
every (candidate, site) pair: what points gain that are nearer to the candidate than to their
site, less what the points of the leaving site lose by going to their second site, plus what those
of them get back that have the candidate nearer than that. All three are sums by (candidate,
nearest site), so they are added up where the points lie and the points never move; a pass sends
candidates times sites rows a task at most. Points and candidates may be any number of data sets.

Points at one place count as one with their whole weight, candidates at one place as the first of
them: neither changes an exchange. Places meet candidates in blocks, so their numbers have no limit
but time, which follows the pairs of different places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotry.functions.geo import haversine
from depotry.operators import assign, solve
from depotry.operators.solve import Metric
from depotry.schema import RUPEE, Profile
from depotry.storage import cut

#: Candidates that lie beside a point as an array, and sites of a plan.
MOST_CANDIDATES, MOST_SITES = 4096, 512
#: Places and candidates of a block, pairs of a point and a candidate in a task (about), tasks, and candidates that are sent to all tasks.
PLACES, BLOCK, PAIRS, MOST_TASKS, MOST_SENT = 256, 1024, 2_000_000, 20_000, 1 << 20
SITE = ("wh_ord", "wh_id", "lat", "lon")


def _packed(rows: DataFrame, name: str, most: int, columns: tuple[str, ...]) -> DataFrame:
    """One array a data set, in order; more than ``most`` entries raise."""
    out = rows.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return out.withColumn(name, F.when(F.size(name) <= most, F.col(name)).otherwise(F.raise_error(F.lit(f"more than {most} {name.strip('_')}"))))


def _two_nearest(points: DataFrame, sites: DataFrame, profile: Profile) -> DataFrame:
    """``points`` with ``d1``, ``s1`` (nearest site, the first of equals) and ``d2`` (null for a single site)."""
    ways = F.array_sort(F.transform("_sites", lambda s: F.struct(haversine(F.col("lat"), F.col("lon"), s["lat"], s["lon"], profile).alias("km"), s["wh_ord"].alias("wh_ord"))))
    both = points.join(_packed(sites, "_sites", MOST_SITES, SITE), "dataset").withColumn("_w2", F.slice(ways, 1, 2))
    return both.withColumn("d1", F.col("_w2")[0]["km"]).withColumn("s1", F.col("_w2")[0]["wh_ord"]).withColumn("d2", F.get("_w2", F.lit(1))["km"]).drop("_w2")


def at_places(points: DataFrame, weight: str = "orders") -> DataFrame:
    """One point a place of a data set, with the weight of all points there."""
    return points.groupBy("dataset", "lat", "lon").agg(F.sum(weight).alias(weight))


def first_of_places(candidates: DataFrame) -> DataFrame:
    """The first candidate of each place of a data set."""
    return candidates.groupBy("dataset", "lat", "lon").agg(F.min("cand_ord").alias("cand_ord")).select("dataset", "cand_ord", "lat", "lon")


def spots(rows: pa.Array) -> np.ndarray:
    """(n, 2) positions of structs with lat and lon."""
    return np.stack([numbers(rows, c) for c in ("lat", "lon")], axis=1)


def numbers(rows: pa.Array, column: str) -> np.ndarray:
    """A field of structs as doubles; null is NaN."""
    return np.asarray(rows.field(column).to_numpy(zero_copy_only=False), float)


def blocks(places: DataFrame) -> DataFrame:
    """(dataset, _places): about PLACES rows of ``places`` in each array."""
    number = F.pmod(F.xxhash64("lat", "lon"), F.lit(max(1, -(-places.count() // PLACES)))).alias("_block")
    return places.groupBy("dataset", number).agg(F.collect_list(F.struct(*(c for c in places.columns if c != "dataset"))).alias("_places")).drop("_block")


def meeting(points: DataFrame, candidates: DataFrame, each: int = 1) -> DataFrame:
    """``points`` beside every block of candidates of their data set (``_candidates``), in tasks of about PAIRS pairs.

    ``each`` is how many points a row stands for. Up to MOST_SENT candidates are broadcast; more are dealt with the points.
    """
    n, m = points.count(), candidates.count()
    tasks = max(1, min(n, -(-n * each * m // PAIRS), MOST_TASKS))
    number = F.pmod(F.xxhash64("cand_ord"), F.lit(max(1, -(-m // BLOCK)))).alias("_block")
    packed = candidates.groupBy("dataset", number).agg(F.collect_list(F.struct("cand_ord", "lat", "lon")).alias("_candidates")).drop("_block")
    if m <= MOST_SENT:
        return points.repartition(tasks).join(F.broadcast(packed), "dataset")
    dealt = points.withColumn("_task", F.pmod(F.xxhash64(*points.columns), F.lit(tasks)))
    return dealt.join(packed.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))), ["dataset", "_task"]).drop("_task")


def swap_profits(points: DataFrame, sites: DataFrame, candidates: DataFrame, weight: str = "orders", profile: Profile = RUPEE) -> DataFrame:
    """(dataset, cand_ord, wh_ord, profit) of every exchange of a site for a candidate; ``candidates`` has dataset, cand_ord, lat, lon.

    A single site has no second one: its points go to the candidate whatever it costs.
    """
    w = F.col(weight).cast("double")
    near = _two_nearest(points, sites, profile).withColumn("w", w)
    held = near.join(_packed(candidates, "_candidates", MOST_CANDIDATES, ("cand_ord", "lat", "lon")), "dataset")
    met = held.select("dataset", "w", "d1", "d2", "s1", F.explode(F.transform("_candidates", lambda c: F.struct(c["cand_ord"].alias("cand_ord"), haversine(F.col("lat"), F.col("lon"), c["lat"], c["lon"], profile).alias("km")))).alias("c"))
    met = met.where("d2 IS NULL OR c.km < d2")  # others neither gain nor have it as their refuge
    gain = F.when(F.col("c.km") < F.col("d1"), F.col("w") * (F.col("d1") - F.col("c.km"))).otherwise(F.lit(0.0))
    # What staying with the candidate saves the point if its own site leaves: against d2, or against nothing if there is none.
    back = F.when(F.col("d2").isNull(), F.col("w") * (F.col("d1") - F.col("c.km")) - gain).otherwise(F.col("w") * (F.col("d2") - F.greatest("c.km", "d1")))
    pairs = met.groupBy("dataset", F.col("c.cand_ord").alias("cand_ord"), F.col("s1").alias("wh_ord")).agg(F.sum(gain).alias("_gain"), F.sum(back).alias("_back"))
    return _profits(near, pairs, sites, candidates)


def swap_profits_of_many(points: DataFrame, sites: DataFrame, candidates: DataFrame, weight: str = "orders", profile: Profile = RUPEE) -> DataFrame:
    """``swap_profits`` for any number of candidates: blocks of points meet blocks of candidates, and a block adds up by candidate and site."""
    near = cut(_two_nearest(points, sites, profile).select("dataset", "lat", "lon", F.col(weight).cast("double").alias("w"), "d1", "s1", "d2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, there = b.column(1).slice(i, 1).flatten(), b.column(2).slice(i, 1).flatten()
                w, d1, d2 = (numbers(rows, c)[:, None] for c in ("w", "d1", "d2"))
                km, at = Metric(*spots(rows).T, profile).to(spots(there)), rows.field("s1").to_numpy(zero_copy_only=False)
                gain = w * np.maximum(0.0, d1 - km)
                back = np.where(np.isnan(d2), w * (d1 - km) - gain, w * np.maximum(0.0, d2 - np.maximum(km, d1)))
                for s in np.unique(at):
                    yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(there)), there.field("cand_ord"), pa.repeat(pa.scalar(int(s), pa.int64()), len(there)), pa.array(gain[at == s].sum(0)), pa.array(back[at == s].sum(0))], ["dataset", "cand_ord", "wh_ord", "_gain", "_back"])

    known = near.where("d1 IS NOT NULL AND w IS NOT NULL")  # a point without a place or weight adds nothing to any sum
    met = meeting(cut(blocks(known)), candidates, PLACES).select("dataset", "_places", "_candidates")
    pairs = met.mapInArrow(run, "dataset string, cand_ord long, wh_ord long, _gain double, _back double")
    return _profits(near, pairs.groupBy("dataset", "cand_ord", "wh_ord").agg(F.sum("_gain").alias("_gain"), F.sum("_back").alias("_back")), sites, candidates)


def _profits(near: DataFrame, pairs: DataFrame, sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """The profits, from points with their two nearest sites (``near``) and the sums by candidate and nearest site."""
    loss = near.groupBy("dataset", F.col("s1").alias("wh_ord")).agg(F.sum(F.col("w") * F.coalesce(F.col("d2") - F.col("d1"), F.lit(0.0))).alias("_loss"))
    every = candidates.select("dataset", "cand_ord").join(sites.select("dataset", "wh_ord"), "dataset")  # candidates times sites
    total = pairs.groupBy("dataset", "cand_ord").agg(F.sum("_gain").alias("_all"))
    out = every.join(pairs, ["dataset", "cand_ord", "wh_ord"], "left").join(total, ["dataset", "cand_ord"], "left").join(loss, ["dataset", "wh_ord"], "left")
    return out.select("dataset", "cand_ord", "wh_ord", (F.coalesce("_all", F.lit(0.0)) - F.coalesce("_loss", F.lit(0.0)) + F.coalesce("_back", F.lit(0.0))).alias("profit"))


def best_swaps(profits: DataFrame) -> DataFrame:
    """The most profitable exchange of each data set: the first candidate, then the first site of equals (to nine places)."""
    order = F.struct(-F.round("profit", 9), "cand_ord", "wh_ord", "profit")
    return profits.groupBy("dataset").agg(F.min(order).alias("b")).select("dataset", "b.cand_ord", "b.wh_ord", "b.profit")


def swapped(sites: DataFrame, swaps: DataFrame, candidates: DataFrame) -> DataFrame:
    """``sites`` after the exchanges: the candidate takes the number and name of the site that leaves."""
    to = swaps.select("dataset", "wh_ord", "cand_ord").join(candidates.select("dataset", "cand_ord", F.col("lat").alias("_a"), F.col("lon").alias("_b")), ["dataset", "cand_ord"])
    out = sites.select("dataset", *SITE).join(to, ["dataset", "wh_ord"], "left")
    return out.select("dataset", "wh_ord", "wh_id", F.coalesce("_a", "lat").alias("lat"), F.coalesce("_b", "lon").alias("lon"))


def interchange(points: DataFrame, sites: DataFrame, candidates: DataFrame, weight: str = "orders", profile: Profile = RUPEE, swaps: int | None = None, least: float = 1e-9) -> tuple[DataFrame, int]:
    """(sites, exchanges): the best exchange of each data set, again and again, until none gains more than ``least`` of the objective.

    ``swaps`` ends it earlier. Each exchange lowers the objective and plans are finite, so it ends;
    every pass is written and cut, a data set that stands still costs a look at its sites no more.
    """
    points, candidates = cut(at_places(points, weight)), cut(first_of_places(candidates))
    at, done, live = cut(sites.select("dataset", *SITE)), 0, points.select("dataset").distinct()
    while swaps is None or done < swaps:
        some = points.join(live, "dataset", "left_semi")
        now = assign.nearest(some, at, profile).groupBy("dataset").agg(F.sum(F.col(weight) * F.col("dist_km")).alias("_now"))
        best = cut(best_swaps(swap_profits_of_many(some, at, candidates, weight, profile)).join(now, "dataset").where(F.col("profit") > least * F.greatest("_now", F.lit(1.0))))
        if not best.limit(1).count():
            break
        at, live, done = cut(swapped(at, best, candidates)), best.select("dataset"), done + 1
    return at, done


def spread_candidates(points: DataFrame, most: int = 256, weight: str = "orders") -> DataFrame:
    """(dataset, cand_ord, lat, lon): places of the data set itself, heaviest of each cell of a grid of about ``most`` cells."""
    side = max(1, int(most**0.5))
    box = points.groupBy("dataset").agg(F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("lon").alias("_w"), F.max("lon").alias("_e"))

    def cell(c: str, low: str, high: str) -> Column:
        return F.least(F.floor((F.col(c) - F.col(low)) / F.greatest(F.col(high) - F.col(low), F.lit(1e-9)) * side), F.lit(side - 1))

    placed = points.join(box, "dataset").withColumn("_r", cell("lat", "_s", "_n")).withColumn("_c", cell("lon", "_w", "_e"))
    top = placed.groupBy("dataset", "_r", "_c").agg(F.max(F.struct(F.col(weight).cast("double").alias("w"), (-F.col("ord")).alias("o"), "lat", "lon")).alias("t"))
    number = F.row_number().over(Window.partitionBy("dataset").orderBy("_r", "_c")) - 1  # ``most`` rows a data set
    return top.select("dataset", number.cast("long").alias("cand_ord"), "t.lat", "t.lon")


def place(points: DataFrame, k: int, candidates: DataFrame | None = None, weight: str = "orders", profile: Profile = RUPEE) -> tuple[DataFrame, float]:
    """(sites, objective) of one large data set: the driver loop's plan, improved by exchanges with places of the points themselves.

    Exchanges start from the plan of ``solve_large`` and only lower its objective; where one was
    made, the centres are moved to their medians again and kept if that is better still.
    """
    points = cut(points.select("dataset", "ord", "lat", "lon", weight))  # worked out once, read by every pass
    data = points.select("dataset").first()
    if data is None:
        raise ValueError("there are no points")
    places = cut(at_places(points, weight))
    session, kinds = points.sparkSession, "dataset string, wh_ord long, wh_id string, lat double, lon double"

    def as_sites(centres: list[tuple[float, float]]) -> DataFrame:
        return session.createDataFrame([(data["dataset"], i, f"W{i + 1}", a, b) for i, (a, b) in enumerate(centres)], kinds)

    def cost_of(sites: DataFrame) -> float:
        return assign.nearest(places, sites, profile).agg(F.sum(F.col(weight) * F.col("dist_km"))).first()[0] or 0.0

    best = as_sites(solve.solve_large(points, k, weight, profile))
    sites, made = interchange(places, best, spread_candidates(points, weight=weight) if candidates is None else candidates, weight, profile)
    if not made:
        return best, cost_of(best)
    moved = as_sites(solve.refine_large(places, [(r["lat"], r["lon"]) for r in sites.orderBy("wh_ord").collect()], weight, profile))  # k rows
    options = sorted(((cost_of(s), i, s) for i, s in enumerate((best, sites, moved))), key=lambda x: x[:2])
    return options[0][2], options[0][0]
