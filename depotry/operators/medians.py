"""Geometric medians of all groups at once, as partial aggregates, to rest.

Each pass tries three places for every group and adds up, by place, the cost, the pull of the
points, where it pulls to and how it changes: where the last pass's best place was pulled to, a
Newton step from it, and the point nearest to it. The cheapest goes on, so costs never rise; the
Newton step ends the search in a few passes, and a median that is a point is met exactly. A place on
points is held back by their weight: where the others pull less than that, it is the median.
Points never move: places come to them as rows. Groups at rest leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotry.functions.geo import haversine
from depotry.operators.solve import ON_POINT
from depotry.schema import RUPEE, Profile
from depotry.storage import cut


def _summed(points: DataFrame, tries: DataFrame, by: list[str], profile: Profile) -> DataFrame:
    """The cheapest of each group's places, with the sums over its points; pulls go along great circles."""
    met = points.join(tries, by).select(*by, "lat", "lon", "_w", F.explode("tries").alias("t"))
    met = met.withColumn("_d", haversine(F.col("lat"), F.col("lon"), F.col("t.a"), F.col("t.b"), profile))
    here, there, turn = F.radians("t.a"), F.radians("lat"), F.radians(F.col("lon") - F.col("t.b"))
    east, north = F.sin(turn) * F.cos(there), F.cos(here) * F.sin(there) - F.sin(here) * F.cos(there) * F.cos(turn)
    size = F.hypot(east, north)
    on = (F.col("_d") < ON_POINT) | (size <= 0)
    pull, u, v = (F.when(on, F.lit(0.0)).otherwise(x) for x in (F.col("_w") / F.col("_d"), north / size, east / size))
    met = met.select(*by, "t", "_w", "_d", "lat", "lon", pull.alias("_p"), u.alias("_u"), v.alias("_v"), on.alias("_on"))
    w, p = F.col("_w"), F.col("_p")
    parts = {"cost": w * F.col("_d"), "s": p, "gn": w * F.col("_u"), "ge": w * F.col("_v"), "nn": p * (1 - F.col("_u") * F.col("_u")), "ne": -p * F.col("_u") * F.col("_v"), "ee": p * (1 - F.col("_v") * F.col("_v")), "here": F.when(F.col("_on"), w).otherwise(F.lit(0.0))}
    sums = met.groupBy(*by, "t").agg(*(F.sum(v).alias(c) for c, v in parts.items()), F.min(F.when(w > 0, F.struct("_d", "lat", "lon"))).alias("near"))
    best = F.min(F.struct("cost", "t.kind", "t.a", "t.b", *(c for c in parts if c != "cost"), "near")).alias("b")
    return sums.groupBy(*by).agg(best).select(*by, "b.*")


def _next(best: DataFrame, by: list[str], profile: Profile) -> DataFrame:
    """(by, a, b, moved, tries): the place, how far it is pulled in km, and the places to try next."""
    degree = F.radians(F.lit(1.0)) * profile.radius_km
    force = F.hypot("gn", "ge")
    free = F.when(F.col("here") > 0, F.greatest(F.lit(0.0), 1 - F.col("here") / F.greatest(force, F.lit(1e-300)))).otherwise(F.lit(1.0))
    far = F.when(F.col("s") > 0, free * force / F.col("s")).otherwise(F.lit(0.0))
    det = F.col("nn") * F.col("ee") - F.col("ne") * F.col("ne")
    sound = det > 1e-12 * F.col("s") * F.col("s")

    def at(north: Column, east: Column, kind: int) -> Column:
        return F.struct((F.col("a") + north / degree).alias("a"), (F.col("b") + east / (degree * F.cos(F.radians("a")))).alias("b"), F.lit(kind).alias("kind"))

    plain = at(F.when(F.col("s") > 0, free * F.col("gn") / F.col("s")).otherwise(F.lit(0.0)), F.when(F.col("s") > 0, free * F.col("ge") / F.col("s")).otherwise(F.lit(0.0)), 0)
    newton = F.when(sound, at((F.col("ee") * F.col("gn") - F.col("ne") * F.col("ge")) / det, (F.col("nn") * F.col("ge") - F.col("ne") * F.col("gn")) / det, 1))
    point = F.when(F.col("near").isNotNull(), F.struct(F.col("near.lat").alias("a"), F.col("near.lon").alias("b"), F.lit(2).alias("kind")))
    return best.select(*by, "a", "b", far.alias("moved"), F.array_compact(F.array(plain, newton, point)).alias("tries"))


def geometric_medians(points: DataFrame, by: tuple[str, ...] = ("dataset",), weight: str = "orders", profile: Profile = RUPEE, tol_km: float = 1e-9, rounds: int = 100) -> DataFrame:
    """(by, lat, lon, rest): the weighted geometric median of every group.

    A group rests when its place is pulled by less than ``tol_km``; ``rest`` is false for one that
    was still pulled farther after ``rounds``. Weights below 0 count as 0; a group without weight has
    its mean place.
    """
    keys = list(by)
    held = cut(points.select(*keys, "lat", "lon", F.greatest(F.col(weight).cast("double"), F.lit(0.0)).alias("_w")))
    total = F.sum("_w")
    first = [F.when(total > 0, F.sum(F.col("_w") * F.col(c)) / total).otherwise(F.avg(c)).alias(n) for c, n in (("lat", "a"), ("lon", "b"))]
    tries = cut(held.groupBy(*keys).agg(*first).select(*keys, F.array(F.struct("a", "b", F.lit(0).alias("kind"))).alias("tries")))
    done = None
    for turn in range(1, rounds + 1):
        told = cut(_next(_summed(held, tries, keys, profile), keys, profile))
        still = F.col("moved") < tol_km
        resting = told.where(still if turn < rounds else F.lit(True)).select(*keys, "a", "b", still.alias("rest"))
        done = resting if done is None else done.unionByName(resting)
        tries = told.where(~still).select(*keys, "tries")
        if turn == rounds or not tries.limit(1).count():
            break
    return done.select(*keys, F.col("a").alias("lat"), F.col("b").alias("lon"), "rest")
