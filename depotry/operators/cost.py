"""Pricing plans, by both models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotry.functions.geo import haversine
from depotry.schema import RUPEE, Config, Profile


def rate_grid(vehicles: DataFrame, traffic: DataFrame, prices: DataFrame) -> DataFrame:
    """Rupees a road km for every fleet, traffic and (fuel_price, driver_wage) of ``prices``.

    The three catalogues are a few rows each, whatever the size of the data.
    """
    grid = vehicles.crossJoin(F.broadcast(traffic)).crossJoin(F.broadcast(prices))
    energy = F.coalesce("energy_cost_per_km", F.col("fuel_per_km") * F.col("fuel_price"))
    return grid.withColumn("rate_per_km", energy + F.col("upkeep_per_km") + F.col("driver_wage") / (F.col("speed_kmph") / F.col("congestion")))


def trips(orders: Column, capacity: Column | int) -> Column:
    return F.ceil(F.greatest(orders, F.lit(0)) / F.greatest(F.lit(capacity) if isinstance(capacity, int) else capacity, F.lit(1)))


def cost_weight(points: DataFrame, config: Config) -> DataFrame:
    """Points with ``weight``: rupees a day for a straight-line km."""
    return points.withColumn("weight", F.lit(2.0) * trips(F.col("orders"), config.fleet["capacity"]) * F.lit(config.road_factor) * F.lit(config.rate_per_km))


def row_cost(assigned: DataFrame, config: Config) -> DataFrame:
    """Assigned points priced for a day: road_km, trips, vehicle_km, hours, fuel (with upkeep), driver, total, within_radius."""
    f = config.fleet
    energy = f["fuel_per_km"] * config.fuel_price if config.fuel_only_rows else config.energy_per_km
    out = assigned.withColumn("road_km", F.col("dist_km") * F.lit(config.road_factor)).withColumn("trips", trips(F.col("orders"), f["capacity"]))
    out = out.withColumn("vehicle_km", F.lit(2.0) * F.col("road_km") * F.col("trips"))
    out = out.withColumn("hours", F.col("vehicle_km") / F.lit(config.speed) if config.speed > 0 else F.lit(0.0))
    out = out.withColumn("fuel", F.col("vehicle_km") * F.lit(energy + f["upkeep_per_km"])).withColumn("driver", F.col("hours") * F.lit(config.driver_wage))
    limit = F.lit(True) if config.max_radius_km is None else F.col("road_km") <= F.lit(float(config.max_radius_km))
    return out.withColumn("total", F.col("fuel") + F.col("driver")).withColumn("within_radius", limit)


def breakdown(rows: DataFrame, sites: DataFrame, config: Config, plan: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Sums of priced rows by plan, with the rent of all its sites."""
    sums = rows.groupBy(*plan).agg(F.sum("fuel").alias("fuel"), F.sum("driver").alias("driver"), F.sum("total").alias("delivery"), F.sum("vehicle_km").alias("vehicle_km"), F.sum("hours").alias("driver_hours"), F.sum(F.col("orders") * F.col("dist_km")).alias("order_km"))
    rent = sites.groupBy(*plan).agg((F.count(F.lit(1)) * F.lit(float(config.rent_per_day))).alias("infrastructure"))
    return sums.join(rent, list(plan)).withColumn("total", F.col("delivery") + F.col("infrastructure"))


def improvement_pct(base: Column, total: Column) -> Column:
    return F.when(base > 0, 100.0 * (base - total) / base).otherwise(F.lit(0.0))


def impact(plan: DataFrame, config: Config) -> DataFrame:
    """Money and CO2 of a plan (vehicle_km, total) against its baseline (base_vehicle_km, base_total), a day and a year."""
    grams = config.fleet["co2_g_per_km"]
    out = plan.withColumn("saved_per_day", F.greatest(F.lit(0.0), F.col("base_total") - F.col("total"))).withColumn("km_per_year", F.col("vehicle_km") * 365)
    out = out.withColumn("saved_per_year", F.col("saved_per_day") * 365).withColumn("co2_kg_per_day", F.col("vehicle_km") * F.lit(grams / 1000))
    return out.withColumn("co2_t_saved_per_year", F.greatest(F.lit(0.0), F.col("base_vehicle_km") - F.col("vehicle_km")) * F.lit(grams / 1000 * 365 / 1000))


def impact_order_km(plan: DataFrame, cost_per_km: float | None = None, co2_g_per_km: float | None = None, days: int = 365) -> DataFrame:
    """The order-km model's savings: each factor is optional and its columns null without it."""
    saved = F.greatest(F.lit(0.0), F.col("base_order_km") - F.col("order_km"))
    money, grams = F.lit(cost_per_km).cast("double"), F.lit(co2_g_per_km).cast("double")
    return plan.withColumn("order_km_saved", saved).withColumn("money_per_year", saved * money * days).withColumn("co2_kg_per_year", saved * grams * days / 1000)


def weighted_cost(assigned: DataFrame, plan: tuple[str, ...] = ("dataset",), weight: str = "orders") -> DataFrame:
    return assigned.groupBy(*plan).agg(F.sum(F.col(weight) * F.col("dist_km")).alias("cost"))


def centroids(points: DataFrame, plan: tuple[str, ...] = ("dataset",), weight: str = "orders") -> DataFrame:
    """Weighted centroid (plain mean where the weights sum to nothing), plain centre, bounds and totals."""
    w = F.col(weight)
    total = F.sum(w)
    mean = {c: F.when(total > 0, F.sum(F.col(c) * w) / total).otherwise(F.avg(c)).alias(f"{c}_weighted") for c in ("lat", "lon")}
    return points.groupBy(*plan).agg(
        *mean.values(), F.avg("lat").alias("lat_centre"), F.avg("lon").alias("lon_centre"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
        F.count(F.lit(1)).alias("n"), F.sum("orders").cast("long").alias("orders_total"), F.max("orders").alias("orders_max"), F.min("orders").alias("orders_min"), F.avg("orders").alias("orders_mean"),
    )


def plan_score(points: DataFrame, assignments: DataFrame, sites: DataFrame, profile: Profile = RUPEE, weight: str = "orders") -> DataFrame:
    """(dataset, cost) of a plan given as (dataset, id, wh_id); a point without a known site raises."""
    at = sites.select("dataset", "wh_id", F.col("lat").alias("wh_lat"), F.col("lon").alias("wh_lon"))
    placed = points.join(assignments.select("dataset", "id", "wh_id"), ["dataset", "id"], "left").join(at, ["dataset", "wh_id"], "left")
    lost = F.raise_error(F.concat(F.lit("no site is assigned to "), F.col("id"))).cast("double")
    return weighted_cost(placed.withColumn("dist_km", F.when(F.col("wh_lat").isNull(), lost).otherwise(haversine(F.col("lat"), F.col("lon"), F.col("wh_lat"), F.col("wh_lon"), profile))), weight=weight)


def farthest(points: DataFrame, profile: Profile = RUPEE) -> DataFrame:
    """(dataset, id, km): the point farthest from the centre of its data set, the first id of equals."""
    centre = points.groupBy("dataset").agg(F.avg("lat").alias("_a"), F.avg("lon").alias("_b"))
    far = points.join(centre, "dataset").withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("_a"), F.col("_b"), profile))
    return far.groupBy("dataset").agg(F.min(F.struct((-F.col("km")).alias("_m"), "id", "km")).alias("f")).select("dataset", "f.id", "f.km")
