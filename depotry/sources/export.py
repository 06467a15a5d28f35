"""Plans as CSV, text, JSON and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotry.schema import Config


def plan_rows(assigned: DataFrame, sites: DataFrame, load: DataFrame) -> DataFrame:
    """Sites and points of plans in one table: type, id, lat, lon, orders_per_day, assigned_to, distance_km."""
    of_sites = sites.join(load.select("dataset", "wh_id", "load"), ["dataset", "wh_id"]).select("dataset", F.lit("warehouse").alias("type"), F.col("wh_id").alias("id"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.col("load").alias("orders_per_day"))
    of_points = assigned.select("dataset", F.lit("area").alias("type"), "id", "lat", "lon", F.col("orders").alias("orders_per_day"), F.col("wh_id").alias("assigned_to"), F.round("dist_km", 3).alias("distance_km"))
    return of_sites.unionByName(of_points, allowMissingColumns=True)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def link(settings: DataFrame) -> DataFrame:
    """``k=3&v=ev..`` of settings(sample, k, vehicle, traffic, fuel_price, ...): what differs from the defaults."""
    d = Config()

    def part(key: str, column: str, default: object) -> Column:
        value = F.col(column)
        return F.when(value.isNotNull() & (value != F.lit(default)), F.concat(F.lit(f"{key}="), value.cast("string")))

    always = [F.concat(F.lit("s="), "sample"), F.concat(F.lit("k="), F.col("k").cast("string"))]
    rest = [part("v", "vehicle", d.vehicle), part("t", "traffic", d.traffic), part("f", "fuel_price", d.fuel_price), part("w", "driver_wage", d.driver_wage), part("r", "rent", d.rent_per_day), part("cap", "capacity", 0), part("rad", "max_radius", 0), part("sc", "scenario", "today")]
    return settings.withColumn("link", F.concat_ws("&", *always, *rest))


def rupees(amount: Column) -> Column:
    """Whole rupees with the last three digits, then pairs, parted by commas."""
    digits = F.round(amount).cast("long").cast("string")
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 3), r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.concat(F.lit("₹"), F.when(F.length(digits) > 3, F.concat(head, F.lit(","), F.substring(digits, -3, 3))).otherwise(digits))


def short_rupees(amount: Column) -> Column:
    """Lakhs or thousands with one digit."""
    return F.when(amount >= 1e5, F.concat(F.lit("₹"), F.format_number(amount / 1e5, 1), F.lit("L"))).when(amount >= 1e3, F.concat(F.lit("₹"), F.format_number(amount / 1e3, 1), F.lit("K"))).otherwise(rupees(amount))


def summary(plans: DataFrame) -> DataFrame:
    """A few lines for each of plans(dataset, n, orders_total, k, total, base_total, best_k, saved_per_year, regret_pct)."""
    saving = 100 * (F.col("base_total") - F.col("total")) / F.col("base_total")
    lines = [
        F.format_string("%s: %d areas, %d orders a day.", "dataset", F.col("n").cast("int"), F.col("orders_total").cast("int")),
        F.concat(F.format_string("K=%d: ", F.col("k").cast("int")), rupees(F.col("total")), F.lit(" a day against "), rupees(F.col("base_total")), F.lit(" for one depot, "), F.format_number(saving, 1), F.lit("% cheaper.")),
        F.format_string("Cheapest at K=%d.", F.col("best_k").cast("int")),
        F.when(F.col("saved_per_year").isNotNull(), F.concat(F.lit("Saves "), short_rupees(F.col("saved_per_year")), F.lit(" a year."))),
        F.when(F.col("regret_pct").isNotNull(), F.concat(F.lit("Regret under demand shifts: "), F.format_number("regret_pct", 1), F.lit("%."))),
    ]
    return plans.withColumn("summary", F.concat_ws("\n", *lines))


def geojson(assigned: DataFrame, limit_km: float | None = None) -> DataFrame:
    """A line feature for each assignment: radius of the point's circle by its share of the largest, whether it is out of reach."""
    top = assigned.groupBy("dataset").agg(F.max("orders").alias("_top"))
    far = F.lit(False) if limit_km is None else F.col("dist_km") > F.lit(float(limit_km))
    coordinates = F.array(F.array("lon", "lat"), F.array("wh_lon", "wh_lat"))
    props = F.struct("id", F.col("wh_id").alias("site"), F.round(5 + 13 * F.sqrt(F.col("orders") / F.col("_top")), 3).alias("radius"), far.alias("out_of_radius"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"), props.alias("properties"))
    return assigned.join(top, "dataset").select("dataset", "id", F.to_json(feature).alias("feature"))


def json_plans(sites: DataFrame) -> DataFrame:
    """One JSON document a plan."""
    packed = sites.groupBy("dataset", "k").agg(F.array_sort(F.collect_list(F.struct("wh_ord", "wh_id", "lat", "lon"))).alias("sites"), F.first("objective").alias("objective"))
    return packed.select("dataset", "k", F.to_json(F.struct("k", F.round("objective", 4).alias("objective"), "sites")).alias("json"))


def chart(sweep: DataFrame) -> DataFrame:
    """Heights of a stacked bar for each K, as shares of 1.08 times the largest total."""
    top = sweep.groupBy("dataset").agg((F.max("total") * 1.08).alias("_top"))
    return sweep.join(top, "dataset").select("dataset", "k", (F.col("delivery") / F.col("_top")).alias("y_delivery"), (F.col("total") / F.col("_top")).alias("y_total"))
