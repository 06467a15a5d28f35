"""Demand points, sites and raw rows derived from the star-schema tables.

The tables have no positions, so they come from keys by integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(key: str) -> tuple[Column, Column]:
    """(lat, lon) of a key."""
    k = F.col(key)
    return F.lit(12.8) + (k * 37 % 101) / F.lit(250.0), F.lit(77.4) + (k * 53 % 97) / F.lit(220.0)


def nation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point a nation, its orders those of its customers."""
    # Orders are counted by customer first: the join then moves a row a customer, not a row an order.
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(own, F.col("c_custkey") == F.col("o_custkey"))
    lat, lon = position("c_nationkey")
    counted = joined.groupBy("c_nationkey").agg(F.sum("n").alias("orders"))
    return counted.select(F.lit("nations").alias("dataset"), F.col("c_nationkey").cast("long").alias("ord"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("id"), lat.alias("lat"), lon.alias("lon"), "orders")


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point a customer, zero orders included."""
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    lat, lon = position("c_custkey")
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(counted, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(F.lit("customers").alias("dataset"), F.col("c_custkey").cast("long").alias("ord"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), lat.alias("lat"), lon.alias("lon"), F.coalesce("orders", F.lit(0)).alias("orders"))


def supplier_sites(spark: SparkSession, sf_dir: str, dataset: str = "customers") -> DataFrame:
    lat, lon = position("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.lit(dataset).alias("dataset"), F.lit(0).alias("k"), F.col("s_suppkey").cast("long").alias("wh_ord"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("wh_id"), lat.alias("lat"), lon.alias("lon"))


def five_sites(spark: SparkSession, dataset: str = "nations") -> DataFrame:
    """Sites W1..W5 at the positions of keys 1, 6, 11, 16, 21."""
    keys = spark.range(5).select(F.col("id").alias("wh_ord"), (F.col("id") * 5 + 1).alias("key"))
    lat, lon = position("key")
    return keys.select(F.lit(dataset).alias("dataset"), F.lit(5).alias("k"), "wh_ord", F.concat(F.lit("W"), (F.col("wh_ord") + 1).cast("string")).alias("wh_id"), lat.alias("lat"), lon.alias("lon"))


def dirty_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text rows with the usual mistakes, from ``part``."""
    k = F.col("p_partkey")
    s = k.cast("string")
    id_ = F.when(k % 29 == 0, "").when(k % 31 == 0, None).otherwise(F.concat(F.lit(" P"), s))
    lat = F.when(k % 17 == 0, "").when(k % 19 == 0, "north").when(k % 23 == 0, F.concat(F.lit("12,"), (k % 100 + 100).cast("string"))).when(k % 13 == 0, F.concat(F.lit("12."), (k % 100 + 100).cast("string"), F.lit("°"))).otherwise(F.concat(F.lit("12."), (k % 100 + 100).cast("string")))
    lon = F.when(k % 37 == 0, None).otherwise(F.concat(F.lit("77."), (k % 90 + 100).cast("string")))
    orders = F.when(k % 7 == 0, F.concat(F.lit("1,"), (k % 900 + 100).cast("string"))).when(k % 11 == 0, "3.5").when(k % 41 == 0, "12.0").otherwise((k % 500).cast("string"))
    return table(spark, sf_dir, "part").select(F.lit("parts").alias("dataset"), k.cast("long").alias("line_no"), id_.alias("id"), lat.alias("lat"), lon.alias("lon"), orders.alias("orders"))
