"""Connected components of a table of links, in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotry.llm.shared import Workspace, join_by_key

MOST_ROUNDS = 60


def components(links: DataFrame, work: Workspace, name: str = "components", parts: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps, which need O(log n) rounds or so; every round is
    written to the shared folder. Each step takes minima by key and joins them back, the nodes
    with many neighbours by broadcast, so no node's neighbours are gathered in one place. Links to null or to itself say nothing.
    """
    stars = work.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0", parts)
    last = None
    for turn in range(1, MOST_ROUNDS):
        mark = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = mark
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.table(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), f"{name}-least-{turn}", parts)
        large = join_by_key(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        stars = work.table(small, f"{name}-{turn}", parts)
        if turn > 1:
            work.remove(f"{name}-{turn - 2}")
        work.remove(f"{name}-least-{turn}")
    raise RuntimeError("the links' components did not settle")
