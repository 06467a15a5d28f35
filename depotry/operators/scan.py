"""Running sums of groups of any size, in two levels: sums within parts of a group, and the totals of the parts before.

A window over a whole group would be one task. Here no task orders more than a part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotry.storage import cut

#: Positions of a part in ``bucketed_before``.
WIDTH = 1 << 16


def prefix_sums(rows: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the running sum of each column of ``sums`` in its group, own row included.

    Parts are ranges of (by, order), so a group that is larger than others has more of them.
    ``order`` should be unique within a group.
    """
    keys = [*(F.col(c) for c in by), *(F.col(c) if isinstance(c, str) else c for c in order)]
    held = cut(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*by, "_part").agg(*(F.sum(v).alias(f"_{c}") for c, v in sums.items()))
    totals = totals.select(*by, "_part", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    own = held.select("*", *(F.sum(v).over(local).alias(c) for c, v in sums.items()))
    return own.join(totals, [*by, "_part"]).select(*rows.columns, *((F.col(c) + F.col(f"_{c}")).alias(c) for c in sums))


def bucketed_before(rows: DataFrame, by: list[str], place: str, value: str, last: int, name: str = "before", width: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of its group at smaller places.

    Places are whole numbers up to ``last``, unique in a group; a part is ``width`` of them, so
    groups are cut without sampling them.
    """
    width = width or WIDTH
    held = rows.withColumn("_part", F.floor(F.col(place) / width))
    local = Window.partitionBy(*by, "_part").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    own = held.withColumn(name, F.coalesce(F.sum(value).over(local), F.lit(0)))
    if last < width:
        return own.drop("_part")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*by, "_part").agg(F.sum(value).alias("_t")).select(*by, "_part", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t"))
    return own.join(totals, [*by, "_part"]).withColumn(name, F.col(name) + F.col("_t")).drop("_part", "_t")
