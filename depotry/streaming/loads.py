"""Loads of sites from a stream of orders, with word of a site that passes its capacity while its day still runs.

State is one number for each site and window that is open, and the ids seen within the watermark.
A window's row comes when the watermark passes its end, so late events count as long as they are
within ``late``; repeated events (by id) count once. The same rows come from a table of events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_loads(events: DataFrame, capacity: int, key: str, time: str = "ts", identity: str = "event_id", orders: str | None = None, width: int = 86_400, late: str = "2 hours") -> DataFrame:
    """(window_start, key, load, is_over, is_final) of a stream or a table of order events.

    Windows are ``width`` seconds from midnight UTC on. A final row tells the load of a closed window; a row that is not
    final comes once, as soon as the load is above ``capacity``, without a load. An event counts
    ``orders`` (one without it; null and negative ones none). Events without a time, key or id have no window and drop out.
    """
    amount = F.lit(1) if orders is None else F.greatest(F.coalesce(F.col(orders), F.lit(0)), F.lit(0))
    held = events.where(F.col(time).isNotNull() & F.col(key).isNotNull() & F.col(identity).isNotNull())
    start = (F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / width) * width).cast("long")
    kind = events.schema[key].dataType.simpleString()
    if not events.isStreaming:
        counted = held.dropDuplicates([identity]).groupBy(start.alias("_start"), key).agg(F.sum(amount.cast("long")).alias("load"))
        closed = counted.select(F.timestamp_seconds("_start").alias("window_start"), key, "load", (F.col("load") > capacity).alias("is_over"), F.lit(True).alias("is_final"))
        # Each closed window over capacity was told of before: one row more from the same row, not a second count.
        told = F.when(F.col("is_over"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
        return closed.withColumn("is_final", F.explode(told)).withColumn("load", F.when(F.col("is_final"), F.col("load")))
    once = held.withWatermark(time, late).dropDuplicatesWithinWatermark([identity])
    rows = once.select(F.col(time), start.alias("_start"), F.col(key), amount.cast("long").alias("_n"))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        begin, name = group

        def row(load: int | None, over: bool, final: bool) -> pd.DataFrame:
            return pd.DataFrame({"_start": [begin], key: [name], "load": pd.array([load], "Int64"), "is_over": [over], "is_final": [final]})

        before = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield row(before, before > capacity, True)
            return
        load = before + sum(int(b["_n"].sum()) for b in batches)
        state.update((load,))
        state.setTimeoutTimestamp((int(begin) + width) * 1000)
        if before <= capacity < load:
            yield row(None, True, False)

    told = rows.groupBy("_start", key).applyInPandasWithState(step, f"_start long, `{key}` {kind}, load long, is_over boolean, is_final boolean", "load long", "append", "EventTimeTimeout")
    return told.select(F.timestamp_seconds("_start").alias("window_start"), key, "load", "is_over", "is_final")
