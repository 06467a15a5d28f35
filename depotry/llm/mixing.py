"""Mixing sources to target weights by Poisson replication.

A row of source s is repeated Poisson(rate_s) times, where rate_s brings the expected share of
s to its target weight. The draw inverts the Poisson distribution at a number in [0, 1) that
comes from a hash of the row's id and a seed, so it is the same on every run and engine. The
copies are then dealt out in an order drawn the same way.

A source's table of draws holds the numbers of copies that a draw can give, about 24 * sqrt(rate)
entries, and is searched by halving. A mean of more than ``MOST_RATE`` copies is an error.

Defined cases: a null source is a source of its own (weight as for any unlisted one); a null id
draws as empty text; repeated rows draw alike; an empty table gives none; empty and very long
texts are rows like others; extra columns are kept, but for ones named as the two that are added, which are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At rate r a row has between r - SPREAD * sqrt(r) - SPREAD and r + SPREAD * sqrt(r) + SPREAD copies: either tail is under 2**-53, half a step of the draw.
SPREAD = 12
#: Tables of draws up to this number of sources and of bytes in all are broadcast; more are joined by shuffle.
MOST_BROADCAST, MOST_BYTES = 10_000, 32 << 20
#: The greatest mean number of copies of a row; a table of draws then has under 800,000 entries.
MOST_RATE = 1e9
#: Copies that one array makes; a row of more copies makes more arrays.
COPIES_BLOCK = 4096


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1): 52 bits of the md5 of the parts joined by ':'."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None, source: str, size: float) -> DataFrame:
    """(source, rate): ``size`` times the rows in all, split by weight; an unlisted source weighs 1."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(1.0)
    for name, w in sorted((weights or {}).items()):
        if not (w >= 0 and math.isfinite(w)):
            raise ValueError(f"weight of {name!r} must be finite and not negative")
        weight = F.when(F.col("source") == name, float(w)).otherwise(weight)
    everything = counts.withColumn("w", weight).agg(F.sum("w").alias("w_all"), F.sum("n").alias("n_all"))
    shares = counts.withColumn("w", weight).crossJoin(F.broadcast(everything))  # one row on the right
    return shares.select("source", (F.col("n_all") * F.lit(float(size)) * F.col("w") / F.col("w_all") / F.col("n")).alias("rate")).where("rate > 0")


def with_bounds(rates: DataFrame) -> DataFrame:
    """``rates`` with ``low`` and ``high``, the numbers of copies that a draw can give."""
    wide = F.lit(float(SPREAD)) * F.sqrt("rate") + F.lit(float(SPREAD))
    return rates.withColumn("low", F.greatest(F.floor(F.col("rate") - wide), F.lit(0)).cast("long")).withColumn("high", F.ceil(F.col("rate") + wide).cast("long"))


def cumulative(rates: DataFrame) -> DataFrame:
    """(source, low, cdf): P(copies <= k) for k = low, low + 1, ... to the last that can be drawn.

    A term is the one before it times rate / k; sums of the logarithms of these quotients stay small
    around the rate, so that nothing is lost at high rates, and the terms are brought to the sum 1.
    """
    terms = with_bounds(rates).withColumn("k", F.explode(F.sequence("low", "high")))
    whole = Window.partitionBy("source")
    upto = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quotient = F.when(F.col("k") > F.col("low"), F.log("rate") - F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0))
    logs = terms.withColumn("log_term", F.sum(quotient).over(upto))
    sums = logs.withColumn("term", F.exp(F.col("log_term") - F.max("log_term").over(whole))).withColumn("sum", F.sum("term").over(upto)).withColumn("p", F.col("sum") / F.max("sum").over(whole))
    return sums.groupBy("source").agg(F.first("low").alias("low"), F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("cdf"))


def drawn_count(low: Column, cdf: Column, u: Column) -> Column:
    """The smallest k with P(copies <= k) > u, by halving ``cdf``."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["a"] + state["b"]) / 2).cast("int")
        return F.when(F.get(cdf, middle) <= u, F.struct((middle + 1).alias("a"), state["b"].alias("b"))).otherwise(F.struct(state["a"].alias("a"), middle.alias("b")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cdf) + F.lit(1.0))).cast("int"))
    return low + F.aggregate(steps, F.struct(F.lit(0).alias("a"), F.size(cdf).alias("b")), halve, lambda state: state["a"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 0, size: float = 1.0, id_column: str = "doc_id", source: str = "source", copy: str = "copy_id", order: str = "shuffle_key") -> DataFrame:
    """``docs`` with each row repeated by its draw; ``copy`` numbers a row's repeats from 0, ``order`` is the key of the global shuffle."""
    rates = repetition_rates(docs.select(F.col(source)), weights, source, size)
    sources, entries, most = with_bounds(rates).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("high") - F.col("low") + 1), F.lit(0)), F.coalesce(F.max("rate"), F.lit(0.0))).first()
    if most > MOST_RATE:
        raise ValueError(f"a source would be repeated {most:.3g} times, more than {MOST_RATE:.0e}")
    table = cumulative(rates).select(F.col("source").alias("__mix_source"), F.col("low").alias("__mix_low"), F.col("cdf").alias("__mix_cdf"))
    few = sources <= MOST_BROADCAST and 8 * entries + 64 * sources <= MOST_BYTES
    drawn = docs.drop(copy, order).join(F.broadcast(table) if few else table, docs[source].eqNullSafe(F.col("__mix_source")))
    counted = drawn.withColumn("__mix_n", drawn_count(F.col("__mix_low"), F.col("__mix_cdf"), unit_hash(F.lit(str(seed)), id_column))).where("__mix_n > 0").drop("__mix_source", "__mix_low", "__mix_cdf")
    blocks = counted.withColumn("__mix_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mix_n") - 1, F.lit(COPIES_BLOCK).cast("long"))))
    last = F.least(F.col("__mix_n"), F.col("__mix_at") + COPIES_BLOCK) - 1
    spread = blocks.withColumn(copy, F.explode(F.sequence(F.col("__mix_at").cast("int"), last.cast("int")))).drop("__mix_at", "__mix_n")
    keyed = spread.withColumn(order, unit_hash(F.lit(f"order {seed}"), id_column, copy))
    # Partition by the random key, then sort by it: a global shuffle without a second scan for range bounds.
    return keyed.repartition(order).sortWithinPartitions(order, id_column, copy)
