"""Poisson replication: the draws, the shares they bring, odd tables."""

import hashlib
import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from depotry.llm import mixing


def draw(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_draws_and_shares(spark):
    rows = [(i, f"s{min(i % 7, 3)}", f"text {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    weights = {"s0": 4.0, "s1": 1.0, "s2": 0.0}
    got = mixing.mix(docs, weights, seed=3).collect()
    sizes = Counter(s for _, s, _ in rows)
    rates = {s: 4000 * weights.get(s, 1.0) / 6.0 / n for s, n in sizes.items()}
    copies = Counter(r["doc_id"] for r in got)
    for i, s, _ in rows:
        u = int(hashlib.md5(f"3:{i}".encode()).hexdigest()[:13], 16) / 2**52
        assert copies[i] == (draw(rates[s], u) if rates[s] else 0)
    share = Counter(r["source"] for r in got)
    assert share["s2"] == 0
    assert abs(share["s0"] / len(got) - 4 / 6) < 0.03
    assert {r["copy_id"] for r in got if r["doc_id"] == max(copies, key=copies.get)} == set(range(max(copies.values())))
    keys = [r["shuffle_key"] for r in got]
    assert len(set(keys)) == len(keys)
    again = mixing.mix(docs.repartition(2), weights, seed=3).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_many_sources_are_joined_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 50}") for i in range(500)], "doc_id long, source string")
    few = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 3)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == few


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None, "a"), (1, "s", "", "b"), (1, "s", "", "b"), (2, None, "x" * 50_000, None)], "doc_id long, source string, text string, copy_id string")
    out = mixing.mix(docs, size=5.0)
    assert out.columns == ["doc_id", "source", "text", "copy_id", "shuffle_key"]
    assert out.where("source IS NULL").count() > 0
    assert mixing.mix(docs.limit(0)).count() == 0


def exact_cdf(rate):
    """(low, P(copies <= k) from low on) by exact sums of terms from the mode outwards."""
    mode, terms = int(rate), {}
    t = 1.0
    for k in range(mode, int(rate + 14 * math.sqrt(rate) + 20)):
        t *= rate / k if k > mode else 1.0
        terms[k] = t
    t = 1.0
    for k in range(mode - 1, max(-1, int(rate - 14 * math.sqrt(rate) - 20)), -1):
        t *= (k + 1) / rate
        terms[k] = t
    ks, whole = sorted(terms), math.fsum(terms.values())
    sums, out = 0.0, []
    for k in ks:
        sums += terms[k]
        out.append(sums / whole)
    return ks[0], out


def test_tables_of_draws_stay_small_and_exact(spark):
    rates = [1e-6, 0.3, 2.5, 40.0, 200.0, 5e4, 1e8]
    begin = time.perf_counter()
    rows = {r["source"]: r for r in mixing.cumulative(spark.createDataFrame([(str(r), r) for r in rates], "source string, rate double")).collect()}
    assert time.perf_counter() - begin < 20
    for rate in rates:
        low, want = exact_cdf(rate)
        row = rows[str(rate)]
        assert len(row["cdf"]) <= 24 * math.sqrt(rate) + 28
        got = {row["low"] + i: p for i, p in enumerate(row["cdf"])}
        assert all(abs(got[low + i] - p) < 1e-11 for i, p in enumerate(want) if low + i in got)
        assert all(p < 2**-53 for i, p in enumerate(want) if low + i < row["low"])
        assert row["cdf"][-1] == 1.0


def test_halving_equals_a_scan(spark):
    cdfs = [[1.0], [0.5, 1.0], [0.25, 0.25, 0.5, 0.75, 0.75, 1.0], [i / 37 for i in range(1, 38)]]
    rows = [(low, cdf, u) for low in (0, 7) for cdf in cdfs for u in (0.0, 0.1, 0.25, 0.5, 0.74, 0.75, 0.999)]
    got = spark.createDataFrame(rows, "low long, cdf array<double>, u double").withColumn("n", mixing.drawn_count(F.col("low"), F.col("cdf"), F.col("u"))).collect()
    assert all(r["n"] == r["low"] + sum(p <= r["u"] for p in r["cdf"]) for r in got)


def test_a_high_rate_repeats_rows_in_blocks(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "")], "doc_id long, source string")
    got = mixing.mix(docs, {"a": 3.0, "": 1.0}, seed=5, size=10_000.0).groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.countDistinct("copy_id").alias("d"), F.max("copy_id").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in got)
    for r, mean in ((r, {"a": 15_000, "": 5_000}[r["source"]]) for r in got):
        u = int(hashlib.md5(f"5:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        low, cdf = exact_cdf(mean)
        assert r["n"] == low + sum(p <= u for p in cdf)
    assert len(got) == 2
    with pytest.raises(ValueError, match="repeated"):
        mixing.mix(docs, size=1e10)


def test_large_tables_of_draws_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 5}") for i in range(50)], "doc_id long, source string")
    few = sorted(map(tuple, mixing.mix(docs, size=9.0).collect()))
    monkeypatch.setattr(mixing, "MOST_BYTES", 100)
    assert sorted(map(tuple, mixing.mix(docs, size=9.0).collect())) == few
