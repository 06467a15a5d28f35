"""Outlier rules against the same estimate in dense NumPy, and what they keep."""

import random

import numpy as np
from pyspark.sql import functions as F

from depotry.llm import rules
from depotry.llm.shared import Workspace


def dense(x):
    """The deterministic estimate of one group: three starts, each concentrated to rest, the least determinant."""
    def quantile(v, q):
        bins = np.sort(np.floor(v * rules.BINS))
        return (bins[int(np.ceil(q * len(v))) - 1] + 0.5) / rules.BINS

    def shape(m, full):
        full = full + np.diag(np.array(rules.FLOORS) ** 2)
        full += np.diag(np.maximum(0, np.array(rules.LEAST) ** 2 - np.diag(full)))
        return m, np.linalg.inv(full), np.linalg.slogdet(full)[1]

    centre = np.array([quantile(v, 0.5) for v in x.T])
    iqr = np.array([quantile(v, 0.75) - quantile(v, 0.25) for v in x.T])
    scale = np.sqrt(np.maximum((iqr / 1.349) ** 2 + np.array(rules.FLOORS) ** 2, np.array(rules.LEAST) ** 2))
    z = (x - centre) / scale
    starts = [np.diag(1 / scale**2)]
    for turned in (z / np.maximum(np.sqrt((z * z).sum(1)), 1e-6)[:, None], np.tanh(z)):
        q = turned.T @ turned / len(x)
        r = 0.95 * q / np.sqrt(np.outer(np.diag(q), np.diag(q)))
        np.fill_diagonal(r, 1)
        starts.append(np.linalg.inv(r * np.outer(scale, scale)))
    best = None
    for a in starts:
        m, old = centre, np.inf
        for _ in range(rules.MOST_STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, a, x - m)
            ring = np.floor(np.log2(d + 1e-6) * rules.RINGS)
            near = x[ring <= np.sort(ring)[int(np.ceil(rules.KEEP * len(x))) - 1]]
            m, a, det = shape(near.mean(0), rules.consistency(rules.KEEP, rules.DIM) * np.cov(near.T, bias=True))
            still = old - det < rules.STILL
            old = det
            if still:
                break
        if best is None or old < best[2]:
            best = m, a, old
    m, a, _ = best
    near = x[np.einsum("ij,jk,ik->i", x - m, a, x - m) <= rules.chi2_quantile(rules.WEIGHED, rules.DIM)]
    return shape(near.mean(0), rules.consistency(rules.WEIGHED, rules.DIM) * np.cov(near.T, bias=True))


def frame_of(spark, data):
    rows = [(g, *map(float, v)) for g, x in data.items() for v in x]
    return spark.createDataFrame(rows, "group string, " + ", ".join(f"x{i} double" for i in range(rules.DIM))).repartition(3)


def test_estimate_equals_dense(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = {g: rng.normal(size=(n, rules.DIM)) @ rng.normal(size=(rules.DIM, rules.DIM)) + rng.normal(size=rules.DIM) for g, n in (("a", 400), ("b", 60), ("c", 500))}
    data["a"][:60] += 9
    data["c"][:100] = rng.normal(size=(100, rules.DIM)) * 0.3 + 6  # a fifth of planted outliers, close together
    for most in (10_000, 1):
        monkeypatch.setattr(rules, "MOST_GROUPS", most)
        got = {r["group"]: r for r in rules.concentrate(frame_of(spark, data), Workspace(spark, "test")).collect()}
        for g, x in data.items():
            m, a, det = dense(x)
            assert got[g]["rows"] == len(x)
            assert np.allclose(got[g]["m"], m)
            assert np.allclose(np.reshape(got[g]["a"], a.shape), a)
            assert np.isclose(got[g]["logdet"], det)
    x = data["c"]
    far = np.einsum("ij,jk,ik->i", x - got["c"]["m"], np.reshape(got["c"]["a"], a.shape), x - got["c"]["m"]) > rules.CUTOFF
    assert far[:100].all()
    assert far[100:].sum() <= 4


def test_rejects_junk_and_keeps_the_rest(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    rows = [(i, "en", f"s{i % 3 if i % 2 else 0}", prose(rng.randint(25, 900))) for i in range(500)]
    junk = [(1000 + i, "en", "s0", " ".join(w + rng.choice(["%%%", "###", "|"]) for w in prose(120).split())) for i in range(25)]
    plain = [(2000, "en", "s0", "too short"), (2001, None, None, None), (2002, "en", "s0", "one two three four five six seven eight nine " * 20), (2003, "xx", "y", prose(60))]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + junk + plain], "doc_id long, lang string, source string, text string, x0 double").repartition(3)
    got = {r["doc_id"]: r for r in rules.apply_rules(docs).collect()}
    assert len(got) == len(rows) + len(junk) + len(plain)
    assert all(got[r[0]]["kept"] for r in rows)
    assert not any(got[r[0]]["kept"] or got[r[0]]["base_failed"] for r in junk)
    assert [got[i]["base_failed"] for i in (2000, 2001, 2002, 2003)] == [True, True, True, False]
    assert got[2003]["kept"]


def test_small_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "en", "s", "word " * 30 + "end"), (1, "en", "s", "a b c d e f g h i j k l m n o p q r s t u v")], "doc_id long, lang string, source string, text string")
    assert sorted(r["kept"] for r in rules.apply_rules(docs).collect()) == [False, True]
    assert rules.apply_rules(docs.limit(0)).count() == 0


def prose_and_junk(clean, junk, every):
    """Rows of one source; in junk rows each ``every``-th word ends with a symbol."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    texts = [[rng.choice(words) for _ in range(rng.randint(40, 300))] for _ in range(clean + junk)]
    marked = [[w + "#" * (i >= clean and j % every == 0) for j, w in enumerate(t)] for i, t in enumerate(texts)]
    return [(i, "en", "s0", " ".join(t).capitalize() + ".") for i, t in enumerate(marked)]


def test_a_floor_replaces_only_smaller_variances(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, rules.DIM)) * 3
    x[:, 2] = 0.5
    frame = spark.createDataFrame([("g", *map(float, v)) for v in x], "group string, " + ", ".join(f"x{i} double" for i in range(rules.DIM)))
    a = np.reshape(rules.concentrate(frame, Workspace(spark, "test")).first()["a"], (rules.DIM, rules.DIM))
    spread = np.sqrt(np.diag(np.linalg.inv(a)))
    assert abs(spread[2] - rules.LEAST[2]) < 1e-6
    assert abs(np.delete(spread, 2) - 3).max() < 0.6


def test_a_tenth_of_symbols_is_an_outlier(spark):
    rows = prose_and_junk(200, 12, 2)
    got = {r["doc_id"]: r for r in rules.apply_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert all(0.05 < got[i]["n_symbols"] / got[i]["word_chars"] < 0.12 for i in range(200, 212))
    assert [i for i in range(212) if got[i]["kept"]] == list(range(200))


def test_a_source_with_much_junk(spark):
    rows = prose_and_junk(120, 80, 1)
    got = {r["doc_id"]: r for r in rules.apply_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in range(120, 200))
    assert sum(got[i]["kept"] for i in range(120)) >= 118


def test_very_long_ties_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_GROUPS", 2)
    rows = [(1, "en", "s", "one two three " * 200_000, 1)] * 2 + [(i, "en", "s", "the same words stand in each of these rows and nothing else is found in any of them at all here", 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, `group` int").withColumn("KEPT", F.lit(1)).withColumn("n_words", F.lit(1))
    got = rules.apply_rules(docs).collect()
    assert len(got) == 62
    assert sorted(r["n_words"] for r in got)[-2:] == [600_000, 600_000]
    assert [r["kept"] for r in got if r["doc_id"] != 1] == [True] * 59 + [True] * (60 - 59 - 1)
