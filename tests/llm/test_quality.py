"""The additive model on held-out rows and the meaning of its counts."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from depotry.llm import docstats, quality


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)]


def odd_texts():
    rng = random.Random(3)
    rows = [None, "", " \n ", "a", "É　b\x1cc \x85", "w " * 7, "w " * 9, "a b c d e f g h i\n" * 3, "#*$%&|<> x" * 40, "\n\n x\n x\nx", "é" * 70_000 + " z", "q r s t u v w x " * 9000]
    rows += [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta\n", "\n"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    return rows


def test_counts_equal_brute_force(monkeypatch):
    from depotry.llm import textscan

    rows = odd_texts()
    for segment in (1 << 20, 64):
        monkeypatch.setattr(textscan, "SEGMENT", segment)
        got = docstats.text_counts(pa.array(rows, pa.string()))
        for t, c in zip(rows, got, strict=True):
            assert c[:5].tolist() == brute_counts(t), t


@pytest.mark.parametrize("seed", [1, 2])
def test_model_learns_main_effects_and_a_pair(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(6000, 4))
    logit = 2 * (x[:, 0] > 0.3) - 1 + 2.5 * ((x[:, 1] > 0) ^ (x[:, 2] > 0)) - 1
    y = (rng.random(6000) < 1 / (1 + np.exp(-3 * logit))).astype(float)
    model = quality.fit(x[:4000], y[:4000])
    right = ((model.score(x[4000:]) > 0.5) == y[4000:]).mean()
    best = ((logit[4000:] > 0) == y[4000:]).mean()
    assert right > best - 0.02
    assert (1, 2) in {tuple(sorted(p[:2])) for p in model.pairs}


def corpus(n=600):
    rng, rows = random.Random(8), []
    words = ["river", "stone", "the", "of", "lamp", "green", "walk", "and", "house", "night"]
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["%%%", " |", "&&&"])) for _ in range(rng.randint(5, 200)))
        rows.append((i, text, int(good)))
    return rows


def test_held_out_rows_and_odd_tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t, _ in rows] + [(9000, None, "x", 3), (9001, "", None, None)], "doc_id long, text string, score string, n int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4] + [(9000, None)], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels))
    assert scored.columns == ["doc_id", "n", "score", "predicted"]
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == len(rows) + 2
    held = [(got[i]["predicted"], y) for i, _, y in rows if i % 4 == 0]
    assert sum(p == y for p, y in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    one = quality.train(docs, labels.where("quality = 1"))
    assert {r["predicted"] for r in quality.score(docs, one).collect()} == {1}
    nothing = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score(docs.limit(0), nothing).count() == 0


def brute_score(model, row):
    """One row through the lookup tables, a feature and a pair at a time."""
    bins = [int(np.searchsorted(c, v, "right")) for c, v in zip(model.cuts, row, strict=True)]
    total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
    for i, j, t in model.pairs:
        total += t[tuple(bins[k] * quality.COARSE // (len(model.cuts[k]) + 1) for k in (i, j))]
    return 1 / (1 + np.exp(-total))


def test_scores_equal_brute_force_on_long_repeated_and_clashing_rows(spark):
    rows = corpus(300)
    texts = [t for _, t, _ in rows] + ["river stone " * 200_000, "river stone " * 200_000, "", None]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, Score int, PREDICTED int")
    model = quality.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    scored = quality.score(docs, model, threshold=0.7)
    assert scored.columns == ["doc_id", "score", "predicted"]
    got = {r["doc_id"]: r for r in scored.collect()}
    x = quality.features(pa.array(texts, pa.string()))
    for i, row in enumerate(x):
        assert np.isclose(got[i]["score"], brute_score(model, row))
        assert got[i]["predicted"] == (got[i]["score"] >= 0.7)
    assert got[300]["score"] == got[301]["score"]


@pytest.mark.parametrize("step", ["train", "score"])
def test_batches_are_small_whatever_ran_before(spark, step):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    if step == "train":
        quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    else:
        quality.score(docs, quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
