"""Exact top-k against brute force."""

import math
import random

import pytest

from depotry.llm import knn


def brute(rows, asked, k, scale):
    def whole(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    sound = [(i, whole(v)) for i, v in rows if i is not None and whole(v)]
    out = []
    for i, v in asked:
        q = whole(v) if i is not None else None
        if not q:
            continue
        scores = sorted((-max(min(sum(a * b for a, b in zip(q, c)), 2**63 - 1), -(2**63)), j) for j, c in sound if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, asked, k=5, scale=256.0):
    kind = "id long, v array<double>, vec_id string"
    frames = [spark.createDataFrame([(*r, "x") for r in x], kind).repartition(3) for x in (rows, asked)]
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.top_k(*frames, k, scale).collect())


@pytest.mark.parametrize(("seed", "shard", "leaf", "block"), [(1, 40, 4, 7), (2, 1000, 64, 256), (3, 16, 1, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, shard, leaf, block):
    monkeypatch.setattr(knn, "SHARD_ROWS", shard)
    monkeypatch.setattr(knn, "LEAF", leaf)
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "BOXES", 3)
    monkeypatch.setattr(knn, "LEAF_SAMPLE", 1)
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(60)]  # equal vectors: ties
    rows += [(300 + i, [round(rng.uniform(-1, 1)) / 2 for _ in range(6)]) for i in range(60)]
    asked = [r for r in rows if r[0] % 10 == 0]
    assert run(spark, rows, asked) == brute(rows, asked, 5, 256.0)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [3.0]), (8, [-1.0, 0.5, 4.0]), (None, [1.0, 1.0]), (9, [1e200, -1e200]), (10, [1e10, 1e9]), (1, [1.0, 2.5]), (11, [0.0, 0.0])]
    assert run(spark, rows, rows, 3) == brute(rows, rows, 3, 256.0)
    assert run(spark, rows[:1], rows[:1]) == []
    assert run(spark, [], []) == []


def test_far_shards_are_not_asked(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 50)
    rng = random.Random(5)
    centres = [[(20.0 if i == j else 0.0) for i in range(8)] for j in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 8]]) for i in range(400)]
    asked, sent = [r for r in rows if r[0] % 5 == 0], []
    plain = knn._routed

    def counted(*args):
        out = plain(*args).cache()
        sent.append(sum(len(r["ids"]) // 8 for r in out.collect()))
        return out

    monkeypatch.setattr(knn, "_routed", counted)
    assert run(spark, rows, asked) == brute(rows, asked, 5, 256.0)
    assert sent[0] < 3 * len(asked)  # all pairs of a query and another shard would be seven times the queries and more


def test_extra_columns_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 16)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)] + [(100 + i, [float(i), -1.0, 0.5]) for i in range(50)]
    asked = rows[::7] + rows[:1]
    assert run(spark, rows, asked) == brute(rows, asked, 5, 256.0)
