"""The language model against a plain one in Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from depotry.llm import lm

TEXTS = [
    "The cat sat on the mat", "the cat sat on the hat", "A dog sat.\nThe dog ran on the mat", None, "", "x " * 5000,
    "a b c d e a b c d a b c a b a", "the cat the cat the cat", "É è\tÀ the Cat", "the cat sat on the mat", "one-off words only here",
]


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "</s>"]


def brute(train, texts):
    uni, pairs = Counter(), Counter()
    for t in train:
        ts = tokens(t)
        uni.update(ts)
        pairs.update(zip(["<s>", *ts], ts))
    V, N = len(uni), sum(uni.values())
    before, after, total = Counter(), defaultdict(Counter), Counter()
    for (v, w), c in pairs.items():
        before[w] += 1
        after[v][min(c, 3)] += 1
        total[v] += c

    def disc(values):
        n = [sum(x == k for x in values) for k in (1, 2, 3, 4)]
        if not (n[0] and n[1]):
            return [0, 0.5, 0.75, 1.0]
        y = n[0] / (n[0] + 2 * n[1])
        d = [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.0]
        return [min(max(x, 0), k) for k, x in enumerate(d)]

    D, E, A = disc(pairs.values()), disc(before.values()), len(pairs)
    h = sum(E[min(a, 3)] for a in before.values()) / A

    def p1(w):
        return (max(before[w] - E[min(before[w], 3)], 0) / A if w in before else 0) + h / (V + 1)

    def p(v, w):
        if not total[v]:
            return p1(w)
        c = pairs[v, w]
        return max(c - D[min(c, 3)], 0) / total[v] + sum(D[k] * n for k, n in after[v].items()) / total[v] * p1(w)

    out = []
    for t in texts:
        ts = tokens(t)
        base = sum(math.log10((uni[w] + 0.1) / (N + 0.1 * (V + 1))) for w in ts)
        out.append((len(ts), sum(w in uni for w in ts), base, sum(math.log10(p(v, w)) for v, w in zip(["<s>", *ts], ts))))
    for v in ["<s>", "the", "never seen"]:
        assert math.isclose(sum(p(v, w) for w in [*uni, "<unk>"]), 1)
    return out, N


@pytest.mark.parametrize("n_train", [0, 1, 8, 11])
def test_scores_equal_plain_model(spark, n_train):
    rows = [(i, t, i < n_train) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    model = lm.fit(docs.where("train"))
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    assert len(got) == len(TEXTS)
    if not n_train:
        assert all(r["score"] == 0 for r in got.values())
        return
    want, n = brute(TEXTS[:n_train], TEXTS)
    assert model.tokens == n
    for i, w in enumerate(want):
        r = got[i]
        assert (r["n_tokens"], r["n_known"]) == w[:2]
        assert math.isclose(r["base_score"], w[2], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["score"], w[3], rel_tol=1e-9, abs_tol=1e-9)


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2.0)], "doc_id long, text string, shard string, score double")
    model = lm.fit(docs)
    assert lm.score(docs, model).columns == ["doc_id", "shard", *lm.RESULTS]
    assert lm.score(docs.limit(0), model).count() == 0


def test_counts_beyond_32_bits(spark, monkeypatch):
    """The commonest pairs of a very large corpus: counts are multiplied where a shard is finished."""
    plain = lm.merged
    by = 3_000_000_000

    def many(parts_df, shards, finish, schema, width=8):
        if "stats" not in schema:
            return plain(parts_df, shards, finish, schema, width)
        return plain(parts_df, shards, lambda shard, keys, counts: finish(shard, keys, counts * np.uint64(by)), schema, width)

    monkeypatch.setattr(lm, "merged", many)
    docs = spark.createDataFrame([(1, "a b a b a b a b")], "doc_id long, text string")
    model = lm.fit(docs)
    assert model.wide
    ids = model.ids(np.concatenate([w for _, w, _ in lm.scan(pa.array(["a b"]))]))[0]
    assert model.pair_counts(ids[:1], ids[1:]).tolist() == [4 * by]
    assert lm.score(docs, model).first()["score"] > -1


def test_clashing_names_long_texts_and_ties(spark):
    docs = spark.createDataFrame([(1, "a b " * 300_000, 1, 2)] * 2 + [(2, "a b", 1, 2)], "doc_id long, text string, SCORE int, N_Tokens int")
    model = lm.fit(docs)
    rows = lm.score(docs, model).collect()
    assert rows[0].asDict().keys() == {"doc_id", *lm.RESULTS}
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 1] == [600_001] * 2
    assert len({r["score"] for r in rows}) == 2
