"""Phrase collocations against brute force, with crowded sketches and runs that cut texts anywhere."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from depotry.llm import phrases


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def counts(rows, longest):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    return f, n


def brute(rows, longest, least, top):
    f, n = counts(rows, longest)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    scored = {}
    for (lang, p), a in cand.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        scored[lang, p] = (s, a, f[lang, p[:k]], f[lang, p[k:]])
    covered = {(lang, q[i : i + m]) for (lang, q), b in cand.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if cand.get((lang, q[i : i + m]), -1) <= b}
    out = []
    for lang in n:
        own = sorted(((-s, -a, " ".join(p).encode(), l, r) for (g, p), (s, a, l, r) in scored.items() if g == lang and (g, p) not in covered))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(own[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = ["the", "The", "of", "new", "york", "city", "É", "é", "naïve", "x", "a\x0bb", "[z]", "日本"]
    rows = [(None, "new york city " * 30), ("en", None), ("en", ""), ("en", "one,two.three\nfour\tfive  six"), ("de", "a a a a a a a"), ("de", "a a a. a a"), ("en", "new york " * 3000)]
    rows += [(rng.choice(["en", "de", None]), " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "!"]) for _ in range(rng.randint(0, 40)))) for _ in range(150)]
    return rows + rows[:5]


@pytest.mark.parametrize(("width", "longest", "least", "top"), [(24, 5, 5, 1000), (6, 5, 5, 7), (10, 3, 300, 1000)])
def test_equals_brute_force(spark, width, longest, least, top):
    rows = corpus()
    docs = spark.createDataFrame([(g, t, "x", 3, 4) for g, t in rows], "lang string, text string, phrase string, f long, n_words int").repartition(5)
    got = sorted(tuple(r) for r in phrases.mine_phrases(docs, longest, least, top, width=width).collect())
    assert got == brute(rows, longest, least, top)


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_runs_lose_nothing(held, monkeypatch):
    monkeypatch.setattr("depotry.llm.textscan.SEGMENT", 64)
    rows = corpus()
    batches = [pa.record_batch([pa.array([g or "und" for g, _ in rows[i : i + 9]]), pa.array([t for _, t in rows[i : i + 9]])], names=["lang", "text"]) for i in range(0, len(rows), 9)]
    found = Counter()
    for run in phrases.word_runs(iter(batches), 3, held):
        spelt = run.distinct.to_pylist()
        for n, starts, _ in phrases._ngrams(run, 3):
            for s in starts[starts + n > run.old]:
                found[run.langs[run.lang[s]], tuple(spelt[w] for w in run.ids[s : s + n])] += 1
    assert found == counts(rows, 3)[0]


def test_sketch_never_underestimates():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    hashes = np.repeat(values, rng.integers(1, 400, 4000))
    sketch = np.zeros((phrases.DEPTH, 1 << 8), "u1")
    rng.shuffle(hashes)
    for part in np.array_split(hashes, 9):
        phrases.add_to(sketch, part, 8)
    times = np.array([(hashes == v).sum() for v in values[:300]])
    assert (phrases.estimate(sketch, values[:300], 8) >= np.minimum(times, 255)).all()


def test_many_sketches_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FAN_IN", 3)
    rows = [("en", f"alpha beta gamma {i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(20)
    assert sorted(tuple(r) for r in phrases.mine_phrases(docs, 5, 20, 50, width=12).collect()) == brute(rows, 5, 20, 50)


def test_empty_table(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_large_products(spark):
    frequent = spark.createDataFrame([("en", "a", 1, 10**12), ("en", "b", 1, 10**12), ("en", "a b", 2, 10**12 - 1)], "lang string, phrase string, n_words int, f long")
    row = phrases.score_phrases(frequent, spark.createDataFrame([("en", 10**14)], "lang string, n long")).first()
    assert row["score"] == 1000 * (10**12 - 1) * 10**14 // 10**24


def test_sketch_grows_with_the_text(spark, monkeypatch):
    """Rare n-grams outnumber the cells of the narrowest sketch by more than the least count, and still hardly any passes."""
    monkeypatch.setattr(phrases, "WIDTH", 8)
    rows = [("en", f"new york city w{i} x{i * 7} y{i * 11} z{i * 13}") for i in range(4000)] + [("de", f"a{i} b{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    size = sum(len(t) for _, t in rows)
    work, width = phrases.Workspace(spark, "test"), phrases.sketch_width(size)
    folder = phrases.sketch_corpus(work, docs, 5, 50, width)
    bits = np.unpackbits(phrases.get_array(f"{folder}/row-0.bin", "u1"))
    assert len(bits) == 1 << width > 1 << 8
    assert sum(counts(rows, 5)[0].values()) / 256 > 50
    assert bits.mean() < 0.1
    monkeypatch.setattr(phrases, "HELD_NGRAMS", 5000)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 20_000)
    assert sorted(tuple(r) for r in phrases.mine_phrases(docs, 5, 50, 50).collect()) == brute(rows, 5, 50, 50)
    assert phrases.sketch_width(10**10) - phrases.sketch_width(10**10 >> 3) == 3
