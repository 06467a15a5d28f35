"""Groups of the n-gram Jaccard join against brute force over all pairs."""

import random
import re

import pytest

from depotry.llm.jaccard import jaccard_groups, jaccard_join, link_counts


def sets_of(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, num, den):
    sets, parent = [sets_of(t, n) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for size in (1, 2, 3, 5, 12, 40, 60, 150, 150, 300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        if rng.random() < 0.5:
            base[: len(base) // 2] = passage[: len(base) // 2]
        for _ in range(rng.choice((1, 2, 6, 25))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                at = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[at] = rng.choice(vocabulary)
                elif rng.random() < 0.5 and len(copy) > 1:
                    del copy[at]
                else:
                    copy.insert(at, "new")
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
    rows += [None, "", " \n\t", "one", "ONE", "a b", "a  B", "b a", "a b c"]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 2, 50), (5, 3, 70)])
def test_groups_equal_brute_force(spark, seed, n, num):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(docs, n, num, 100).collect()}
    assert got == brute(rows, n, num, 100)


@pytest.mark.parametrize(("seed", "matches"), [(6, (4,)), (7, (2, 5)), (8, (50,)), (9, (8,))])
def test_groups_whatever_the_matches(spark, seed, matches):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(docs, 3, 80, 100, matches).collect()}
    assert got == brute(rows, 3, 80, 100)


def test_odd_tables(spark):
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", None), (None, "z z", None), (4, "q " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in jaccard_groups(docs).collect()), key=str)
    assert got == [(0, 1), (0, None), (1, 1), (1, 1), (4, 4)]


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 3, 90), (3, 5, 80), (4, 2, 50)])
def test_every_link_is_found(spark, seed, n, num):
    rng, rows = random.Random(seed), corpus(seed)
    base = [f"v{i}" for i in range(200)]
    for i in range(30):  # one group of differing near copies: far more links than connect it
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((20_000 + i, " ".join(copy)))
    rows += [(20_000, " ".join(base)), (None, " ".join(base)), (None, " ".join(base[1:]))]  # ids repeated and null
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = [sets_of(t, n) for _, t in rows]
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= num * len(a | b)]
    want = sorted((str(d), len(s), sum(i == k for i, _ in linked)) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["n_links"]) for r in link_counts(docs, n, num, 100).collect()) == want
    members, links = jaccard_join(docs, n, num, 100)
    different = {frozenset((frozenset(sets[i]), frozenset(sets[j]))) for i, j in linked if sets[i] != sets[j]}
    assert links.count() == links.distinct().count() == len(different)
    assert members.count() == len(rows)
