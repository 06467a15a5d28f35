"""Line dedup against brute force, through the mapped and the joined way; the index's levels."""

import hashlib
import random
from collections import Counter

import pytest

from depotry.llm import lines
from depotry.llm.shared import Workspace

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least, chars=1):
    held = Counter(k for t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < max(1, chars) or held[key(x)] < least]
        out.append((len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def corpus(n=120):
    rng = random.Random(9)
    common = ["All rights reserved.", " all RIGHTS reserved. ", "é", "É", "x", "　wide", "Contact\tus"]
    rows = [None, "", "\n\n", "x", "\x1cx", "one " * 4000, "\n".join(["x"] * 500)]
    rows += ["\n".join(rng.choice(common) if rng.random() < 0.3 else f"own line {rng.randint(0, 60)} {i % 40}" for _ in range(rng.randint(1, 9))) for i in range(n)]
    return rows


@pytest.mark.parametrize(("most_mapped", "batches", "fanout", "chars"), [(10**6, 5, 4, 1), (0, 5, 2, 1), (10**6, 1, 4, 3), (0, 7, 2, 4)])
def test_equals_brute_force(spark, most_mapped, batches, fanout, chars):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "z", 7) for i, t in enumerate(rows)], "doc_id long, text string, key string, n_chars long").repartition(3)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs, 10, chars, batches, fanout, most_mapped=most_mapped).collect()}
    want = brute(rows, 10, chars)
    assert sum(w[1] for w in want) > 50
    for i, w in enumerate(want):
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept"]) == w
        assert (got[i]["key"], got[i]["n_chars"]) == ("z", 7)
    digests = {r["doc_id"]: r["kept"] for r in lines.dedup_lines(docs, 10, chars, batches, fanout, digest=True, most_mapped=most_mapped).collect()}
    assert digests[8] == hashlib.sha256(want[8][2].encode()).hexdigest()


def test_index_keeps_few_runs_and_drops_common_keys_early(spark):
    index = lines.LineIndex(spark, Workspace(spark, "index"), min_docs=3, fanout=2)
    for batch in range(7):
        index.add(spark.createDataFrame([(b"often",)] * 3 + [(b"%d" % batch,), (b"thrice",)] if batch < 3 else [(b"often",), (b"%d" % batch,)], "key binary"))
        assert all(len(level) < 2 for level in index.levels)
    assert len(index.runs()) <= 3
    assert {bytes(r["key"]) for r in index.common().collect()} == {b"often", b"thrice"}
    held = {bytes(r["key"]): r["documents"] for run in index.runs() for r in run.collect() if bytes(r["key"]) == b"often"}
    assert held == {b"often": 3}


def test_batches_are_merged_with_the_runs_as_they_lie(spark):
    index = lines.LineIndex(spark, Workspace(spark, "index"), min_docs=2, fanout=3, buckets=6)
    for batch in range(2):
        index.add(spark.createDataFrame([(b"%d" % (i % 50 + batch),) for i in range(100)], "key binary"))
    plan = index.unseen(spark.createDataFrame([(b"1", 1)], "key binary, documents long"))._jdf.queryExecution().sparkPlan().toString()
    final = index.unseen(spark.createDataFrame([(b"1", 1)], "key binary, documents long"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2
    assert final.count("Exchange") == 1  # the batch itself, to the buckets
    assert final.count("Sort [key") == 1
    assert index.common()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    names = [name for level in index.levels for name in level]
    index.close()
    assert not any(spark.catalog.tableExists(name) for name in names)


def test_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a\nb", "x", 1, 2, 3)] * 12, "`KEPT` int, text string, N_Lines string, __row int, rest int, `key` int")
    for most in (-1, 10):
        got = lines.dedup_lines(docs, 10, most_mapped=most)
        assert got.columns == ["__row", "rest", "key", "n_lines", "n_dropped", "kept"]
        assert [tuple(r) for r in got.collect()] == [(1, 2, 3, 2, 2, "")] * 12
    assert lines.dedup_lines(docs.select("text")).columns == list(lines.RESULTS)


def test_long_text(spark):
    text = "\n".join(f"line {i % 1000}" for i in range(200_000)) + "\n" + "w " * 500_000
    docs = spark.createDataFrame([(1, text), (2, "line 7\nown")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs, 2).collect()}
    assert (got[1]["n_lines"], got[1]["n_dropped"]) == (200_001, 200)
    assert got[2]["kept"] == "own"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(docs).count() == 0
    assert lines.dedup_lines(docs, most_mapped=-1).count() == 0
