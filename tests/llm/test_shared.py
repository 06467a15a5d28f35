"""Scanning, shards and components."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depotry.llm import shared, textscan
from depotry.llm.components import components
from depotry.llm.hashcount import summed


def words(text, fold=True):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) if fold else w for w in found]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é　\n\t\r\x0b\x1c.,", max_size=40)), max_size=12), st.sampled_from([4, 16, 1 << 20]), st.booleans())
def test_scan_finds_the_words(rows, segment, fold):
    textscan.SEGMENT, old = segment, textscan.SEGMENT
    try:
        seen = {}
        for column in (pa.array(rows, pa.string()), pa.array([None, "pad", *rows], pa.large_string()).slice(2)):
            got = [None] * len(rows)
            for i, hashes, at in textscan.scan(column, fold):
                for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True), i):
                    got[r] = hashes[a:b].tolist()
            for text, hashes in zip(rows, got, strict=True):
                own = words(text, fold)
                assert len(own) == len(hashes or [])
                for w, h in zip(own, hashes or [], strict=True):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
    finally:
        textscan.SEGMENT = old


def test_very_long_word_and_text():
    texts = ["x" * 3_000_000, "ab " * 900_000, "", "end"]
    counts = {}
    for i, _, at in textscan.scan(pa.array(texts)):
        counts.update({i + r: int(n) for r, n in enumerate(np.diff(at))})
    assert [counts.get(i, 0) for i in range(4)] == [1, 900_000, 0, 1]


def test_sums_and_arrays(tmp_path):
    rng = np.random.default_rng(0)
    keys, counts = rng.integers(0, 50, 1000).astype(np.uint64), rng.integers(1, 9, 1000).astype(np.uint64)
    own, total = summed(keys, counts)
    assert own.tolist() == sorted(set(keys.tolist()))
    assert all(t == counts[keys == k].sum() for k, t in zip(own, total, strict=True))
    shared.put_array(f"file://{tmp_path}/a.bin", own)
    assert shared.get_array(f"file://{tmp_path}/a.bin", "u8").tolist() == own.tolist()
    shared.put_array(f"file://{tmp_path}/b.bin", own[:0])
    assert len(shared.get_array(f"file://{tmp_path}/b.bin", "u8")) == 0
    cuts = shared.split_sorted(np.sort(rng.integers(0, 2**64, 500, np.uint64)), 7)
    assert cuts[0] == 0
    assert cuts[-1] == 500
    assert (np.diff(cuts) > 30).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(200, 240)] + [(500, 500 + i) for i in range(1, 60)] + [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(60)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3), shared.Workspace(spark, "test")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long"), shared.Workspace(spark, "test")).count() == 0


def test_forget_gives_back_what_arrow_keeps(monkeypatch):
    released = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: released.append(1)})())
    shared.once("own object", list)
    shared.forget()
    assert released
    assert "own object" not in shared._ONCE
