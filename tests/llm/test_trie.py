"""Prefix trie against brute force: collisions, long conversations over many ranges, odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from depotry.llm import trie


def brute(rows, group=20, most=4, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode()))] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most if rebuild else 0
        base = c - (c % group if c >= 0 else -(-c % group))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in children[p])
    said = {p: ",".join(map(str, sorted(ends[p]))) for p in members}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(said[p].encode()).hexdigest()) for p, m in members.items())


def corpus(n=90, seed=3):
    rng = random.Random(seed)
    said = ["hi", "hello there", "", None, "é\u3000x", "a\tb  c", "yes"]
    rows = []
    for c in [*range(n), -3, -25, 10**12 + 7, 400, 401]:
        turns = [(t, rng.choice(["user", "assistant", None, ""]), rng.choice(said)) for t in range(rng.randint(1, 6))]
        rows += [(c, t, r, x) for t, r, x in turns]
    rows += [(7, None, "user", "first"), (8, 1, "user", "hi"), (8, 1, "user", "hi"), (None, 0, "user", "lost"), (200, 0, "u", "only")]
    rows += [(c, t, "user", "same") for c in range(300, 330) for t in range(3)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, depth string, rep long").repartition(3)


@pytest.mark.parametrize(("moduli", "range_rows"), [(trie.MODULI, 1 << 20), ((7, 5), 1 << 20), ((2, 2), 40)])
def test_equals_brute_force(spark, moduli, range_rows):
    rows = corpus()
    assert sorted(tuple(r) for r in trie.rebuilt_trie(frame(spark, rows), moduli=moduli, range_rows=range_rows).collect()) == brute(rows)


def test_plain_conversations_and_one_very_long(spark):
    rows = [(c, t, "user", f"t{t}" if t != 150 or c else "other") for c in range(3) for t in range(300 - 40 * c)] + [(9, t, "user", "t0") for t in range(5)]
    got = trie.conversation_trie(frame(spark, rows), range_rows=60)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, rebuild=False)


def test_ends_span_several_lists(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN", 10)
    rows = [(c, t, "user", "same") for c in range(-30, 95, 3) for t in range(2)]
    assert sorted(tuple(r) for r in trie.rebuilt_trie(frame(spark, rows)).collect()) == brute(rows)


def test_empty_table(spark):
    assert trie.rebuilt_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
