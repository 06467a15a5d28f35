"""Packing: an exact round trip through the tokenizer, and valid, tight sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from depotry.llm import packing
from depotry.llm.textscan import text_buffers

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "  \n ", "Hello, World!!", "don't we'll I'D x's'", "naïve CAFÉ éáb ́z", "İstanbul ẞ ΣΑΣ", "12ab 3.14 a1.", "<|endoftext|> <|ENDOFTEXT|> a<|endoftext|>.",
    "a\x1cb\x85c d e", "&&&*** ***", "''' \"quoted.\"", "日本語 テキスト。", "q" * 300 + " " + "z9" * 200, "word " * 5000, "\U0001f600 smile\U0001f600",
]


def check_packed(rows, want_ids, room):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, ids in want_ids.items():
        pieces = sorted(by_doc.pop(doc), key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        for p in pieces:
            assert p["start"] == p["piece"] * room
            part = ids[p["start"] : p["start"] + room]
            assert p["length"] == len(part)
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            if "ids" in p:
                assert p["ids"] == part
    assert not by_doc
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(by_seq)


def test_ids_and_places(spark):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(ODD)}
    for room in (7, 2048):
        rows = [r.asDict() for r in packing.pack(docs.repartition(3), PATH, room, 0, with_ids=True).collect()]
        check_packed(rows, want, room)


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_ids_whatever_is_remembered(monkeypatch, block):
    monkeypatch.setattr(packing, "WORDS_KEPT", 3)
    monkeypatch.setattr(packing, "BLOCK", block)
    rng = random.Random(6)
    parts = ["the", "The", "café", "CAFÉ", ".", ",", "!", " ", " ", "  ", "\n", "é.", "×.", "x1.", "1,", "...", "%%%", "'s", "don't.", "ß;", "»,", "Σ:", "a\u0301.", "<", "|", "<|endoftext|>", "\u00a0", "\u2028.", "x" * 60]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    coder, tokenizer = packing.WordCoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        for t, ids in zip(texts, coder.blocks(*text_buffers(pa.array(texts))), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_length(seed):
    rng, room = random.Random(seed), 256
    kinds = [lambda: rng.randint(1, room), lambda: rng.randint(1, room // 6), lambda: rng.choice((90, 86, 85, 171)), lambda: room, lambda: rng.randint(room // 3, room // 2), lambda: min(room, int(rng.expovariate(1 / 60)) + 1)]
    lengths = [kinds[seed]() for _ in range(3000)]
    counts = np.bincount(lengths, minlength=room + 1)
    placed, bins = np.zeros(room + 1, int), 0
    for m, content in packing.plan_bins(counts, room):
        assert sum(content) <= room
        bins += m
        for length in content:
            placed[length] += m
    assert (placed == counts).all()
    free = []  # plain first-fit decreasing
    for length in sorted(lengths, reverse=True):
        for i, f in enumerate(free):
            if f >= length:
                free[i] -= length
                break
        else:
            free.append(room - length)
    assert bins <= len(free) * 1.005 + 1


def test_empty_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    docs = spark.createDataFrame([(1, "same text", 5)] * 40 + [(None, "no id", 1)], "doc_id long, text string, length long")
    rows = packing.pack(docs, PATH, 64).collect()
    assert len(rows) == 41
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 41


def test_small_tables_are_dealt_too():
    counts = np.zeros(257, int)
    counts[130], counts[120] = 30, 30
    bins, made = packing.plan(counts, 256)
    assert sum(m for m, _ in made) == 30
    assert all(sorted(content) == [120, 130] for _, content in made)
    assert sum(m for m, _ in bins) == 30


@pytest.mark.parametrize("seed", range(4))
def test_patterns_make_most_sequences_of_large_pieces(seed):
    rng, room = np.random.default_rng(seed), 2048
    lengths = np.concatenate([np.full(600, room), np.clip(rng.gamma(2, 500, 6000).astype(int) + 1, 1, room)])
    counts = np.bincount(lengths, minlength=room + 1)
    bins, made = packing.plan(counts, room)
    several = sum(m for m, content in bins if len(content) > 1 and 2.5 * content[0] > room)
    combined = sum(m for m, content in made if len(content) > 1)
    shorter = sum(m for m, content in made if content != (room,))
    assert shorter > 0.8 * several
    assert combined > 0.25 * several
    assert sum(m for m, _ in bins) <= 1.005 * -(-lengths.sum() // room)


@pytest.mark.parametrize(("room", "k", "low"), [(256, 12, 86), (256, 9, 65), (200, 8, 34), (100, 6, 12), (64, 1, 64)])
def test_best_pattern_is_worth_most(room, k, low):
    rng = random.Random(room + k)
    for _ in range(40):
        sizes = np.array(sorted(rng.sample(range(low, room + 1), k)))
        worth = np.array([rng.choice([0.0, rng.random(), 0.5]) for _ in sizes])
        most = [0.0] * (room + 1)
        for c in range(room + 1):
            most[c] = max([0.0, *(most[c - s] + w for s, w in zip(sizes.tolist(), worth.tolist()) if s <= c)])
        value, column = packing._best_pattern(sizes, worth, room)
        assert column @ sizes <= room
        assert abs(value - most[room]) < 1e-9


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words here", "x", 1)], "doc_id long, text string, SEQUENCE_ID string, bucket int")
    rows = packing.pack(docs, PATH).collect()
    assert [(r["doc_id"], r["piece"], r["offset"]) for r in rows] == [(1, 0, 0)]


def test_slots_pass_no_python_worker(spark):
    docs = spark.createDataFrame([(i, "some text " * i) for i in range(9)], "doc_id long, text string")
    plan = packing.pack(docs, PATH, 64)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan
    assert "ExistingRDD" not in plan
