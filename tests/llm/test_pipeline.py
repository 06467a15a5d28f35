"""The pipeline's stages on a small corpus, each against what it must do."""

import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from depotry.llm.jaccard import representatives
from test_jaccard import brute


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, at = random.Random(12), tmp_path_factory.mktemp("data")
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(300)]

    def line(n):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    rows, labels = [], []
    for i in range(240):
        good = i % 4 > 0
        text = "\n".join(line(rng.randint(6, 30)) for _ in range(rng.randint(1, 8)))
        if not good:
            text = " ".join(w + rng.choice(("%%%", "###")) for w in text.split())
        if i % 3 == 0:
            text = "All rights reserved by nobody.\n" + text
        if i % 20 == 7:
            text = rows[-1][1] + " end"
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
        labels.append((i, int(good if i % 20 != 7 else (i - 1) % 4 > 0), 0))
    rows += [(900, "", "en", "src0", 0), (901, None, None, None, None)]
    pq.write_table(pa.table(dict(zip(corpus_pipeline.COLUMNS, map(list, zip(*rows, strict=True)), strict=True))), at / "documents.parquet")
    pq.write_table(pa.table({k: pa.array(v, pa.int32() if k != "doc_id" else pa.int64()) for k, v in zip(("doc_id", "quality", "toxic"), zip(*labels, strict=True), strict=True)}), at / "labels.parquet")
    return str(at), rows, labels


def test_stages(spark, folder):
    at, rows, labels = folder
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, at)
        if name != "best-fit packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
    good = {i for i, y, _ in labels if y}
    kept = {r["doc_id"] for r in seen["quality classifier"][1]}
    assert good <= kept
    assert len(kept & {i for i, y, _ in labels if not y}) <= 3
    before, after = seen["line dedup"]
    assert len(after) == len({r["doc_id"] for r in before})
    assert not any("reserved by nobody" in r["text"] for r in after)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["n-gram Jaccard join"]
    want = brute([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
    assert {r["doc_id"] for r in after} == {c for _, c in want.values()}
    before, after = seen["mixing sources to target weights"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = seen["best-fit packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    single = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0] for r in before}
    assert sum(r["length"] for r in after) == sum(len(single[r["doc_id"]]) for r in before)
    once = [r["doc_id"] for r in before]
    unique = [r for r in after if once.count(r["doc_id"]) == 1]
    assert len({(r["sequence_id"], r["offset"]) for r in after}) == len(after)
    assert {r["doc_id"] for r in unique} == {d for d in once if once.count(d) == 1}


def test_run_is_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0])
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row_id"]
    assert rows.count() > 100


def test_one_row_of_each_group_stays(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(5, text, 1), (3, text, 2), (3, text, 3), (None, text, 4), (None, "other", 5), (9, None, 6)], "doc_id long, text string, n int")
    assert sorted(r["text"] or "" for r in representatives(docs).collect()) == ["", text, "other"]


def test_sequences_hold_the_tokens(spark, folder):
    rows = corpus_pipeline.sequences(spark, folder[0]).collect()
    assert 0 < max(len(r["ids"]) for r in rows) <= 2048
    assert sum(i == 0 for r in rows for i in r["ids"]) > 50


@pytest.mark.parametrize("stage", range(5))
def test_each_stage_on_odd_rows(spark, folder, stage):
    name, run = corpus_pipeline.STAGES[stage]
    long = "one two three four five six seven. " * 60_000
    rows = [(1, long, "en", "src0", 1), (1, long, "en", "src0", 1), (2, "", "en", "src1", 0), (3, None, None, None, None), (None, "Words of a row without an id stand here.", "en", "src2", 3), (4, "a b", "en", "src0", 3)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], f"{kind}, kept int, SCORE string, row_id string")
    out = run(spark, docs, folder[0])
    got = out.collect()
    if stage < 4:
        assert out.columns == list(corpus_pipeline.COLUMNS)
        assert all(r["doc_id"] in (None, 1, 2, 3, 4) for r in got)
    if stage == 1:
        assert sorted(len(r["text"]) for r in got) == sorted(len(t or "") for _, t, *_ in rows)
    if stage == 2:
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "4", "None"]
    if stage == 4:
        whole = {}
        for r in got:
            whole[r["row_id"]] = whole.get(r["row_id"], 0) + r["length"]
        assert len(whole) == len(rows)
        assert sorted(whole.values())[-1] == sorted(whole.values())[-2] > 400_000
    empty = run(spark, docs.limit(0), folder[0])
    assert (empty.count(), len(empty.columns)) == (0, len(out.columns))


def test_copies_of_a_document_are_told_apart(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert len({(r["row_id"], r["piece"]) for r in rows}) == len(rows)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) < len(rows)
