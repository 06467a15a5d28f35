"""The registered queries on the smallest tables: against their SQL, or against brute force where SQL cannot express them."""

import glob
import math
import os
import zlib

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from depotry.llm.queries import ORACLES, QUERIES, TOKENIZER
from test_lm import brute as brute_lm
from test_packing import check_packed
from test_quality import brute_counts
from test_urls import brute as brute_urls

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    a, b = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)

    def shape(df):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            df[c] = df[c].map(lambda v: "" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v))
        return df.sort_values(list(df.columns)).reset_index(drop=True)

    pd.testing.assert_frame_equal(shape(a), shape(b), check_dtype=False)


def test_packing(spark):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in table("documents")}
    rows = [r.asDict() for r in QUERIES["op2_packing"](spark, SF).collect()]
    n = check_packed(rows, want, 2048)
    assert n <= -(-sum(map(len, want.values())) // 2048) + 1


def test_links(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op3_links"](spark, SF).collect()}
    groups = {r["doc_id"]: r for r in QUERIES["op3_jaccard"](spark, SF).collect()}
    assert rows.keys() == groups.keys()
    sizes = pd.Series([g["component_id"] for g in groups.values()]).value_counts()
    for i, r in rows.items():
        assert (r["n_links"] > 0) == (sizes[groups[i]["component_id"]] > 1)
        assert r["n_links"] < sizes[groups[i]["component_id"]]


def test_quality(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op4_quality"](spark, SF).collect()}
    assert len(rows) == len(table("documents"))
    right = []
    for r in table("labels"):
        got = rows[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= got["score"] <= 1
        assert got["predicted"] == (got["score"] >= 0.7)
        if got["held_out"]:
            right.append(got["predicted"] == r["quality"])
    assert sum(right) >= 0.9 * len(right)


def test_rules(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op6_rules"](spark, SF).collect()}
    for d in table("documents"):
        r, want = rows[d["doc_id"]], brute_counts(d["text"])
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_extraction(spark):
    rows = {r["page_id"]: r for r in QUERIES["op9_extraction"](spark, SF).collect()}
    pages = table("pages")
    assert len(rows) == len(pages)
    for p in pages:
        assert rows[p["page_id"]]["n_chars"] == len(rows[p["page_id"]]["text"])
        assert rows[p["page_id"]]["url"] == p["url"]
        assert not {"<p", "</", "<script"} & {rows[p["page_id"]]["text"][i : i + n] for i in range(rows[p["page_id"]]["n_chars"]) for n in (2, 7)}


def test_lm_scoring(spark):
    docs = table("documents")
    held = [zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0 for d in docs]
    want, n = brute_lm([d["text"] for d, h in zip(docs, held, strict=True) if not h], [d["text"] for d in docs])
    rows = {r["doc_id"]: r for r in QUERIES["op10_lm_scoring"](spark, SF).collect()}
    for d, h, w in zip(docs, held, want, strict=True):
        r = rows[d["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, *w[:2], n)
        assert math.isclose(r["base_score"], w[2], rel_tol=1e-9)
        assert math.isclose(r["score"], w[3], rel_tol=1e-9)


def test_urls(spark):
    rows = sorted(table("pages"), key=lambda r: r["page_id"])
    want, _, _ = brute_urls([r["url"] for r in rows], 1 << 17)
    got = {r["page_id"]: r for r in QUERIES["op12_urls"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r, (host, path, rule, verdict, score) in zip(rows, want, strict=True):
        g = got[r["page_id"]]
        assert (g["host"], g["path"], g["rule"]) == (host, path, rule)
        assert g["verdict"] == (verdict or g["verdict"]) and g["verdict"] in ("allow", "block")
        assert g["score"] == pytest.approx(score, abs=1e-9)
    least = min((g["score"] for g in got.values() if g["rule"] is None and g["verdict"] == "allow"), default=math.inf)
    assert all(g["score"] < least for g in got.values() if g["rule"] is None and g["verdict"] == "block")
