"""The driver's contract, and queries against their SQL on the smallest tables."""

import glob
import importlib
import os
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from depotry.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    a, b = __spark_entry__.queries()[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)

    def shape(df):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            df[c] = df[c].map(lambda v: "" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v))
        return df.sort_values(list(df.columns)).reset_index(drop=True)

    pd.testing.assert_frame_equal(shape(a), shape(b), check_dtype=False)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    rows = __spark_entry__.queries()[name](spark, SF).collect()
    assert rows
    assert all(any(v is not None for v in r) for r in rows)


def test_entry_without_the_training_data_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("depotry.llm")] + ["corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.setitem(sys.modules, "depotry.llm", None)
    alone = importlib.reload(__spark_entry__)
    assert set(alone.oracle_sql()) == set(ORACLES)
    assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in alone.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
