"""Every registered query with SQL gives DuckDB's rows, on the smallest tables."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry_module
from ledgerloom.plans import document_queries, experiment_queries
from ledgerloom.plans.queries import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return f"{float(v):.9g}"
    return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(map(str, map(plain, r))) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    assert len(got) and document_queries and experiment_queries
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 2
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_topk_chunks_indexes_every_document(spark, monkeypatch):
    from ledgerloom.operators import retrieval

    seen, plain_retrieve = {}, retrieval.retrieve

    def spy(index, queries, k):
        seen["index"], seen["queries"] = index, queries
        return plain_retrieve(index, queries, k)

    monkeypatch.setattr(retrieval, "retrieve", spy)
    out = QUERIES["topk_chunks"](spark, DIR)
    with_text = spark.read.parquet(f"{DIR}/documents.parquet").filter("trim(text) <> ''").count()
    assert seen["index"].select("doc_id").distinct().count() == with_text
    assert seen["queries"].filter("doc_id % 20 <> 0").count() == 0 and out.filter("doc_id % 20 <> 0").count() == 0 and out.count() > 0
    assert "Scan ExistingRDD" in out._jdf.queryExecution().toString()
