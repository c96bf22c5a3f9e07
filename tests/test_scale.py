"""Plans and memory of steps that grew faster than their input: what is dealt out again, gathered or held."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import hashing_embedding
from ledgerloom.operators import labels, metrics, packed, parsing, retrieval

TOKENS = "doc_id long, pos int, text string, confidence double, x0 int, y0 int, page_number int"


def tokens(spark):
    said = [["Invoice", "Number", ":", "INV-1", "Date", "05/01/2024", "Total", "Amount", "$12.50"], ["Date", "2024-01-05", "inv-2", "INV-3"], ["Total", "x"], ["Date", "Total", "Date", "soon"]]
    return spark.createDataFrame([(d, i, w, 0.4 + 0.1 * d, i % 4 * 50, i // 4 * 30, 1) for d, ws in enumerate(said) for i, w in enumerate(ws)], TOKENS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_compared_within_their_row(spark):
    rows = [(1, "a b b c", "b b b a"), (2, None, "x"), (3, "", None), (4, "1.5 é z", "z 1.5 1.5")]
    df = spark.createDataFrame(rows, "doc_id long, predicted string, truth string")
    got = metrics.text_overlap(df)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 4, 4), (2, 0, 0, 1), (3, 0, 0, 0), (4, 2, 2, 3)]
    assert "Exchange" not in plan(got)


def test_summaries_and_warnings_of_packed_documents(spark):
    t = tokens(spark)
    docs = packed.documents(t, "2030-01-01", keep=("t",))
    parsed = parsing.parse(t, "2030-01-01")
    for a, b in zip(sorted(parsing.packed_summary(docs).collect()), sorted(parsing.confidence_summary(parsed).collect()), strict=True):
        assert (a[0], *[round(x, 12) for x in a[1:]]) == (b[0], *[round(x, 12) for x in b[1:]])
    pages = spark.range(6).select(F.col("id").alias("doc_id"), (F.col("id") % 2 + 1).alias("page_count"))
    assert sorted(parsing.packed_warnings(pages, docs).collect()) == sorted(parsing.warnings(pages, t, parsed).collect())
    assert plan(parsing.packed_summary(docs)).count("Exchange hash") == 1


def test_alias_pairs_take_no_window(spark):
    got = labels.alias_pairs(tokens(spark))
    assert "Window" not in plan(got)
    assert sorted((r["doc_id"], r["field"], r["value"]) for r in got.collect()) == [(0, "date", "05/01/2024"), (0, "total_amount", "Amount"), (1, "date", "2024-01-05"), (2, "total_amount", "x"), (3, "date", "soon")]


def test_nearest_holds_a_bounded_product(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(3000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["vec_id", "embedding"])
    asked = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.concatenate([np.arange(3000)] * 3)
    tracemalloc.start()
    out = next(retrieval.best_of(iter([batch]), ids, np.concatenate([asked] * 3), 5))
    assert tracemalloc.get_traced_memory()[1] < 120_000_000
    tracemalloc.stop()
    score = np.rint(asked @ asked.T * 10**12)
    np.fill_diagonal(score, -np.inf)
    assert out.column("vec_id").to_pylist()[: 3000 * 5] == np.lexsort((np.broadcast_to(np.arange(3000), score.shape), score))[:, -5:][:, ::-1].ravel().tolist()


def test_embedding_counts_without_a_lambda_for_each_word(spark):
    df = spark.createDataFrame([("a b a",), ("",)], "t string").select(hashing_embedding("t", 4).alias("e"))
    assert "array_remove" in plan(df)
    assert [round(sum(x * x for x in r["e"]), 9) for r in df.collect()] == [1.0, 0.0]
