"""The chain in plain Python against the single stages as expressions, on made documents with odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import benchmarks, chain, packed

TOKENS = "doc_id string, pos int, text string, confidence double, x0 int, y0 int, page_number int"
WORDS = [
    "Invoice", "Number", ":", "No", "#", "INV-12", "inv_7/3", "Date", "05/01/2024", "2024-1-5", "31.12.2023", "Jan", "5,", "2024", "5 March 2031", "Mar 5 2024", "2024-02-30", "Total", "TOTAL", "Amount", "Due", "$1,200.50", "(12.50)", "1.234", "1,234", "12,5", "1.2.3", "1,2,3", "28.000", "5O.l0", "Subtotal", "Tax",
    "Grand", "Cash", "Blue", "Store", "Corner", "Corp", "Tea", "Cake", "2x", "2", "3 x", "x", "@", "1000", "3000", "100", "000", "60000000", "7.5", "-3", "- Milk -", "", " ", None, " ", "café total", "K", "ſub", "a b", "a\nb", "q\"\\\x1b€", "items", "total qty", "0.0000005", "99", "9900",
]


def made(n, seed, labelled=False):
    pick, rows = random.Random(seed), []
    for d in range(n):
        pos = 0
        for line in range(pick.randrange(1, 9)):
            for j in range(pick.randrange(1, 6)):
                row = (f"d{d}", pos, pick.choice(WORDS), pick.choice([0.2, 0.5, 0.61, 0.9, None]), pick.choice([50 * j, 0, None]), pick.choice([30 * line, 30 * line + 7, None]), pick.choice([1, 1, 1, 2, None]))
                rows.append((*row, pick.choice(["O", "b-key", "I-KEY", "B-VALUE", " I-VALUE", "B-KEY\n", "junk", None]), pick.choice(["", "p", None])) if labelled else row)
                pos += 1
    return rows


def receipts(n, seed):
    pick, rows = random.Random(seed), []
    for d in range(n):
        lines = [["Blue", "Corner", "Store"], ["INVOICE", "NO", f"INV-{d}"], ["DATE", pick.choice(["2024-01-05", "5/1/2024", "Jan 5 2024", "2031-01-05", "soon"])]]
        lines += [pick.choice([["Tea", "2", "1000"], ["2x", "Cake", "60000000"], ["Milk", "1500"], ["Long", "name"], ["3", "2,500"], ["***"], ["4", "Bun", "x", "@", "12.345,50"]]) for _ in range(pick.randrange(1, 6))]
        lines += pick.choice([[["PAYMENT"]], [["GRAND", "TOTAL", str(pick.choice([2000, 11000, 5000]))]], [["Total", "qty", "3"], ["Net", "9", "900"]], []])
        rows += [(f"d{d}", 100 * i + j, w, 0.9, 40 * j, 30 * i, 1, "O") for i, line in enumerate(lines) for j, w in enumerate(line)]
    return rows


def same(df, **more):
    key = lambda r: r["doc_id"]
    got, want = (sorted(f(df, "2030-01-01", **more).collect(), key=key) for f in (packed.documents, packed.by_stages))
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert a.asDict(True) == b.asDict(True)


@pytest.mark.parametrize("more", [{}, {"with_recovery": False}, {"repair": False, "drop": False, "threshold": 0.8}, {"with_constraints": False, "aliases": {"blue store": "vendor", "date": "due_date", "total": "total_amount"}}])
def test_documents_equal_the_stages(spark, more):
    same(spark.createDataFrame(made(400, 1), TOKENS), **more)
    same(spark.createDataFrame(receipts(400, 2), TOKENS + ", label string"), **more)


def test_labelled_documents_equal_the_stages(spark):
    same(spark.createDataFrame(made(400, 3, True), TOKENS + ", label string, category string"))


def test_chain_is_no_lambda_plan(spark):
    plan = packed.documents(spark.createDataFrame(made(2, 1), TOKENS), "2030-01-01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan


def test_numbers_are_written_as_by_java(spark):
    values = [0.125, 2.5, 0.0000005, 1.0000005, 1e7, 12345678.9, 1e-4, 0.001, 123456789012345680.0, 1000520240501202432.0, -1220245203105011968.0, 9.1e18, 2.0**53, 2.0**62 + 4096, -0.0, -1.5, 0.1, 1 / 3, 9.999999e6]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", packed.number_text(F.col("v")).alias("n"), packed.amount_text(F.col("v")).alias("a"), F.to_json(F.array(F.struct(F.lit('a"\\\x1b').alias("description"), F.col("v").alias("quantity"), F.lit(None).cast("double").alias("unit_price")))).alias("j")).collect()
    for r in got:
        assert (chain.number_text(r["v"]), chain.amount_text(r["v"]), chain.items_json([('a"\\\x1b', r["v"], None)])) == (r["n"], r["a"], r["j"])


def test_systems_equal_the_stages(spark):
    df = spark.createDataFrame(made(150, 5), TOKENS)
    truth = F.lit('{"date": "2024-01-05", "total_amount": 1200.5, "Invoice_number ": "INV-12"}')
    samples = packed.pack(df).select("doc_id", F.when(F.col("doc_id") == "d3", F.slice("t", 1, 0)).otherwise(F.col("t")).alias("t"), truth.alias("truth"))
    got = benchmarks.run(samples, "2030-01-01")
    true = benchmarks.payloads.pairs_of(F.try_parse_json("truth"))
    staged = benchmarks.systems(benchmarks.settled(samples, {"true": true}).drop("truth"), packed.label)
    want = benchmarks.scores(benchmarks.outputs(staged, "2030-01-01"))
    key = lambda r: (r["doc_id"], r["variant"])
    rows = [sorted((r.asDict(True) for r in x.collect()), key=key) for x in (got, want)]
    assert len(rows[0]) == 150 * 11 and rows[0] == rows[1]
