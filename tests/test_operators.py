"""Golden cases of the operators."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import extraction, fields, metrics, recovery, spans, tokens
from ledgerloom.sources import annotations
from ledgerloom.streaming import rate_limit


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("20.000", 20000.0), ("36.500,00", 36500.0), ("1,818", 1818.0), ("(12.50)", -12.5), ("$1,024.55", 1024.55), ("1-2", None), ("", None), (None, None), ("1.2.3", 1.23)])
def test_currency(spark, text, want):
    assert one(spark, text, S.normalize_currency) == want


@pytest.mark.parametrize(("text", "want"), [("12/01/2025", "2025-01-12"), ("Jan 5, 2024", "2024-01-05"), ("31/02/2024", None), ("2025/1/2", "2025-01-02"), (None, None)])
def test_date(spark, text, want):
    assert one(spark, text, S.normalize_date) == want


def test_artifacts_do_not_cascade(spark):
    assert one(spark, "$1,2OO.5O", lambda c: S.normalize_currency(S.fix_artifacts(c))) == 120.5
    assert one(spark, "$12O0.50", lambda c: S.normalize_currency(S.fix_artifacts(c))) == 1200.5


@pytest.mark.parametrize(("text", "want"), [("73,45", 73.45), ("28.000", 28000.0), ("1.234.567", 1234567.0), ("9.500,00", 9500.0), ("1200.50", 1200.5), (".", None)])
def test_recovery_amount(spark, text, want):
    assert one(spark, text, S.recovery_amount) == want


def test_scalars(spark):
    assert one(spark, "154 000 x", S.merge_space_thousands) == "154000 x"
    assert one(spark, 'noise {"a": [1]} tail', S.json_candidate) == '{"a": [1]}'
    assert one(spark, '{"invoice_number": "INV-1"', S.json_candidate) is None
    assert one(spark, "Invoice No:", S.canonical_field) == "invoice_number"
    assert one(spark, "../../invoice?.pdf", annotations.sanitize_filename) == "invoice_.pdf"
    assert one(spark, "a b", lambda c: F.size(S.hashing_embedding(c))) == 256
    assert one(spark, "abcd", lambda c: S.sequence_ratio(c, F.lit("abxd"))) == pytest.approx(0.75)
    assert one(spark, "January 12, 2025", S.evaluation_date()) == "2025-01-12"


def test_spans_and_pairs(spark):
    words = [("Invoice", "B-KEY", 0.99), ("Number", "I-KEY", 0.98), ("INV-1023", "B-VALUE", 0.97), ("Date", "B-KEY", 0.96), ("2025-01-12", "B-VALUE", 0.95), ("x", "O", 0.9), ("Total", "B-KEY", 0.9)]
    df = spark.createDataFrame([("d", i, t, lab, None, c) for i, (t, lab, c) in enumerate(words)], "doc_id string, pos int, text string, label string, category string, confidence double")
    got = spans.pair_spans(spans.bio_spans(df)).orderBy("span_no").collect()
    assert [(r["status"], r["key"], r["value"]) for r in got] == [("paired", "Invoice Number", "INV-1023"), ("paired", "Date", "2025-01-12"), ("missing_value", "Total", None)]
    assert got[0]["confidence"] == pytest.approx(0.9775)


def test_categories_continue_over_b(spark):
    df = spark.createDataFrame([("d", 0, "a", "B-VALUE", "menu", 1.0), ("d", 1, "b", "B-VALUE", "menu", 1.0), ("d", 2, "c", "I-VALUE", "", 1.0), ("d", 3, "e", "B-VALUE", "sum", 1.0)], "doc_id string, pos int, text string, label string, category string, confidence double")
    assert [r["text"] for r in spans.bio_spans(df).orderBy("span_no").collect()] == ["a b c", "e"]


def test_lines_follow_the_least_y(spark):
    rows = [("d", 0, 1, 100, 0, "a"), ("d", 1, 1, 115, 10, "b"), ("d", 2, 1, 119, 20, "c"), ("d", 3, 2, 100, 0, "p")]
    df = spark.createDataFrame(rows, "doc_id string, pos int, page_number int, y0 int, x0 int, text string")
    assert [r["text"] for r in tokens.group_lines(df).orderBy("line_no").collect()] == ["a b", "c", "p"]


def test_overlap(spark):
    t = "array_sort(array(named_struct('pos',0,'text','Invoice','x0',0,'y0',0,'x1',40,'y1',20,'confidence',0.8D,'page_number',1), named_struct('pos',1,'text','Invoice','x0',0,'y0',0,'x1',40,'y1',20,'confidence',0.9D,'page_number',1)))"
    got = spark.range(1).select(tokens.drop_overlaps(F.expr(t).cast(tokens.TOKEN)).alias("k")).first()["k"]
    assert [x["confidence"] for x in got] == [0.9]


def test_duplicates_average_pairwise(spark):
    df = spark.createDataFrame([("d", "vendor", 0, "a", 0.2), ("d", "vendor", 1, "a", 0.4), ("d", "vendor", 2, "a", 0.9), ("d", "date", 0, "2025-13-40", 0.9), ("d", "date", 1, "2025-01-02", 0.1)], "doc_id string, field string, pos int, value string, confidence double")
    got = {r["field"]: r for r in fields.merge_duplicates(df).collect()}
    assert got["vendor"]["confidence"] == pytest.approx(0.6)
    assert (got["date"]["value"], got["date"]["conflicts"]) == ("2025-01-02", 1)


def test_validation(spark):
    df = spark.createDataFrame([("d", "invoice_number", "***"), ("d", "date", "2025-13-40"), ("d", "total_amount", "not-a-number"), ("d", "vendor", "ok")], "doc_id string, field string, value string")
    got = {r["field"]: r for r in fields.validate(df).collect()}
    assert got["vendor"]["valid"]
    assert {c for r in got.values() for c in r["codes"]} >= {"regex_validation_failed", "invalid_date", "invalid_numeric"}


def test_constraints(spark):
    kind = "doc_id string, total_amount double, line_items array<struct<quantity:double,has_quantity:boolean,unit_price:double>>"
    rows = [("off", 10.0, [(2.0, True, 3.0)]), ("fill", None, [(2.0, True, 3.0)]), ("derive", 25.0, [(None, True, 5.0), (1.0, True, 10.0)]), ("absent", 3.0, [(None, False, 3.0)]), ("none", None, None)]
    got = {r["doc_id"]: r for r in fields.check_amounts(spark.createDataFrame(rows, kind)).collect()}
    assert got["off"]["flags"] == ["line_items_total_mismatch"]
    assert (got["fill"]["flags"], got["fill"]["fixed_total"]) == (["corrected_total_amount_from_line_items"], 6.0)
    assert (got["derive"]["flags"], got["derive"]["fixed_items"][0]["quantity"]) == (["corrected_quantity_derived_from_total"], 3.0)
    assert got["absent"]["flags"] == []


def test_confidence_message(spark):
    df = spark.createDataFrame([("total_amount", 0.2), ("date", 0.55), ("vendor", 0.95)], "field string, confidence double")
    got = {r["field"]: r for r in fields.confidence_policy(df).collect()}
    assert (got["total_amount"]["status"], got["total_amount"]["message"]) == ("dropped", "Field confidence 0.200000 is below threshold 0.600000.")
    assert (got["date"]["status"], got["vendor"]["status"], got["vendor"]["message"]) == ("retained", "kept", None)


def test_total_prefers_grand_total(spark):
    df = spark.createDataFrame([("d", 0, "TOTAL ITEM 3"), ("d", 1, "SUBTOTAL 10.00"), ("d", 2, "GRAND TOTAL 12.50"), ("d", 3, "CASH 20.00"), ("e", 0, "soap 4.25")], "doc_id string, line_no int, text string")
    got = {r["doc_id"]: (r["total"], r["confidence"]) for r in recovery.recover_total(df).collect()}
    assert got == {"d": (12.5, 0.78), "e": (4.25, 0.5)}


def test_line_items_pending_description(spark):
    df = spark.createDataFrame([("d", 0, "Mineral Water"), ("d", 1, "2X 24,000"), ("d", 2, "TOTAL 48,000")], "doc_id string, line_no int, text string")
    assert [(r["description"], r["quantity"], r["unit_price"]) for r in recovery.recover_line_items(df).collect()] == [("Mineral Water", 2.0, 24000.0)]


def test_extraction(spark):
    text = "Invoice Number: INV-1023\nDate: 2025-01-12\nVendor: ABC Corp\nItem: Widget A, Qty: 2, Price: $500.00\nTotal Amount: $1000.00"
    r = extraction.extract_fields(spark.createDataFrame([("d", text), ("n", None)], "doc_id string, text string")).orderBy("doc_id").first()
    assert (r["invoice_number"], r["date"], r["vendor"], r["total_amount"]) == ("INV-1023", "2025-01-12", "ABC Corp", 1000.0)
    assert [tuple(x) for x in r["line_items"]] == [("Widget A", 2.0, 500.0)]


def test_mcnemar(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    assert tuple(metrics.mcnemar(df).first())[:2] == (1, 1)
    assert tuple(metrics.mcnemar(df.filter("a = b")).first()) == (0, 0, 0.0)
    assert metrics.mcnemar_p(0.0) == 1.0


def test_rate_limit(spark):
    df = spark.createDataFrame([(1, i, f"2024-01-01 00:00:{i:02d}") for i in range(3)] + [(1, 9, "2024-01-01 00:01:05")], "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["allowed"] for r in rate_limit.limit_batch(df, 2).orderBy("event_id").collect()] == [True, True, False, True]


def test_rate_limit_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, i, f"2024-01-01 00:00:{i:02d}") for i in range(3)], "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = rate_limit.limit_stream(stream, 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["allowed"] for r in spark.table("limited").orderBy("event_id").collect()] == [True, True, False]


def test_uploads_and_annotations(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"not a png")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r["extension"]: r["error"] for r in annotations.validate_uploads(files).collect()} == {"png": "content_mismatch", "pdf": None}
    (tmp_path / "x.jsonl").write_text('{"image_path": "data/r1.png", "ocr_tokens": [{"text": "a"}, {"text": "b"}]}\n')
    got = annotations.coerce_documents(annotations.read_annotations(spark, str(tmp_path / "x.jsonl"))).first()
    assert (got["doc_id"], got["ocr_text"]) == ("r1", "a\nb")


def test_results_do_not_depend_on_partitioning(spark):
    rows = [("d", i, "t%d" % i, "B-KEY" if i % 3 == 0 else "I-KEY" if i % 3 == 1 else "B-VALUE", "", 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, pos int, text string, label string, category string, confidence double")
    want = spans.pair_spans(spans.bio_spans(df.coalesce(1))).orderBy("span_no").collect()
    assert spans.pair_spans(spans.bio_spans(df.orderBy(F.rand(3)).repartition(7))).orderBy("span_no").collect() == want
