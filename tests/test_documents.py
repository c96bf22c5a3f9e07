"""Golden cases of parsing, evaluation, conversion and the offline pipelines."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import conversion, evaluation, extraction, labels, offline, parsing, recovery

WORDS = ["Invoice", "Number", "INV-1023", "Date", "2025-01-12", "Total", "Amount", "1200.50"]
TOKENS = "doc_id string, pos int, text string, confidence double, x0 int, y0 int, page_number int"
DOC = "struct<invoice_number:string,date:string,vendor:string,total_amount:string,line_items:array<struct<description:string,quantity:double,unit_price:double>>>"


def token_rows(doc, words, conf=0.95, page=1, start=0):
    return [(doc, start + i, w, conf, i * 50, 0, page) for i, w in enumerate(words)]


def test_alias_labels(spark):
    rows = token_rows("a", ["Invoice", "Number", ":", "INV-1023"]) + token_rows("b", WORDS) + token_rows("c", ["nothing", "here"])
    got = {}
    for r in labels.alias_labels(spark.createDataFrame(rows, TOKENS)).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["label"])
    assert got == {"a": ["B-KEY", "I-KEY", "O", "B-VALUE"], "b": ["B-KEY", "I-KEY", "B-VALUE", "B-KEY", "B-VALUE", "B-KEY", "I-KEY", "B-VALUE"], "c": ["O", "O"]}


def test_parse_and_warnings(spark):
    rows = token_rows("ok", WORDS) + token_rows("noisy", ["Inv0ice", "??"], 0.3) + token_rows("part", ["Date", "2025-01-12"], 0.9) + token_rows("two", WORDS) + token_rows("two", ["Invoice", "Number", "INV-2048"], 0.9, 2, 8)
    tokens = spark.createDataFrame(rows, TOKENS)
    parsed = parsing.parse(tokens, "2026-01-01")
    got = {(r["doc_id"], r["field"]): r for r in parsed.collect()}
    assert {f: got["ok", f]["value"] for f in ("invoice_number", "date", "total_amount")} == {"invoice_number": "INV-1023", "date": "2025-01-12", "total_amount": "1200.5"}
    assert got["ok", "date"]["confidence"] == pytest.approx(0.95) and all(got["ok", f]["valid"] and not got["ok", f]["codes"] for f in ("invoice_number", "date", "total_amount"))
    assert got["part", "total_amount"]["codes"] == ["missing_required_field"] and "conflicting_values" in got["two", "invoice_number"]["codes"]
    docs = spark.createDataFrame([("ok", 1), ("noisy", 1), ("part", 1), ("two", 2), ("none", 1)], "doc_id string, page_count int")
    said = {r["doc_id"]: r["warnings"] for r in parsing.warnings(docs, tokens, parsed).collect()}
    assert said["ok"] == [] and "noisy_ocr_output" in said["noisy"] and "missing_required_fields" in said["part"] and said["none"] == ["empty_document"]
    assert said["two"].count("multi_page_inconsistency") == 2
    summary = {r["doc_id"]: r for r in parsing.confidence_summary(parsed).collect()}
    assert (summary["ok"]["kept_fields"], summary["ok"]["dropped_fields"]) == (3, 0)


def test_recovery_keeps_what_is_pending(spark):
    lines = [("d", 0, "Mineral Water"), ("d", 1, "***"), ("d", 2, "2X 24,000"), ("e", 0, "Invoice copy"), ("e", 1, "2X 24,000"), ("f", 0, "- Tea  "), ("f", 1, "Cake"), ("f", 2, "1 5,000")]
    got = sorted((r["doc_id"], r["description"], r["quantity"], r["unit_price"]) for r in recovery.recover_line_items(spark.createDataFrame(lines, "doc_id string, line_no int, text string")).collect())
    assert got == [("d", "Mineral Water", 2.0, 24000.0), ("f", "Tea Cake", 1.0, 5000.0)]


@pytest.mark.parametrize(("text", "want"), [("Invoice Number INV-1023", ("INV-1023", None, None, None)), ("Receipt # R-9\non 2025-01-12", ("R-9", "2025-01-12", None, None)), ("Amount due 20.50", (None, None, None, 20.5)), ("vendor - Acme Inc", (None, None, "Acme Inc", None))])
def test_offline_extractor(spark, text, want):
    r = extraction.extract_fields(spark.createDataFrame([("d", text)], "doc_id string, text string")).first()
    assert (r["invoice_number"], r["date"], r["vendor"], r["total_amount"]) == want


def test_offline_items(spark):
    r = extraction.extract_fields(spark.createDataFrame([("d", "Item Widget, Qty 2, Price 5.00\nitem: B, qty: 1, price: $3"), ("n", None)], "doc_id string, text string")).orderBy("doc_id").collect()
    assert [tuple(x) for x in r[0]["line_items"]] == [("Widget", 2.0, 5.0), ("B", 1.0, 3.0)] and r[1]["line_items"] == []


def docs(spark, *rows):
    full = [{"invoice_number": None, "date": None, "vendor": None, "total_amount": None, "line_items": None} | r for r in rows]
    return [F.from_json(F.lit(json.dumps(r)), DOC) for r in full]


def test_exact_match(spark):
    truth = {"invoice_number": "INV-1023", "date": "2025-01-12", "vendor": "ABC Corp", "total_amount": "1000.5", "line_items": [{"description": "a", "quantity": 1, "unit_price": 2}, {"description": "b", "quantity": 2, "unit_price": 3}]}
    for other in ({"date": "01/12/2025", "total_amount": "$1000.50", "line_items": truth["line_items"][::-1]}, {"invoice_number": " inv-1023 ", "date": "January 12, 2025", "vendor": "ABC Corp. ", "total_amount": "1,000.5"}):
        t, p = docs(spark, truth, truth | other)
        assert spark.range(1).select(evaluation.exact_match(p, t)).first()[0]
    t, p = docs(spark, truth, truth | {"vendor": "x", "line_items": []})
    r = spark.range(1).select(evaluation.exact_match(p, t), evaluation.exact_match(p, t, ("date",)), evaluation.mismatches(p, t)).first()
    assert tuple(r) == (False, True, ["vendor", "line_items"])


@pytest.mark.parametrize(("field", "value", "text", "want"), [
    ("vendor", "Ghost Corp", "ABC Corp sells", False), ("vendor", "FL-Xmas Off", "Puyo 6 (Package) 1x 70,000 70,000 Vanilla SLC 1 FL-Xmas 30 Off 68,180 Si1ky Lychee 2x Sub Total 70,000", True), ("vendor", "Siky Lychee", "Vanilla SLC 1 FL-Xmas 30 Off 68,180 Si1ky Lychee 2x Sub Total 70,000", True), ("date", "1995-03-17", "on MARCH 17, 1995", True),
    ("vendor", "DE.PSANG IJO MDM", "DE13.PSANG IJO MDM", True), ("total_amount", "1000.00", "Total $1,000", True), ("total_amount", "999", "Total $1,000", False), ("vendor", "ab", "nothing", None),
])
def test_grounding(spark, field, value, text, want):
    (p,) = docs(spark, {field: value})
    got = evaluation.grounded(spark.range(1).select(F.lit("d").alias("doc_id"), p.alias("pred"), F.lit(text).alias("text"))).collect()
    assert [r["grounded"] for r in got] == ([] if want is None else [want])


def test_grounding_paths(spark):
    (p,) = docs(spark, {"vendor": "Ghost Corp", "line_items": [{"description": "Invented thing", "quantity": 2, "unit_price": None}]})
    got = {r["path"]: r["grounded"] for r in evaluation.grounded(spark.range(1).select(F.lit("d").alias("doc_id"), p.alias("pred"), F.lit("two 2 real goods").alias("text"))).collect()}
    assert got == {"vendor": False, "line_items[0].description": False, "line_items[0].quantity": True}


def test_nearest_answers(spark):
    spans = [("d", "QUESTION", 0, 1, "q1"), ("d", "QUESTION", 5, 6, "q2"), ("d", "ANSWER", 3, 4, "a1"), ("d", "ANSWER", 8, 9, "a2"), ("e", "QUESTION", 0, 0, "q"), ("e", "HEADER", 1, 1, "h")]
    got = [tuple(r) for r in labels.pair_nearest(spark.createDataFrame(spans, "doc_id string, label string, start int, end int, text string")).orderBy("question").collect()]
    assert got == [("d", "q1", "a1"), ("d", "q2", "a2")]


@pytest.mark.parametrize(("text", "want"), [
    ("TOTAL 230,000 CASH 230,000 CHANGE 0 1 BANABERRY FRESH CREAM CAK 230,000", [("BANABERRY FRESH CREAM CAK", 1.0, 230000.0)]),
    ("J.STB PROMO 17500 Y.B.BAT 46000 Y.BASO PROM 27500 TOTAL 91000 CASH 91000", [("J.STB PROMO", None, 17500.0), ("Y.B.BAT", None, 46000.0), ("Y.BASO PROM", None, 27500.0)]),
    ("", []), ("5", []),
])
def test_context_items(spark, text, want):
    assert [tuple(x) for x in spark.range(1).select(offline.context_items(F.lit(text))).first()[0]] == want


def test_replies(spark):
    read = lambda field, raw, context="": spark.range(1).select(offline.read_reply(field, F.lit(raw), F.lit(context))).first()[0]
    assert float(read("total_amount", "null\nnull\n230000")) == 230000.0 and read("vendor", "Answer: 'Acme'") == "Acme" and read("date", "none", "on 2025/1/2") == "2025/1/2"
    items = spark.range(1).select(offline.read_item_reply(F.lit('{"line_items": [{"description": "a", "quantity": "2x", "unit_price": null}, {}, 5]}'), F.lit(""))).first()[0]
    assert [tuple(x) for x in items] == [("a", 2.0, None)]


def test_offline_pipelines(spark):
    text = "Invoice Number: INV-1\nDate 2025-01-12\nVendor: ABC Corp\nItem: Widget, Qty: 2, Price: 5.00\nTotal Amount: 10.00"
    rows = spark.createDataFrame([(1, text), (2, text), (3, "nothing")], "doc_id long, text string")
    none = spark.createDataFrame([], "key string, reply string, cost_usd double")
    got = {r["doc_id"]: r for r in offline.document_pipeline(rows, none).collect()}
    assert (got[1]["extracted"]["invoice_number"], got[1]["extracted"]["total_amount"], len(got[1]["extracted"]["line_items"])) == ("INV-1", 10.0, 1)
    assert got[2]["extracted"] == got[1]["extracted"] and got[3]["extracted"]["vendor"] is None and not got[1]["hit"]
    fields = {(r["doc_id"], r["field"]) for r in offline.field_pipeline(rows, none).collect()}
    assert len(fields) == 15


def test_numbers_and_validation_rows(spark):
    got = spark.createDataFrame([("1.591.600", "id"), ("1,591.60", "en"), ("1.591.60", "auto"), ("12345.678", "auto"), ("73,45", "auto"), ("x", "auto")], "t string, l string").collect()
    value = lambda t, loc: spark.range(1).select(conversion.parse_number(F.lit(t), loc)).first()[0]
    assert [value(r["t"], r["l"]) for r in got] == [1591600.0, 1591.6, 1591.6, 12345.678, 73.45, None]
    rows = spark.createDataFrame([("a", ["w"], [[1]], ["O"]), ("b", [], [], [])], "doc_id string, words array<string>, boxes array<array<int>>, bio_labels array<string>")
    assert [r["doc_id"] for r in conversion.validation_rows(rows).collect()] == ["a"]
    both = conversion.union_sources(rows.select("doc_id"), rows.select("doc_id", "words"))
    assert both.count() == 4 and both.columns == ["doc_id", "words"]
    cache = spark.sql("select 'a' key, timestamp '2025-01-01 00:00:00' written union all select 'b', timestamp '2025-01-01 01:30:00'")
    assert [r["key"] for r in offline.fresh_within(cache, F.lit("2025-01-01 02:00:00").cast("timestamp")).collect()] == ["b"]
