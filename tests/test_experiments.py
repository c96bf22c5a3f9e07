"""Payloads of any shape, whole parses, baselines in one plan, costs in two levels, and the result stream, against plain Python."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import benchmarks, evaluation, metrics, packed, parsing, payloads
from ledgerloom.streaming.results import ResultLog, run_batch, run_stream

TOKENS = "doc_id string, pos int, text string, confidence double, x0 int, y0 int, page_number int"


# ---------------------------------------------------------------- payloads
def plain_text(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    if isinstance(v, list):
        return "|".join(map(plain_text, v))
    if isinstance(v, dict):
        return "|".join(f"{k}:{plain_text(x)}" for k, x in sorted(v.items()))
    return str(v).strip()


def any_value(pick, depth=3):
    kind = pick.randrange(9 if depth else 6)
    if kind == 6:
        return [any_value(pick, depth - 1) for _ in range(pick.randrange(4))]
    if kind > 6:
        return {pick.choice(["a", "b", "value", "Z", "x y"]): any_value(pick, depth - 1) for _ in range(pick.randrange(4))}
    return [None, pick.randrange(-50, 5000), pick.randrange(1000) / 8, pick.choice([True, False]), pick.choice(["", " Tea ", "Grüße", "a|b"]), "x" * pick.randrange(3)][kind]


def test_payload_pairs_equal_plain_python(spark):
    pick = random.Random(4)
    docs = [{n: any_value(pick) for n in pick.sample(["_e", "date", "total", "items", "vendor", "é"], pick.randrange(6))} for _ in range(60)]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, "[1, 2]"), (901, "no json"), (902, None), (903, '{"a": 1, "a": 2}'), (904, "7")]
    df = spark.createDataFrame(rows, "doc_id long, payload string")
    unwrap = lambda v: v["value"] if isinstance(v, dict) and "value" in v else v
    want = sorted((i, k, plain_text(unwrap(v))) for i, d in enumerate(docs) for k, v in d.items() if not k.startswith("_") and plain_text(unwrap(v)))
    assert sorted(map(tuple, payloads.pairs(df).collect())) == want
    inside = df.select("doc_id", F.inline(payloads.pairs_of(F.try_parse_json("payload")))).filter("text <> ''")
    assert sorted(map(tuple, inside.collect())) == want
    assert {r["doc_id"] for r in payloads.fields(df).filter("field is null").collect()} >= {900, 901, 902, 903, 904}


def test_payload_leaves_at_any_depth(spark):
    doc = {"a": {"b": [1, {"c": [True, None]}, []]}, "d": {"value": {"e": "x"}, "confidence": 0.5}, "_f": 1, "g": {}}
    df = spark.createDataFrame([(1, json.dumps(doc))], "doc_id long, payload string")
    read = lambda depth: {r["path"]: r["t"] for r in payloads.leaves(df, depth=depth).select("path", payloads.value_text(F.col("value"), 0).alias("t")).collect()}
    assert read(6) == {"a.b[0]": "1", "a.b[1].c[0]": "True", "a.b[1].c[1]": "", "a.b[2]": "[]", "d.e": "x", "g": "{}"}
    assert read(1) == {"a.b": '[1,{"c":[true,null]},[]]', "d.e": "x", "g": "{}"}


@pytest.mark.parametrize(("pred", "truth", "wrong"), [
    ({"vendor": " ACME "}, {"vendor": "acme."}, set()), ({"total_amount": "$1,000.50", "x": None}, {"total_amount": 1000.5}, set()), ({"date": "Jan 5th, 2024"}, {"date": "2024-01-05"}, set()), ({"date": "05.01.2024"}, {"date": "07.02.2024"}, {"date"}),
    ({"line_items": [{"b": 1}, {"a": "X"}]}, {"line_items": [{"a": "x"}, {"b": 1}]}, set()), ({"line_items": None}, {"line_items": []}, set()), ({"line_items": [{"price": "2"}]}, {"line_items": [{"price": 2.0}]}, set()), ({"odd": [1]}, {}, {"odd"}), ({}, {}, set()), ({"a": 0}, {"a": None}, {"a"}),
])
def test_exact_match_over_all_keys(spark, pred, truth, wrong):
    df = spark.createDataFrame([(1, json.dumps(pred), json.dumps(truth))], "doc_id long, pred string, truth string")
    got = payloads.exact_match(df).first()
    assert (got["exact"], got["n_wrong"]) == (not wrong, len(wrong))
    assert {r["field"] for r in payloads.compare(df).filter("not equal").collect()} == wrong


def test_payload_tokens(spark):
    doc = {"l": [{"b": 2, "a": "Tea x"}, [3.5, "y"], None], "o": {"z": True, "m": [1, "q"], "n": None}, "s": "A-b 1.5", "e": ""}
    df = spark.createDataFrame([(1, json.dumps(doc), "{}")], "doc_id long, pred string, truth string")
    rows = payloads.fields(df.select("doc_id", F.col("pred").alias("payload"))).select("field", payloads.value_tokens(F.col("value")).alias("w")).collect()
    assert {r["field"]: r["w"] for r in rows} == {"l": ["tea", "x", "2.00", "3.50", "y"], "o": ["1.00", "q", "1.00"], "s": ["a", "b", "1.5"], "e": []}
    assert {r["field"]: r["f1"] for r in payloads.token_scores(df).collect()} == {"l": 0.0, "o": 0.0, "s": 0.0, "e": 1.0}


# ---------------------------------------------------------------- whole parses
def receipt(spark, lines, conf=0.9, label="O"):
    rows = [("d", 100 * i + j, w, conf, 40 * j, 30 * i, 1, label) for i, line in enumerate(lines) for j, w in enumerate(line.split())]
    return spark.createDataFrame(rows, TOKENS + ", label string")


def parsed(spark, lines, conf=0.9, **more):
    r = packed.documents(receipt(spark, lines, conf), "2030-01-01", **more).first()
    return {f["field"]: f for f in r["fields"]}, r["flags"]


HEAD = ["Blue Corner Store", "INVOICE NO INV-7", "DATE 2024-01-05"]


def test_constraints_in_the_chain(spark):
    fields, flags = parsed(spark, [*HEAD, "Tea 2 1000", "Cake 1 3000", "TOTAL 9900"])
    assert flags == ["line_items_total_mismatch"] and fields["total_amount"]["codes"] == ["line_items_total_mismatch"] and not fields["total_amount"]["valid"]
    fields, flags = parsed(spark, [*HEAD, "Tea 2 1000", "Cake 3000", "TOTAL 11000"])
    assert flags == ["corrected_quantity_derived_from_total"] and [i["quantity"] for i in fields["line_items"]["items"]] == [2.0, 3.0] and fields["total_amount"]["valid"]
    assert json.loads(fields["line_items"]["value"])[1]["quantity"] == 3.0
    fields, flags = parsed(spark, [*HEAD, "Tea 2 1000", "Cake 3000", "TOTAL 11000"], repair=False)
    assert flags == ["line_items_total_mismatch"]
    fields, flags = parsed(spark, [*HEAD, "2x Tea 60000000", "3x Cake 70000000", "PAYMENT"])
    assert flags == ["missing_required_field:total_amount", "corrected_total_amount_from_line_items"]
    assert fields["total_amount"]["value"] == "330000000" and fields["total_amount"]["codes"] == ["missing_required_field", "low_confidence"] and fields["total_amount"]["status"] == "dropped"
    fields, flags = parsed(spark, ["DATE 2031-01-05", "INVOICE NO Z5", "TOTAL 10"])
    assert set(flags) == {"future_date:date"} and fields["date"]["codes"] == ["future_date"] and "line_items" not in fields
    fields, flags = parsed(spark, [*HEAD, "Tea 2 1000", "Cake 1 3000", "TOTAL 9900"], with_constraints=False)
    assert flags == [] and fields["total_amount"]["valid"]


@pytest.mark.parametrize(("conf", "want"), [(0.2, 0.45), (0.5, 0.5), (0.95, 0.75), (None, 0.55)])
def test_recovered_confidence_is_that_of_the_first_lines(spark, conf, want):
    fields, _ = parsed(spark, [*HEAD, "TOTAL 9900"], conf)
    assert fields["vendor"]["confidence"] == fields["date"]["confidence"] == pytest.approx(want)
    assert (fields["vendor"]["status"] == "kept") == (want >= 0.6) and fields["total_amount"]["confidence"] == pytest.approx(0.72)


def test_aliases_are_no_vendors(spark):
    lines = ["Acme Corp", "Blue Store", "TOTAL 5"]
    assert parsed(spark, lines)[0]["vendor"]["value"] == "Acme Corp"
    assert parsed(spark, lines, aliases={"acme corp": "vendor"})[0]["vendor"]["value"] == "Blue Store"


def test_codes_keep_the_order_of_the_stages(spark):
    words = [("Date", "B-KEY"), ("soon", "B-VALUE"), ("Date", "B-KEY"), ("Total", "B-KEY"), ("$5", "B-VALUE"), ("stray", "B-VALUE"), ("", "B-KEY"), ("Total", "B-KEY"), ("7", "B-VALUE")]
    rows = [("d", i, w, 0.3 if w in ("Date", "soon") else 0.9, i * 50, 0, 1, lab) for i, (w, lab) in enumerate(words)]
    df = spark.createDataFrame(rows, TOKENS + ", label string")
    got = {r["field"]: r for r in packed.long_fields(packed.documents(df, "2030-01-01", with_recovery=False)).collect()}
    assert got["date"]["codes"] == ["missing_value", "normalization_failed", "missing_value", "missing_required_field", "low_confidence"] and got["date"]["value"] is None
    assert got["total_amount"]["codes"] == ["conflicting_values"] and got["total_amount"]["value"] == "5" and got[None]["codes"] == ["orphan_value"]
    assert got["invoice_number"]["status"] == "missing" and got["invoice_number"]["codes"] == ["missing_required_field"]


def plain_spans(tokens):
    spans, current = [], None
    for text, label, cat in tokens:
        text, prefix, kind = text.strip(), label[:1], label[2:]
        if not text:
            continue
        if label not in ("B-KEY", "I-KEY", "B-VALUE", "I-VALUE"):
            current = None
            continue
        goes_on = current is not None and current[0] == kind and (cat == current[1] if cat else prefix == "I")
        if not goes_on:
            current = (kind, cat, [])
            spans.append(current)
        current[2].append(text)
    return [(k, " ".join(w)) for k, _, w in spans]


def test_long_documents_and_categories(spark):
    pick = random.Random(6)
    tokens = [(pick.choice(["a", "b c", " ", "d"]), pick.choice(["O", "B-KEY", "I-KEY", "B-VALUE", "I-VALUE", "junk"]), pick.choice(["", "p", "q"])) for _ in range(1500)]
    df = spark.createDataFrame([("d", i, w, 0.5, 0, 0, 1, lab, cat) for i, (w, lab, cat) in enumerate(tokens)], TOKENS + ", label string, category string")
    rows = packed.pack(df).withColumn("labels", F.transform("t", lambda x: x["label"]))
    got = packed.spans(rows, has_category=True).first()["spans"]
    assert [(s["type"], s["text"]) for s in got] == plain_spans(tokens)


def test_lines_of_long_documents(spark):
    pick = random.Random(8)
    tokens = [(pick.randrange(1, 4), pick.randrange(0, 4000), pick.randrange(0, 900), i) for i in range(900)]
    df = spark.createDataFrame([("d", i, f"w{i}", 0.5, x, y, p) for p, y, x, i in tokens], TOKENS)
    lines, least, page = [], None, None
    for p, y, x, i in sorted(tokens):
        if least is None or p != page or abs(y - least) > 18:
            lines.append([])
            least = y
        lines[-1].append((x, i))
        least, page = min(least, y), p
    want = [" ".join(f"w{i}" for _, i in sorted(line)) for line in lines]
    assert [x["text"] for x in packed.lines(packed.pack(df)).first()["lines"]] == want


def test_parse_is_one_exchange(spark):
    df = receipt(spark, HEAD).drop("label")
    plan = parsing.parse(df, "2030-01-01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
    labelled = parsing.parse(df, "2030-01-01", labeler=lambda t: t.select("doc_id", "pos", F.lit("O").alias("label")))
    assert {r["field"]: r["value"] for r in labelled.collect()}["vendor"] == "Blue Corner Store"


# ---------------------------------------------------------------- evaluation
@pytest.mark.parametrize(("said", "same"), [("2024-01-05T10:00", True), ("Jan 5th, 2024", True), ("05-Jan-2024", True), ("1/2/24", False), ("20240105", True), ("Date: 2024-01-05", True), ("5 of January 2024", True), ("05.01.2024", False), ("2024-13-45 or 2024-01-05", False), ("never", False)])
def test_dates_of_any_layout(spark, said, same):
    doc = "struct<invoice_number:string,date:string,vendor:string,total_amount:string,line_items:array<struct<description:string,quantity:double,unit_price:double>>>"
    make = lambda d: F.from_json(F.lit(json.dumps({"date": d})), doc)
    assert spark.range(1).select(evaluation.exact_match(make(said), make("2024-01-05"), ("date",))).first()[0] == same


def test_lines_without_commas_are_searched_in_order(spark):
    doc = "struct<invoice_number:string,date:string,vendor:string,total_amount:string,line_items:array<struct<description:string,quantity:double,unit_price:double>>>"
    rows = spark.createDataFrame([(1, '{"vendor": "alphabeta gammas"}', "al,pha,beta 5 gam,mas"), (2, '{"vendor": "alphabeta gammas"}', "al pha beta 5 gam mas"), (3, '{"vendor": "x"}', None)], "doc_id int, p string, text string").withColumn("pred", F.from_json("p", doc))
    assert {r["doc_id"]: r["grounded"] for r in evaluation.grounded(rows).collect()} == {1: True, 2: False}


# ---------------------------------------------------------------- baselines
def test_benchmark_partial_scores_and_plan(spark):
    truth = {"invoice_number": "INV-1023", "date": "2025-01-12", "total_amount": 1200.5}
    words = ["Invoice", "Number", "INV-1023", "Date", "12/01/2025", "Total", "Amount", "1200.50"]
    rows = [("a", i, w, 0.95, i * 50, 0, 1) for i, w in enumerate(words)]
    tokens = spark.createDataFrame(rows, TOKENS)
    truths = spark.createDataFrame([("a", json.dumps(truth)), ("none", json.dumps(truth)), ("odd", "[]")], "doc_id string, truth string")
    scored = benchmarks.run(benchmarks.samples_of(tokens, truths), "2030-01-01")
    got = {r["variant"]: r for r in benchmarks.summary(scored).collect()}
    assert len(got) == 11 and got["full"]["n_docs"] == 3 and got["full"]["exact_match_accuracy"] == pytest.approx(2 / 3)  # no fields on both sides are equal
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    assert got["no_postprocessing"]["partial_match"] == pytest.approx((1 + ratio("12/01/2025", "2025-01-12") + ratio("1200.50", "1200.5")) / 3)
    assert got["ocr_only"]["partial_match"] == pytest.approx((ratio("12/01/2025", "2025-01-12") + ratio("Amount", "1200.5")) / 2)
    assert got["full"]["partial_match"] == 1.0 and got["full"]["precision"] == 1.0 and got["full"]["recall"] == 0.5
    assert (got["full"]["entity_precision"], got["ocr_only"]["entity_recall"]) == (pytest.approx(1 / 3, abs=1e-6), 0.0)
    plan = benchmarks.summary(benchmarks.run(tokens.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "text", "confidence", "x0", "y0", "page_number")).alias("t")).withColumn("truth", F.lit("{}")).checkpoint(), "2030-01-01"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange ") == 1
    assert benchmarks.declared_ablations(spark).count() == 3


def test_label_scores(spark):
    gold = ["B-KEY", "I-KEY", "O", "B-VALUE", "I-VALUE", "B-VALUE"]
    labels = ["B-KEY", "O", "I-VALUE", "I-VALUE", "I-VALUE", "B-VALUE"]
    row = spark.createDataFrame([(labels, gold, [])], "p array<string>, g array<string>, e array<string>")
    got = row.select(*[F.transform(benchmarks.label_spans(F.col(c)), lambda s: F.concat_ws(":", s["type"], s["start"].cast("string"), s["end"].cast("string"))).alias(c) for c in ("p", "g", "e")]).first()
    assert (got["g"], got["p"], got["e"]) == (["KEY:0:2", "VALUE:3:5", "VALUE:5:6"], ["KEY:0:1", "VALUE:2:5", "VALUE:5:6"], [])


def test_examples_are_limited_below_the_exchange(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("category")).repartition(6)
    got = benchmarks.examples(rows, "category", "doc_id", 3)
    assert sorted(map(tuple, got.select("category", "doc_id", "rank").collect())) == [("common", 1, 1), ("common", 2, 2), ("common", 3, 3), ("rare", 0, 1), ("rare", 100, 2), ("rare", 200, 3)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- costs
def test_running_cost_of_one_group_is_dealt_out(spark):
    rows = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 20_011).alias("seq"), F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 13) / 10).alias("cost")).repartition(5)
    got = metrics.running_cost(rows, ["g"], ["seq"], "cost", base=1.5, n_runs=64)
    spent, want = 1.5, {}
    for r in sorted(rows.collect(), key=lambda r: r["seq"]):
        want[r["seq"]] = spent
        spent = round(spent + (r["cost"] or 0.0), 9)
    assert {r["seq"]: r["spent_before"] for r in got.collect()} == pytest.approx(want)
    bounds = metrics.run_bounds(rows, "seq", 64)
    sizes = rows.groupBy(F.array_size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("seq")))).count().agg(F.max("count")).first()[0]
    assert len(bounds) == 63 and sizes < 400  # the rows of a window's partition, of 20,000
    kept = metrics.within_cap(rows, ["g"], ["seq"], "cost", 100.0, 1.5, 64)
    assert kept.count() == sum(v < 100 for v in want.values())
    with pytest.raises(metrics.CostCapExceeded):
        metrics.enforce_cap(kept, "cost", 100.0)
    assert metrics.enforce_cap(kept, "cost", 1e6) >= 100.0


def test_running_cost_cases(spark):
    rows = spark.createDataFrame([(None, 1, 2.0), (None, None, 1.0), ("a", 1, 4.0), ("a", 2, None), ("a", 3, 1.0)], "g string, seq int, cost double")
    got = {(r["g"], r["seq"]): r["spent_before"] for r in metrics.running_cost(rows, ["g"], ["seq"], "cost", spark.createDataFrame([("a", 10.0), ("z", 1.0)], "g string, base double")).collect()}
    assert got == {(None, None): 0.0, (None, 1): 1.0, ("a", 1): 10.0, ("a", 2): 14.0, ("a", 3): 14.0}
    assert metrics.running_cost(rows.limit(0), [], ["seq"], "cost").count() == 0


# ---------------------------------------------------------------- the result stream
COLUMNS = "system string, doc_id string, seq long, value string, cost_usd double"


def system(tag, cost):
    return lambda docs: docs.select("doc_id", "seq", F.concat(F.lit(tag), "text").alias("value"), F.lit(cost).alias("cost_usd"))


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"doc_id": d, "seq": s, "text": t}) for d, s, t in rows))


def stream(spark, folder):
    return spark.readStream.schema("doc_id string, seq long, text string").option("maxFilesPerTrigger", 1).json(str(folder))


class Killed(Exception):
    pass


def test_results_are_the_same_after_a_failure(spark, tmp_path):
    """The run dies between the write of its second batch and the commit; restarted, it repeats that batch."""
    source = tmp_path / "in"
    source.mkdir()
    put(source, "1.json", [("a", 0, "x"), ("b", 1, "y"), ("b", 9, "again")])
    put(source, "2.json", [("b", 1, "other"), ("c", 2, "z")])
    put(source, "3.json", [("d", 3, "w")])
    systems = {"one": system("1-", 0.25), "two": system("2-", 0.5)}

    def run(name, die):
        log, died = ResultLog(spark, str(tmp_path / name / "log"), COLUMNS), []

        def after(batch):
            if batch == die and not died:
                died.append(batch)
                raise Killed(batch)

        for _ in range(2):
            q = run_stream(stream(spark, source), log, str(tmp_path / name / "checkpoint"), systems, after_write=after)
            try:
                q.awaitTermination(120)
            except Exception as e:
                assert "Killed" in str(e) and died
        return log, died

    whole, died = run("whole", None)
    assert not died
    broken, died = run("broken", 1)
    assert died == [1] and broken.folders() == whole.folders() == [0, 1, 2]
    rows = lambda log: sorted(map(tuple, log.rows().collect()))
    assert rows(broken) == rows(whole) and len(rows(whole)) == 8 and ("one", "b", 1, "1-y", 0.25) in rows(whole)
    assert broken.cost() == whole.cost() == 3.0
    before = rows(whole)
    whole.compact()
    assert (whole.folders(), whole.folders("base"), rows(whole)) == ([], [2], before)
    wanted = spark.createDataFrame([("d", 0), ("a", 1), ("nothing", 2)], "doc_id string, seq long")
    assert [(r["system"], r["doc_id"]) for r in whole.ordered(wanted).collect()] == [("one", "d"), ("one", "a"), ("two", "d"), ("two", "a")]
    put(source, "4.json", [("e", 4, "v"), ("a", 0, "x")])
    run_stream(stream(spark, source), whole, str(tmp_path / "whole" / "checkpoint"), systems).awaitTermination(120)
    assert rows(whole) == sorted([*before, ("one", "e", 4, "1-v", 0.25), ("two", "e", 4, "2-v", 0.5)])
    whole.compact()
    assert whole.folders("base") == [3] and len(rows(whole)) == 10


def test_the_cap_stops_a_run_and_keeps_its_records(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "log"), COLUMNS)
    log.write(spark.createDataFrame([("one", "outside", 0, "v", 1.0)], COLUMNS), 0)
    docs = spark.createDataFrame([(x, i, x) for i, x in enumerate("abcde")], "doc_id string, seq long, text string")
    systems = {"one": system("1-", 0.25), "two": system("2-", 0.5)}
    for _ in range(2):  # a repeated batch decides as it did the first time
        with pytest.raises(metrics.CostCapExceeded):
            run_batch(log, docs, 1, systems, cap=3.0)
        assert sorted((r["system"], r["doc_id"]) for r in log.rows().collect()) == [("one", "a"), ("one", "b"), ("one", "c"), ("one", "d"), ("one", "e"), ("one", "outside"), ("two", "a"), ("two", "b")]
    assert log.cost() == 3.25
    run_batch(log, docs, 2, systems, cap=10.0)
    assert log.rows().count() == 11 and log.cost(before=2) == 3.25
    run_batch(log, docs.limit(0), 3, systems)
    assert log.rows().count() == 11 and log.folders() == [0, 1, 2, 3]
