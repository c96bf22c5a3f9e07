"""Queries of free-form payloads, whole parses of receipts, baselines and ablations, evaluation records, and running costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import benchmarks, evaluation, metrics, packed, payloads
from .document_queries import _documents
from .queries import query, read

# ---------------------------------------------------------------- payloads
_PAYLOAD_SQL = """
WITH i AS (SELECT l_orderkey AS k, '[' || string_agg('{"sku": "p' || l_partkey || '", "quantity": ' || CASE WHEN l_linenumber % 3 = 0 THEN 'null' ELSE (l_quantity::BIGINT)::VARCHAR END || ', "price": ' || (l_suppkey % 90 + 10) || '.25}', ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) || ']' AS items FROM lineitem GROUP BY 1),
 o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS c, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%m/%d/%Y') AS us, o_custkey AS cust, o_orderkey % 9 AS days, items FROM orders JOIN i ON o_orderkey = i.k),
 t AS (SELECT k, c, '{"_id": 1, "number": "INV-' || k || '", "date": "' || day || '", "vendor": " Vendor  ' || cust || ' ", "total_amount": ' || cust || '.5, "terms": {"net": 30, "early": {"rate": 0.5, "days": ' || days || '}}, "paid": ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ', "line_items": ' || items || ', "note": null}' AS j FROM o),
 p AS (SELECT k, '{"_errors": [], "number": {"value": "' || CASE WHEN c = 1 THEN 'inv-' ELSE 'INV-' END || k || CASE WHEN c = 1 THEN '.' ELSE '' END || '", "confidence": 0.75}, "date": "' || CASE WHEN c = 2 THEN us ELSE day END || '", "vendor": "Vendor ' || cust || '"' || CASE WHEN c = 3 THEN '' ELSE ', "total_amount": "$' || cust || '.50"' END
  || ', "terms": {"early": {"days": ' || CASE WHEN c = 4 THEN 99 ELSE days END || ', "rate": 0.5}, "net": 30}, "paid": ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ', "line_items": ' || CASE WHEN c = 5 THEN '[]' ELSE items END || CASE WHEN c = 6 THEN ', "extra": {"a": [1, 2]}' ELSE '' END || '}' AS j FROM o),
 b AS (SELECT k AS doc_id, true AS predicted, j FROM p UNION ALL SELECT k, false, j FROM t),
 e AS (SELECT b.doc_id, b.predicted, x.key AS field, x.type AS kind, x.value::VARCHAR AS j FROM b, json_each(b.j) x WHERE NOT starts_with(x.key, '_')),
 u AS (SELECT doc_id, predicted, field, CASE WHEN kind = 'OBJECT' AND json_exists(j, '$.value') THEN json_extract(j, '$.value')::VARCHAR ELSE j END AS v, CASE WHEN kind = 'OBJECT' AND json_exists(j, '$.value') THEN coalesce(json_extract(j, '$.confidence')::DOUBLE, 0.0) ELSE 0.0 END AS confidence FROM e),
 tree AS (SELECT u.doc_id, u.predicted, u.field || replace(x.fullkey, '$', '') AS path, x.type AS kind, x.atom::VARCHAR AS atom FROM u, json_tree(u.v) x WHERE x.type NOT IN ('OBJECT', 'ARRAY') OR x.value::VARCHAR IN ('[]', '{}')),
 leaf AS (SELECT doc_id, predicted, path, CASE WHEN kind = 'NULL' THEN '' WHEN kind = 'VARCHAR' THEN trim(json_extract_string(atom, '$')) WHEN kind = 'BOOLEAN' THEN CASE WHEN atom = 'true' THEN 'True' ELSE 'False' END WHEN kind = 'DOUBLE' THEN regexp_replace(regexp_replace(printf('%.6f', atom::DOUBLE), '0+$', ''), '[.]$', '') WHEN kind = 'ARRAY' THEN '[]' WHEN kind = 'OBJECT' THEN '{}' ELSE atom END AS text FROM tree)
"""


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, pred, truth): JSON of orders and their items, as they are and with one difference by the order's key."""
    k = F.col("o_orderkey")
    li = read(spark, sf, "lineitem")
    quantity = F.when(F.col("l_linenumber") % 3 == 0, "null").otherwise(F.col("l_quantity").cast("long").cast("string"))
    item = F.concat(F.lit('{"sku": "p'), "l_partkey", F.lit('", "quantity": '), quantity, F.lit(', "price": '), F.col("l_suppkey") % 90 + 10, F.lit(".25}"))
    listed = li.groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", item.alias("j")))), lambda x: x["j"]), ", "), F.lit("]")).alias("items"))
    rows = read(spark, sf, "orders").join(listed, k == F.col("l_orderkey")).select(k.alias("k"), (k % 8).alias("c"), (k % 9).alias("days"), F.col("o_custkey").alias("cust"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("us"), "items")
    c, paid = F.col("c"), F.when(F.col("k") % 2 == 0, "true").otherwise("false")
    truth = F.concat(F.lit('{"_id": 1, "number": "INV-'), "k", F.lit('", "date": "'), "day", F.lit('", "vendor": " Vendor  '), "cust", F.lit(' ", "total_amount": '), "cust", F.lit('.5, "terms": {"net": 30, "early": {"rate": 0.5, "days": '), "days", F.lit('}}, "paid": '), paid, F.lit(', "line_items": '), "items", F.lit(', "note": null}'))
    pred = F.concat(
        F.lit('{"_errors": [], "number": {"value": "'), F.when(c == 1, "inv-").otherwise("INV-"), "k", F.when(c == 1, ".").otherwise(""), F.lit('", "confidence": 0.75}, "date": "'), F.when(c == 2, F.col("us")).otherwise(F.col("day")), F.lit('", "vendor": "Vendor '), "cust", F.lit('"'),
        F.when(c == 3, "").otherwise(F.concat(F.lit(', "total_amount": "$'), "cust", F.lit('.50"'))), F.lit(', "terms": {"early": {"days": '), F.when(c == 4, F.lit(99)).otherwise(F.col("days")), F.lit(', "rate": 0.5}, "net": 30}, "paid": '), paid, F.lit(', "line_items": '), F.when(c == 5, "[]").otherwise(F.col("items")),
        F.when(c == 6, ', "extra": {"a": [1, 2]}').otherwise(""), F.lit("}"),
    )
    return rows.select(F.col("k").alias("doc_id"), pred.alias("pred"), truth.alias("truth"))


@query(_PAYLOAD_SQL + "SELECT doc_id, field, confidence FROM u WHERE predicted")
def payload_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of any name with their confidences; records stand for their value, names with an underscore are none."""
    return payloads.fields(_payloads(spark, sf).select("doc_id", F.col("pred").alias("payload"))).filter("field is not null").select("doc_id", "field", "confidence")


@query(_PAYLOAD_SQL + "SELECT doc_id, predicted, path, text FROM leaf")
def payload_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Every scalar of both payloads under its path, whatever the nesting."""
    rows = payloads.leaves(payloads.sides(_payloads(spark, sf)))
    return rows.select("doc_id", "predicted", "path", payloads.value_text(F.col("value"), 0).alias("text"))


@query(_PAYLOAD_SQL + """, pair AS (SELECT doc_id, field, CASE WHEN field = 'terms' THEN 'early:days:' || json_extract_string(v, '$.early.days') || '|rate:0.5|net:30' WHEN field = 'extra' THEN 'a:1|2'
  WHEN field = 'line_items' THEN array_to_string([concat_ws('|', 'price:' || regexp_replace(printf('%.2f', json_extract(x, '$.price')::DOUBLE), '0+$', ''), 'quantity:' || coalesce(json_extract_string(x, '$.quantity'), ''), 'sku:' || json_extract_string(x, '$.sku')) FOR x IN json_extract(v, '$[*]')], '|')
  ELSE (SELECT l.text FROM leaf l WHERE l.doc_id = u.doc_id AND l.predicted AND l.path = u.field) END AS value FROM u WHERE predicted)
 SELECT * FROM pair WHERE value <> ''""")
def payload_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Fields as texts: lists and objects joined, members by name; empty ones left out."""
    return payloads.pairs(_payloads(spark, sf).select("doc_id", F.col("pred").alias("payload")))


@query(_PAYLOAD_SQL + "SELECT k AS doc_id, CASE WHEN c = 6 THEN 9 ELSE 8 END AS n_fields, CASE WHEN c IN (3, 4, 6) THEN 1 WHEN c = 5 THEN 1 ELSE 0 END AS n_wrong, c NOT IN (3, 4, 5, 6) AS exact FROM o")
def payload_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Exact match over the union of both payloads' fields, in normal form; the empty note counts as absent."""
    return payloads.exact_match(_payloads(spark, sf))


@query(_PAYLOAD_SQL + "SELECT doc_id, path, max(text) FILTER (predicted) AS p, max(text) FILTER (NOT predicted) AS t, CASE WHEN count(*) FILTER (predicted) = 0 THEN 'missing' WHEN count(*) FILTER (NOT predicted) = 0 THEN 'extra' ELSE 'changed' END AS status FROM leaf GROUP BY ALL HAVING p IS DISTINCT FROM t")
def payload_differences(spark: SparkSession, sf: str) -> DataFrame:
    """What differs between two nested payloads, by path."""
    return payloads.differences(_payloads(spark, sf))


@query(_PAYLOAD_SQL + """, tok AS (SELECT doc_id, predicted, field, regexp_extract_all(lower(CASE WHEN field = 'total_amount' AND NOT predicted THEN printf('%.2f', v::DOUBLE) WHEN field = 'paid' THEN CASE WHEN v = 'true' THEN '1.00' ELSE '0.00' END ELSE json_extract_string(v, '$') END), '[a-z0-9.]+') AS w FROM u WHERE field IN ('number', 'date', 'vendor', 'total_amount', 'paid')),
 n AS (SELECT doc_id, field, predicted, unnest(w) AS w FROM tok), m AS (SELECT doc_id, field, w, count(*) FILTER (predicted) AS a, count(*) FILTER (NOT predicted) AS b FROM n GROUP BY ALL)
 SELECT doc_id, field, sum(least(a, b))::BIGINT AS tp, sum(a)::BIGINT AS n_pred, sum(b)::BIGINT AS n_true FROM m GROUP BY ALL""")
def payload_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token overlap of the scalar fields, whatever their names."""
    got = payloads.token_scores(_payloads(spark, sf)).filter(F.col("field").isin("number", "date", "vendor", "total_amount", "paid"))
    return got.select("doc_id", "field", F.col("tp").cast("long").alias("tp"), F.col("n_pred").cast("long").alias("n_pred"), F.col("n_true").cast("long").alias("n_true"))


# ---------------------------------------------------------------- receipts, parsed whole
_RECEIPT_SQL = """
WITH l AS (SELECT l_orderkey AS k, l_orderkey % 4 AS c, l_quantity AS q, l_partkey % 50 + 1001 AS p FROM lineitem),
 s AS (SELECT k, c, count(*) AS n, sum(CASE WHEN c = 1 THEN 2 * (60000000 + p) ELSE q * p END)::BIGINT AS s FROM l GROUP BY ALL),
 r AS (SELECT s.*, strftime(o_orderdate, '%Y-%m-%d') AS day, NOT (c = 1 AND n = 1) AS receipt FROM s JOIN orders ON o_orderkey = k)
"""


def _receipt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts without labels: the total is right, left out, off by seven, or explained by the quantity that one item lacks."""
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("at"), F.concat(F.lit("w"), F.translate(F.col("l_partkey").cast("string"), "0123456789", "abcdefghij")).alias("name"), F.col("l_quantity").cast("long").alias("q"), (F.col("l_partkey") % 50 + 1001).alias("p"))
    rows = li.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "name", "q", "p"))).alias("x")).join(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("k") == F.col("o_orderkey"))
    c = F.col("k") % 4
    text = lambda v: v.cast("string")
    item = F.transform("x", lambda v, i: F.when(c == 1, F.array(F.lit("2x"), v["name"], text(60_000_000 + v["p"]))).when((c == 3) & (i == 0), F.array(v["name"], text(v["p"]))).otherwise(F.array(v["name"], text(v["q"]), text(v["p"]))))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v["q"] * v["p"]) + F.when(c == 2, 7).otherwise(0)
    words = lambda *w: F.array(*[F.lit(x) if isinstance(x, str) else x for x in w])
    head = F.array(words("Blue", "Corner", "Store"), words("INVOICE", "NO", F.concat(F.lit("INV-"), "k")), words("DATE", F.date_format("o_orderdate", "yyyy-MM-dd")))
    tail = F.when(c == 1, F.array(words("PAYMENT"))).otherwise(F.array(words("GRAND", "TOTAL", text(total))))
    lines = rows.select(F.col("k").alias("doc_id"), F.posexplode(F.concat(head, item, tail)).alias("line", "w"))
    tokens = lines.select("doc_id", "line", F.posexplode("w").alias("i", "text"))
    return tokens.select("doc_id", (F.col("line") * 100 + F.col("i")).alias("pos"), "text", F.lit(0.9).alias("confidence"), (F.col("i") * 50).alias("x0"), (F.col("line") * 30).alias("y0"), F.lit(1).alias("page_number"), F.lit("O").alias("label"))


@query(_RECEIPT_SQL + """, f AS (SELECT k AS doc_id, 'invoice_number' AS field, 'INV-' || k AS value, 0.75 AS confidence, '' AS codes FROM r UNION ALL SELECT k, 'date', day, 0.75, '' FROM r UNION ALL SELECT k, 'vendor', 'Blue Corner Store', 0.75, '' FROM r
 UNION ALL SELECT k, 'line_items', n::VARCHAR, CASE WHEN c = 3 THEN greatest(0.5, least(0.78, (0.68 + 0.78 * (n - 1)) / n)) ELSE 0.78 END, '' FROM r WHERE receipt
 UNION ALL SELECT k, 'total_amount', CASE WHEN receipt THEN (s + CASE WHEN c = 2 THEN 7 ELSE 0 END)::VARCHAR END, CASE WHEN c = 1 THEN 0.0 ELSE 0.78 END, CASE WHEN NOT receipt THEN 'missing_required_field' WHEN c = 1 THEN 'missing_required_field,low_confidence' WHEN c = 2 THEN 'line_items_total_mismatch' ELSE '' END FROM r)
 SELECT doc_id, field, value, confidence::DOUBLE AS confidence, codes = '' AS valid, CASE codes WHEN 'missing_required_field' THEN 'missing' WHEN 'missing_required_field,low_confidence' THEN 'dropped' ELSE 'kept' END AS status, codes FROM f""")
def receipt_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Unlabelled receipts through recovery and constraints; the number of items stands for their text."""
    got = packed.long_fields(packed.documents(_receipt_tokens(spark, sf), "2030-01-01"))
    n = F.array_size(F.from_json("value", f"array<{packed.ITEM}>"))
    return got.withColumn("value", F.when(F.col("field") == "line_items", n.cast("string")).otherwise(F.col("value"))).withColumn("codes", F.array_join("codes", ","))


@query(_RECEIPT_SQL + """SELECT k AS doc_id, CASE WHEN NOT receipt THEN 'missing_required_field:total_amount' WHEN c = 1 THEN 'missing_required_field:total_amount,corrected_total_amount_from_line_items' WHEN c = 2 THEN 'line_items_total_mismatch' WHEN c = 3 AND n > 1 THEN 'corrected_quantity_derived_from_total' ELSE '' END AS flags,
 CASE WHEN receipt THEN (SELECT sum(CASE WHEN l.c = 1 THEN 2 ELSE l.q END) FROM l WHERE l.k = r.k AND NOT (r.c = 3 AND r.n = 1)) END AS quantity FROM r""")
def receipt_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Constraint flags of the receipts, and the items' quantities after the repair."""
    d = packed.documents(_receipt_tokens(spark, sf), "2030-01-01")
    items = F.get(F.filter("fields", lambda r: r["field"] == "line_items"), 0)["items"]
    known = F.filter(F.transform(items, lambda x: x["quantity"]), lambda v: v.isNotNull())
    return d.select("doc_id", F.array_join("flags", ",").alias("flags"), F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v)).alias("quantity"))


# ---------------------------------------------------------------- baselines and ablations
_BENCH_SQL = """
WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS day,
  regexp_replace(regexp_replace(printf('%.2f', round(o_totalprice, 2)), '0+$', ''), '[.]$', '') AS total, CASE WHEN o_orderkey % 2 = 0 THEN regexp_replace(regexp_replace(printf('%.2f', round(o_totalprice, 2)), '0+$', ''), '[.]$', '') ELSE '$' || format('{:,.2f}', round(o_totalprice, 2)) END AS printed,
  CASE WHEN o_orderkey % 10 = 0 THEN 0.3 WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 0.9 END AS conf, o_orderkey % 7 <> 0 AS has_total, o_orderkey % 13 = 0 AS none FROM orders),
 d AS (SELECT *, printed[:-2] AS cut, CASE WHEN k % 2 = 0 THEN try_cast(printed[:-2] AS DOUBLE) ELSE try_cast(replace(replace(printed[:-2], '$', ''), ',', '') AS DOUBLE) END AS cut_value FROM o),
 p AS (
  SELECT k, 'ocr_only' AS v, 'date' AS f, day AS x FROM d WHERE NOT none UNION ALL SELECT k, 'ocr_only', 'total_amount', 'Amount' FROM d WHERE has_total AND NOT none
  UNION ALL SELECT k, v, f, x FROM (SELECT k, v, unnest([{'f': 'invoice_number', 'x': 'INV-' || k}, {'f': 'date', 'x': day}, {'f': 'total_amount', 'x': CASE WHEN has_total THEN printed END}], recursive := true) FROM d, (SELECT unnest(['no_postprocessing', 'remove_postprocessing']) AS v) WHERE NOT none)
  UNION ALL SELECT k, v, f, x FROM (SELECT k, v, unnest([{'f': 'invoice_number', 'x': 'INV-' || k}, {'f': 'date', 'x': iso}, {'f': 'total_amount', 'x': CASE WHEN has_total THEN total END}], recursive := true) FROM d, (SELECT unnest(['text_only', 'full', 'remove_layout', 'confidence_threshold_0.50', 'confidence_threshold_0.60', 'confidence_threshold_0.75', 'confidence_threshold_0.90']) AS v) WHERE NOT none AND conf >= 0.4 AND conf >= CASE WHEN starts_with(v, 'conf') THEN v[-4:]::DOUBLE ELSE 0.0 END)
  UNION ALL SELECT k, 'reduce_ocr_quality', 'total_amount', regexp_replace(regexp_replace(printf('%.6f', cut_value), '0+$', ''), '[.]$', '') FROM d WHERE NOT none AND has_total AND conf = 0.9 AND cut_value IS NOT NULL),
 t AS (SELECT k, unnest([{'f': 'invoice_number', 'x': 'INV-' || k}, {'f': 'date', 'x': iso}, {'f': 'total_amount', 'x': CASE WHEN has_total THEN total END}], recursive := true) FROM o),
 v AS (SELECT k, v FROM o, (SELECT unnest(['ocr_only', 'text_only', 'no_postprocessing', 'full', 'remove_layout', 'remove_postprocessing', 'reduce_ocr_quality', 'confidence_threshold_0.50', 'confidence_threshold_0.60', 'confidence_threshold_0.75', 'confidence_threshold_0.90']) AS v)),
 c AS (SELECT v.v, v.k, (SELECT 1) AS one FROM v),
 j AS (SELECT coalesce(p.v, c.v) AS v, coalesce(p.k, c.k) AS k, coalesce(p.f, c.f) AS f, p.x AS p, c.x AS t FROM (SELECT * FROM p WHERE x IS NOT NULL) p FULL JOIN (SELECT c.v, t.k, t.f, t.x FROM c JOIN t USING (k) WHERE t.x IS NOT NULL) c ON p.k = c.k AND p.v = c.v AND p.f = c.f),
 s AS (SELECT v, k, count(p) AS n_pred, count(t) AS n_true, count(*) FILTER (p = t) AS tp, count(*) FILTER (p = t) = count(*) AS exact FROM j GROUP BY ALL)
"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, t, truth) of orders: three lines of tokens, some without a total, some read badly, some with no token at all."""
    # A small file is one split; what follows has no exchange that would spread its rows.
    k, o = F.col("o_orderkey"), read(spark, sf, "orders").repartition(spark.sparkContext.defaultParallelism)
    total = F.round("o_totalprice", 2)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", total), "0+$", ""), r"\.$", "")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    printed = F.when(k % 2 == 0, plain).otherwise(F.concat(F.lit("$"), F.format_number(total, 2)))
    conf = F.when(k % 10 == 0, 0.3).when(k % 5 == 0, 0.5).otherwise(0.9)
    said = [F.lit("Invoice"), F.lit("Number"), F.lit(":"), F.concat(F.lit("INV-"), k), F.lit("Date"), F.when(k % 3 == 0, iso).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")), F.lit("Total"), F.lit("Amount"), printed]
    token = lambda i, w: F.struct(F.lit(i).alias("pos"), w.alias("text"), conf.alias("confidence"), F.lit(i % 4 * 50).alias("x0"), F.lit(i // 4 * 30).alias("y0"), F.lit(1).alias("page_number"))
    every = F.array(*[token(i, w) for i, w in enumerate(said)])
    t = F.when(k % 13 == 0, F.slice(every, 1, 0)).when(k % 7 == 0, F.slice(every, 1, 6)).otherwise(every)
    truth = F.concat(F.lit('{"invoice_number": "INV-'), k, F.lit('", "date": "'), iso, F.lit('"'), F.when(k % 7 != 0, F.concat(F.lit(', "total_amount": '), plain)).otherwise(""), F.lit("}"))
    return o.select(k.alias("doc_id"), t.alias("t"), truth.alias("truth"))


@query(_BENCH_SQL + """, a AS (SELECT v AS variant, count(*) AS n_docs, avg(exact::INT) AS exact_match_accuracy, sum(tp) AS tp, sum(n_pred) AS np, sum(n_true) AS nt FROM s GROUP BY 1)
 SELECT variant, n_docs, exact_match_accuracy, round(coalesce(tp / np, 0), 6) AS precision, round(coalesce(tp / nt, 0), 6) AS recall FROM a""")
def benchmark_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Four baselines, three ablations and four confidence thresholds, from one reading of the tokens."""
    return benchmarks.summary(benchmarks.run(_samples(spark, sf), "2030-01-01")).select("variant", "n_docs", "exact_match_accuracy", "precision", "recall")


@query(_BENCH_SQL + "SELECT v AS variant, f AS field, count(p) AS n_pred, count(t) AS n_true, count(*) FILTER (p = t) AS tp FROM j GROUP BY ALL")
def benchmark_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The same by field."""
    return benchmarks.field_summary(benchmarks.run(_samples(spark, sf), "2030-01-01")).select("variant", "field", "n_pred", "n_true", "tp")


@query(_BENCH_SQL + """, g AS (SELECT k, max(2.0 * tp / nullif(n_pred + n_true, 0)) FILTER (v = 'text_only') AS text_f1, max(2.0 * tp / nullif(n_pred + n_true, 0)) FILTER (v = 'no_postprocessing') AS raw_f1, max(2.0 * tp / nullif(n_pred + n_true, 0)) FILTER (v = 'full') AS full_f1, max(tp = least(n_pred, n_true) AND n_pred > 0) FILTER (v = 'no_postprocessing') AS raw_whole, max(n_pred > 0) FILTER (v = 'text_only') AS text_any FROM s GROUP BY 1),
 x AS (SELECT k, 'ocr_errors' AS category FROM o WHERE none UNION ALL SELECT k, 'layout_errors' FROM g WHERE text_f1 > raw_f1 UNION ALL SELECT k, 'model_misclassification' FROM g WHERE text_any AND NOT raw_whole UNION ALL SELECT k, 'postprocessing_failures' FROM g WHERE raw_f1 > full_f1)
 SELECT category, count(*) AS n, array_to_string(list(k ORDER BY k)[1:5], ',') AS examples FROM x GROUP BY 1""")
def error_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by what went wrong, counted, and the first five of each kind."""
    got = benchmarks.error_report(benchmarks.run(_samples(spark, sf), "2030-01-01"))
    return got.select("category", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query("""WITH w AS (SELECT doc_id, w.w AS text, w.i - 1 AS i FROM (SELECT doc_id, unnest([{'w': x, 'i': i} FOR x, i IN [y FOR y IN string_split_regex(text, '\\s+') IF y <> '']]) AS w FROM documents)),
 f AS (SELECT doc_id, text, factor, ('0x' || sha256(doc_id || '::' || i || '::' || factor)[1:8])::BIGINT % 1000000 < factor * 1000000 AS hit, regexp_replace(text, '[aeiouAEIOU]', '', 'g') AS bare FROM w, (SELECT unnest([0.0, 0.1, 0.2])::DOUBLE AS factor))
 SELECT factor, doc_id, count(*) AS n_tokens, count(*) FILTER (hit) AS n_hit, sum(length(CASE WHEN hit AND bare <> '' THEN bare ELSE text END))::BIGINT AS n_chars, sum(CASE WHEN hit THEN 0.2 ELSE 0.5 END)::DOUBLE AS confidence FROM f GROUP BY ALL""")
def noise_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the documents as tokens, misread at three factors by seeds that every engine computes alike."""
    token = lambda w, i: F.struct(i.alias("pos"), w.alias("text"), F.lit(0.5).alias("confidence"))
    rows = read(spark, sf, "documents").select("doc_id", F.transform(S.words("text"), token).alias("t"))
    got = benchmarks.with_noise(rows.filter(F.size("t") > 0), [0.0, 0.1, 0.2])
    each = got.select("doc_id.factor", "doc_id.doc_id", F.explode("t").alias("x"))
    hit = F.col("x.confidence") < 0.4
    return each.groupBy("factor", "doc_id").agg(F.count("*").alias("n_tokens"), F.count_if(hit).alias("n_hit"), F.sum(F.length("x.text")).alias("n_chars"), F.sum(F.col("x.confidence").cast("decimal(18,6)")).cast("double").alias("confidence"))


# ---------------------------------------------------------------- evaluation
_SPELLINGS = ("yyyy-MM-dd'T'HH:mm", "'on' MMMM d, yyyy 'at noon'", "dd-MMM-yyyy", "yyyyMMdd", "'Date:' yyyy-MM-dd", "EEEE, d MMMM yyyy", "MMM. d, yyyy", "yyyy.MM.dd", "MM.dd.yyyy", "d 'of' MMMM yyyy")


@query("SELECT o_orderkey AS doc_id, o_orderkey % 11 <> 10 AS exact, CASE WHEN o_orderkey % 11 = 10 THEN 'date' ELSE '' END AS wrong FROM orders")
def exact_date_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written in ten layouts that no fixed format reads; every eleventh is a day off."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    said: Column = F.date_format(F.date_add(day, 1), _SPELLINGS[0])
    for i, layout in enumerate(_SPELLINGS):
        said = F.when(k % 11 == i, F.date_format(day, layout)).otherwise(said)
    doc = lambda date: F.struct(F.concat(F.lit("INV-"), k).alias("invoice_number"), date.alias("date"), F.lit("V").alias("vendor"), F.round("o_totalprice", 2).alias("total_amount"), F.lit(None).cast("array<struct<description:string,quantity:double,unit_price:double>>").alias("line_items"))
    rows = read(spark, sf, "orders").select(k.alias("doc_id"), doc(said).alias("pred"), doc(F.date_format(day, "yyyy-MM-dd")).alias("truth"))
    return evaluation.match_documents(rows).select("doc_id", "exact", F.array_join("wrong", ",").alias("wrong"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS c, o_custkey, round(o_totalprice, 2) AS total, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Vendor ' || o_custkey END AS vendor, lower('Bill INV-' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y-%m-%d') || ' by Vendor ' || o_custkey || ' for part ' || o_custkey || ' ' || printf('%.2f', (o_orderkey % 7 + 1)::DOUBLE) || ' times ' || printf('%.2f', o_custkey % 50 + 0.5) || ' sum ' || printf('%.2f', round(o_totalprice, 2))) AS s FROM orders),
 x AS (SELECT *, (c = 3 AND vendor IS NOT NULL) AS no_vendor, (c = 4)::INT AS half, 8 + CASE WHEN vendor IS NULL THEN 0 ELSE 2 END + 2 AS nt FROM o),
 y AS (SELECT *, (CASE WHEN c = 4 THEN 1 ELSE 2 END) + 3 + (CASE WHEN c = 3 OR vendor IS NULL THEN 0 ELSE 2 END) + (CASE WHEN c = 2 THEN 0 ELSE 1 END) + (CASE WHEN c = 5 THEN 0 ELSE 4 END) AS tp, 2 + 3 + (CASE WHEN c = 3 OR vendor IS NULL THEN 0 ELSE 2 END) + 1 + (CASE WHEN c = 5 THEN 0 ELSE 4 END) AS np, 6 + (CASE WHEN vendor IS NULL THEN 0 ELSE 2 END) + 4 AS n, 3 + (CASE WHEN c = 3 OR vendor IS NULL THEN 0 ELSE 1 END) + (CASE WHEN c = 5 THEN 0 ELSE 3 END) AS checked,
  CASE WHEN c = 2 AND NOT (contains(s, printf('%.2f', total + 1)) OR contains(s, regexp_replace(regexp_replace(printf('%.2f', total + 1), '0+$', ''), '[.]$', ''))) THEN 1 ELSE 0 END AS off FROM x)
 SELECT k AS doc_id, 2.0 * tp / (np + n) AS field_level_f1, (c IN (0, 1, 4) OR (c = 3 AND vendor IS NULL))::INT::DOUBLE AS exact_match, (c IN (0, 1, 4, 5) OR (c = 3 AND vendor IS NULL))::INT::DOUBLE AS without_items, (k % 7 <> 0)::INT::DOUBLE AS schema_valid, off / checked AS hallucination_rate, (k % 5 < 2)::INT::DOUBLE AS constraint_flag_rate, (k % 5 = 0)::INT::DOUBLE AS constraint_repair_rate, CASE WHEN vendor IS NOT NULL THEN CASE WHEN c = 3 THEN 0.0 ELSE 1.0 END END AS vendor_f1 FROM y""")
def evaluation_records(spark: SparkSession, sf: str) -> DataFrame:
    """The whole evaluation of a document in a row: scores, exactness without a field, schema, grounding, flags and repairs."""
    o = read(spark, sf, "orders")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    two = lambda v: F.format_string("%.2f", v.cast("double"))
    text = F.concat(F.lit("Bill INV-"), k, F.lit(" of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" by Vendor "), cust, F.lit(" for part "), cust, F.lit(" "), two(k % 7 + 1), F.lit(" times "), two(cust % 50 + 0.5), F.lit(" sum "), two(F.round("o_totalprice", 2)))
    day = F.when(k % 7 == 0, "soon").otherwise("2024-01-05")
    raw = F.concat(F.lit('{"invoice_number": "x", "date": "'), day, F.lit('", "vendor": null, "total_amount": 1.5, "line_items": []}'))
    flags = F.when(k % 5 == 0, F.array(F.lit("corrected_total_amount_from_line_items"))).when(k % 5 == 1, F.array(F.lit("line_items_total_mismatch"))).otherwise(F.array().cast("array<string>"))
    rows = _documents(spark, sf).join(o.select(k.alias("doc_id"), text.alias("text"), raw.alias("raw"), flags.alias("flags")), "doc_id")
    got = evaluation.evaluation_record(rows)
    return got.select("doc_id", "field_level_f1", "exact_match", F.col("exact_match_contribution")["line_items"].alias("without_items"), "schema_valid", "hallucination_rate", "constraint_flag_rate", "constraint_repair_rate", F.col("field_f1_conditional")["vendor"].alias("vendor_f1"))


@query("""WITH o AS (SELECT o_orderkey % 6 AS c, o_orderkey % 11 <> 0 AS vendor FROM orders)
 SELECT count(*) AS n_docs, count(*) FILTER (c = 0 OR (c = 3 AND NOT vendor)) AS exact, count(*) FILTER (c IN (0, 5) OR (c = 3 AND NOT vendor)) AS exact_without_items, count(*) AS with_items, count(*) FILTER (c <> 5) AS exact_items FROM o""")
def script_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The script scorer's exact matches: other date layouts and marks behind a number are differences to it."""
    return evaluation.script_scores(_documents(spark, sf)).select("n_docs", "exact", "exact_without_items", "with_items", "exact_items")


@query("""WITH o AS (SELECT o_orderkey % 6 AS c, o_orderkey % 11 <> 0 AS vendor, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS system, o_orderkey % 100 AS latency FROM orders)
 SELECT system, count(*) AS n_docs, sum(latency)::DOUBLE AS latency_ms_total, avg((c IN (0, 1, 4) OR (c = 3 AND NOT vendor))::INT) AS exact_match_mean, stddev_pop((c IN (0, 1, 4) OR (c = 3 AND NOT vendor))::INT) AS exact_match_std, avg(CASE WHEN c = 3 THEN 0.0 ELSE 1.0 END) FILTER (vendor) AS vendor_f1, count(*) FILTER (vendor) AS n_vendor, avg((c <> 2 AND c <> 5)::INT) AS without_vendor FROM o GROUP BY 1""")
def system_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A report of two systems with its breakdowns by field."""
    docs = _documents(spark, sf).withColumns({"text": F.lit(""), "latency_ms": (F.col("doc_id") % 100).cast("double")})
    records = evaluation.evaluation_record(docs).withColumn("system", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    got = evaluation.system_report(records)
    vendor = F.col("field_f1_conditional")["vendor"]
    return got.select("system", "n_docs", "latency_ms_total", "exact_match_mean", "exact_match_std", vendor["mean"].alias("vendor_f1"), vendor["count"].alias("n_vendor"), F.col("exact_match_contribution")["vendor"]["mean"].alias("without_vendor"))


# ---------------------------------------------------------------- costs
@query("SELECT event_id, coalesce(sum(round(value, 2)::DECIMAL(18,2)) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + 12.5 AS spent_before FROM events")
def running_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Costs before each event on top of what was spent earlier, over all events as one group."""
    e = read(spark, sf, "events").select("event_id", "ts", F.bround("value", 2).cast("decimal(18,2)").alias("cost"))
    return metrics.running_cost(e, [], ["ts", "event_id"], "cost", base=12.5).select("event_id", "spent_before")


@query("""WITH c AS (SELECT *, floor(value)::BIGINT AS cost FROM events), b AS (SELECT event_type, sum(cost) AS base FROM c WHERE event_id % 10 = 0 GROUP BY 1),
 r AS (SELECT c.event_type, c.event_id, c.cost, b.base AS base, b.base + coalesce(sum(c.cost) OVER (PARTITION BY c.event_type ORDER BY c.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c JOIN b USING (event_type) WHERE c.event_id % 10 <> 0)
 SELECT event_type, count(*) AS n_run, max(spent + cost)::DOUBLE AS spent FROM r WHERE spent < 4 * base GROUP BY 1""")
def capped_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Systems that go on where stored records have brought their costs, until these are four times as high."""
    e = read(spark, sf, "events").select("event_type", "event_id", F.floor("value").cast("double").alias("cost"))
    base = e.filter("event_id % 10 = 0").groupBy("event_type").agg(F.sum("cost").alias("base"))
    run = metrics.running_cost(e.filter("event_id % 10 <> 0"), ["event_type"], ["event_id"], "cost", base)
    kept = run.join(F.broadcast(base), "event_type").filter("spent_before < 4 * base")
    return kept.groupBy("event_type").agg(F.count("*").alias("n_run"), F.max(F.col("spent_before") + F.col("cost")).alias("spent"))
