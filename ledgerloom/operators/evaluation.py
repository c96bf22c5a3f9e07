"""Scoring of extracted documents: exact match, field and entity metrics, schema validity, grounding, masked F1.

Documents are rows with the five fields as columns: invoice_number, date, vendor, total_amount (text or number)
and line_items (structs of description, quantity, unit_price).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from ..functions.helpers import let, settled
from ..functions.scalars import cleanup_text, evaluation_date, evaluation_text, naive_amount
from .metrics import f1

FIELDS = ("invoice_number", "date", "vendor", "total_amount", "line_items")
# Fields that are amounts.
AMOUNTS = ("total_amount", "tax_amount", "subtotal", "unit_price", "price", "quantity")
#: Date layouts that are read without Python, month before day; any_date_text reads any other text.
LAYOUTS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "d-M-yyyy", "d/M/yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")


# ---------------------------------------------------------------- normal forms
def amount_text(c: Column) -> Column:
    """Two decimals of the number in a text, commas dropped."""
    return let(naive_amount(c.cast("string")), lambda v: F.format_string("%.2f", F.round(v, 2)))


def date_text(c: Column) -> Column:
    """ISO date, month first; null if it is no date in one of the layouts."""
    return let(F.replace(F.trim(c), F.lit(","), F.lit("")), lambda t: F.date_format(F.coalesce(*[F.try_to_date(t, f) for f in LAYOUTS]), "yyyy-MM-dd"))


def any_date_text(c: Column) -> Column:
    """ISO date of a text in any layout, month first; null if there is none. Only what the layouts leave goes through Python."""
    known = date_text(c)
    return F.coalesce(known, evaluation_date()(F.when(known.isNull(), F.trim(c))))


def plain_text(c: Column) -> Column:
    return F.nullif(F.trim(evaluation_text(c)), F.lit(""))


def items_text(items: Column) -> Column:
    """The items in normal form as JSON texts in order; none for null."""
    one = lambda x: F.to_json(F.struct(plain_text(x["description"]).alias("description"), amount_text(x["quantity"]).alias("quantity"), amount_text(x["unit_price"]).alias("unit_price")))
    return F.coalesce(F.array_join(F.array_sort(F.transform(items, one)), "\n"), F.lit(""))


def normal_form(doc: Column, field: str) -> Column:
    return {"date": any_date_text, "total_amount": amount_text, "line_items": items_text}.get(field, plain_text)(doc[field])


def present(doc: Column, field: str) -> Column:
    """Texts need more than blanks and lists a member; numbers, 0 too, are present."""
    v = doc[field]
    return F.coalesce(F.size(v) > 0 if field == "line_items" else F.trim(v.cast("string")) != "", F.lit(False))


def exact_match(pred: Column, truth: Column, names: tuple[str, ...] = FIELDS) -> Column:
    """Whether all named fields are equal in normal form."""
    return reduce(lambda a, b: a & b, [normal_form(pred, f).eqNullSafe(normal_form(truth, f)) for f in names])


def match_documents(docs: DataFrame, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """Adds exact, exact_without (a map: exact but for one field) and wrong (the fields that differ) to (…, pred, truth) rows; normal forms are made once."""
    pred, truth = F.col("pred"), F.col("truth")
    forms = settled(docs, {"__p": F.struct(*[normal_form(pred, f).alias(f) for f in names]), "__t": F.struct(*[normal_form(truth, f).alias(f) for f in names])})
    differ = F.array_compact(F.array(*[F.when(~F.col("__p")[f].eqNullSafe(F.col("__t")[f]), f) for f in names]))
    rows = forms.withColumn("wrong", differ).drop("__p", "__t")
    without = F.create_map(*[x for f in names for x in (F.lit(f), F.size(F.array_remove("wrong", f)) == 0)])
    return rows.withColumn("exact", F.size("wrong") == 0).withColumn("exact_without", without)


def mismatches(pred: Column, truth: Column, names: tuple[str, ...] = FIELDS) -> Column:
    """The named fields that differ in normal form."""
    return F.array_compact(F.array(*[F.when(~normal_form(pred, f).eqNullSafe(normal_form(truth, f)), f) for f in names]))


def value_tokens(doc: Column, field: str) -> Column:
    """Tokens of a field's value: numbers with two decimals, an item's members by their names' order."""
    read = lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9.]+"), F.lit(0))
    number = lambda v: F.format_string("%.2f", v.cast("double"))
    if field == "line_items":
        return F.coalesce(F.flatten(F.transform(doc[field], lambda x: read(F.concat_ws(" ", x["description"], F.when(x["quantity"].isNotNull(), number(x["quantity"])), F.when(x["unit_price"].isNotNull(), number(x["unit_price"])))))), F.array().cast("array<string>"))
    return read(F.when(doc[field].isNotNull(), number(doc[field])) if field == "total_amount" else F.trim(doc[field]))


def overlap(a: Column, b: Column) -> Column:
    """The size of the multiset intersection of two token arrays, by their sorted distinct tokens."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.transform(F.array_intersect(a, b), lambda t: F.least(count(a, t), count(b, t))), F.lit(0), lambda s, v: s + v)


def field_scores(docs: DataFrame, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, field, tp, n_pred, n_true, f1, present) for each field of (doc_id, pred, truth) rows."""
    pred, truth = F.col("pred"), F.col("truth")
    one = lambda f: F.struct(F.lit(f).alias("field"), value_tokens(pred, f).alias("p"), value_tokens(truth, f).alias("t"), present(truth, f).alias("present"))
    rows = docs.select("doc_id", F.inline(F.array(*map(one, names))))
    rows = rows.select("doc_id", "field", overlap(F.col("p"), F.col("t")).alias("tp"), F.size("p").alias("n_pred"), F.size("t").alias("n_true"), "present")
    return rows.withColumn("f1", f1(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def conditional_f1(scores: DataFrame) -> DataFrame:
    """(field, n, mean): the F1 over documents whose truth has the field; the mean is null without any."""
    kept = F.when(F.col("present"), F.col("f1"))
    return scores.groupBy("field").agg(F.count(kept).alias("n"), F.avg(kept).alias("mean"))


def micro_f1(scores: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The F1 of token counts added up over the fields."""
    sums = scores.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_true").alias("n_true"))
    return sums.withColumn("f1", f1(F.col("tp"), F.col("n_pred"), F.col("n_true")))


# ---------------------------------------------------------------- entities and structured output
def stringify(v: Column, number: bool = False) -> Column:
    """A value as text: numbers with up to six decimals, none for null."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v.cast("double")), "0+$", ""), r"\.$", "") if number else F.trim(v)
    return F.coalesce(F.when(v.isNotNull(), text), F.lit(""))


def stringify_items(items: Column) -> Column:
    """Items as description:..|quantity:..|unit_price:.., joined by |."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("description:"), stringify(x["description"]), F.lit("|quantity:"), stringify(x["quantity"], True), F.lit("|unit_price:"), stringify(x["unit_price"], True))), "|")


def structured_pairs(docs: DataFrame, doc: str) -> DataFrame:
    """(doc_id, field, value): a document column's fields as texts, empty ones left out."""
    text = lambda f: stringify_items(F.col(doc)[f]) if f == "line_items" else stringify(F.col(doc)[f], f == "total_amount")
    return docs.select("doc_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in FIELDS]))).filter("value <> ''")


def signature(field: Column, key: Column, value: Column) -> Column:
    return F.struct(F.lower(F.trim(F.coalesce(F.nullif(field, F.lit("")), key, F.lit("")))).alias("field"), stringify(value).alias("value"))


def precision_recall(tp: Column, fp: Column, fn: Column, digits: int | None = 6) -> list[Column]:
    """precision, recall and f1; the first two are rounded before they make the third. No digits: no rounding."""
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    part = lambda a, b: F.coalesce(cut(F.try_divide(a.cast("double"), b.cast("double"))), F.lit(0.0))
    p, r = part(tp, tp + fp), part(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), part(2 * p * r, p + r).alias("f1")]


def entity_counts(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn over the distinct (doc_id, field, value) of both sides, in one pass."""
    side = lambda df, p, t: df.select("doc_id", "field", "value", F.lit(p).alias("p"), F.lit(t).alias("t"))
    seen = side(pred, 1, 0).union(side(truth, 0, 1)).groupBy("doc_id", "field", "value").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    return seen.agg(F.count_if((F.col("p") == 1) & (F.col("t") == 1)).alias("tp"), F.count_if((F.col("p") == 1) & (F.col("t") == 0)).alias("fp"), F.count_if((F.col("p") == 0) & (F.col("t") == 1)).alias("fn"))


def structured_metrics(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(field, n_pred, n_true, matches, precision, recall, f1, accuracy) by field, and over all with a null field."""
    both = pred.select("doc_id", "field", F.col("value").alias("p")).join(truth.select("doc_id", "field", F.col("value").alias("t")), ["doc_id", "field"], "full")
    sums = both.rollup("field").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count_if(F.col("p") == F.col("t")).alias("matches"))
    m = F.col("matches")
    return sums.select("field", "n_pred", "n_true", "matches", *precision_recall(m, F.col("n_pred") - m, F.col("n_true") - m, None), F.coalesce(F.try_divide(m.cast("double"), F.col("n_true").cast("double")), F.lit(0.0)).alias("accuracy"))


def span_counts(rows: DataFrame) -> DataFrame:
    """(type, tp, n_pred, n_true) of whole spans of (doc_id, pos, word, pred, gold) labels, by the lenient rule that any change of type begins a span."""
    from .labels import bio_runs

    def spans(col: str, p: int, t: int) -> DataFrame:
        return bio_runs(rows.select("doc_id", "pos", "word", F.col(col).alias("tag"))).select("doc_id", "label", "start", "end", F.lit(p).alias("p"), F.lit(t).alias("t"))

    seen = spans("pred", 1, 0).union(spans("gold", 0, 1)).groupBy("doc_id", "label", "start", "end").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    return seen.groupBy(F.col("label").alias("type")).agg(F.count_if((F.col("p") > 0) & (F.col("t") > 0)).alias("tp"), F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"))


# ---------------------------------------------------------------- schema
def schema_valid(raw: Column) -> Column:
    """Whether a JSON text has the five fields with the right types: texts or nulls, an ISO date, a number or null, a list of objects."""
    v = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    has = lambda name: F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    text = lambda name: has(name) & kind(f"$.{name}").isin("STRING", "VOID")
    day = F.try_variant_get(v, "$.date", "string")
    date = text("date") & ((kind("$.date") == "VOID") | (day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull()))
    total = has("total_amount") & kind("$.total_amount").rlike(r"^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    items = F.try_variant_get(v, "$.line_items", "array<variant>")
    part = lambda x, name, allowed: F.coalesce(F.schema_of_variant(F.try_variant_get(x, f"$.{name}", "variant")).rlike(allowed), F.lit(True))
    numbers = r"^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
    listed = items.isNotNull() & F.forall(items, lambda x: F.schema_of_variant(x).startswith("OBJECT") & part(x, "description", "^(STRING|VOID)$") & part(x, "quantity", numbers) & part(x, "unit_price", numbers))
    return F.coalesce(text("invoice_number") & date & text("vendor") & total & listed, F.lit(False))


# ---------------------------------------------------------------- grounding
def source_text(c: Column) -> Column:
    """Lower case, one blank between words, without commas and currency signs."""
    return F.regexp_replace(F.translate(F.lower(cleanup_text(c)), ",$€£¥", ""), r"\s+", " ")


def textual_tokens(c: Column) -> Column:
    """Words of letters and digits; in mixed ones digits at the ends and between letters go and 0 turns o."""

    def fix(t: Column) -> Column:
        mixed = t.rlike("[a-z]") & t.rlike("[0-9]")
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^[0-9]+(?=[a-z])", ""), "(?<=[a-z])[0-9]+(?=[a-z])", ""), "(?<=[a-z])[0-9]+$", "")
        return F.when(mixed, F.replace(bare, F.lit("0"), F.lit("o"))).otherwise(t)

    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.filter(F.transform(F.filter(words, lambda x: x != ""), fix), lambda x: x != "")


def candidates(field: str, value: Column) -> Column:
    """The spellings by which a value may stand in the source; none for what cannot be looked for."""
    none = F.array().cast("array<string>")
    if field == "date":

        def spellings(d: Column) -> Column:
            day = F.to_date(d)
            return F.array(d, *[F.lower(F.date_format(day, p)) for p in ("MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")])

        return let(any_date_text(value), lambda d: F.when(d.isNull(), none).otherwise(spellings(d)))
    if field in AMOUNTS:
        return let(amount_text(value), lambda a: F.when(a.isNull(), none).otherwise(F.array_distinct(F.array(a, F.regexp_replace(F.regexp_replace(a, "0+$", ""), r"\.$", "")))))
    return let(F.array_join(textual_tokens(plain_text(value)), " "), lambda t: F.when(F.length(F.replace(t, F.lit(" "), F.lit(""))) >= 3, F.array(t)).otherwise(none))


def checks_of(pred: Column) -> Column:
    """ARRAY<STRUCT<path, value, candidates>> of the scalars of a document, without nulls and what cannot be looked for."""
    one = lambda path, name, v: F.struct(path.alias("path"), v.alias("value"), candidates(name, v).alias("candidates"))
    scalar = [one(F.lit(f), f, pred[f].cast("string")) for f in FIELDS if f != "line_items"]
    listed = F.coalesce(pred["line_items"], F.array().cast("array<struct<description:string,quantity:double,unit_price:double>>"))
    items = F.flatten(F.transform(listed, lambda x, i: F.array(*[one(F.format_string(f"line_items[%d].{n}", i), n, x[n].cast("string")) for n in ("description", "quantity", "unit_price")])))
    return F.filter(F.concat(F.array(*scalar), items), lambda c: c["value"].isNotNull() & (F.size(c["candidates"]) > 0))


def grounding_checks(docs: DataFrame) -> DataFrame:
    """(doc_id, path, value, candidates) of the scalars in pred of (doc_id, pred, …) rows."""
    return docs.select("doc_id", F.inline(checks_of(F.col("pred"))))


@F.pandas_udf(ArrayType(BooleanType()))
def _fuzzy(found: pd.Series, lines: pd.Series, bare: pd.Series) -> pd.Series:
    """For each of a document's checks, whether its tokens stand in a line: as they are, in order, or nearly.

    Texts of tokens: blanks between them, a line break behind each spelling and each line, a form feed behind each check.
    ``lines`` are the lines' tokens, ``bare`` those of the lines without their commas, in which the order is looked for.
    """
    from difflib import SequenceMatcher

    def alike(a: str, b: str) -> bool:
        return a == b or (min(len(a), len(b)) >= 4 and (a in b or b in a)) or SequenceMatcher(None, a, b).ratio() >= 0.84

    def in_order(wanted, line) -> bool:
        rest = iter(w for w in line if not w.isdigit())
        return all(any(alike(t, w) for w in rest) for t in wanted)

    def one(spellings, text_lines, bare_lines) -> bool:
        for text in spellings:
            if len(text) - text.count(" ") < 3:
                continue
            if any(text in line for line in text_lines) or any(in_order(text.split(" "), line) for line in bare_lines):
                return True
            if len(text) >= 5 and max((SequenceMatcher(None, text, line).ratio() for line in text_lines), default=0.0) >= 0.88:
                return True
        return False

    out = []
    for checks, text, plain in zip(found, lines, bare, strict=True):
        text_lines, bare_lines = text.split("\n")[:-1], [x.split(" ") for x in plain.split("\n")[:-1]]
        out.append([one(x.split("\n")[:-1], text_lines, bare_lines) for x in checks.split("\f")[:-1]])
    return pd.Series(out, dtype="object")


def grounded(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep…, path, value, grounded) for (…, pred, text) rows: plain search first, and fuzzy comparison of what it leaves.

    A plain hit is a spelling within the whole text. A document's other checks go through Python in one call, with
    its lines; documents without such checks send nothing. All of it stays in the document's row.
    """
    rows = settled(docs.select(*keep, "pred", "text"), {"c": checks_of(F.col("pred")), "s": source_text(F.col("text")), "l": F.split(F.coalesce("text", F.lit("")), r"\R")})
    rows = settled(rows, {"plain": F.transform("c", lambda x: F.exists(x["candidates"], lambda w: F.coalesce(F.contains(F.col("s"), w), F.lit(False))))})
    left = F.filter(F.transform("c", lambda x, i: F.when(~F.get("plain", i), i)), lambda i: i.isNotNull())
    rows = settled(rows, {"left": left})
    spelt = lambda x: F.array_join(textual_tokens(x), " ")
    behind = lambda xs, mark: F.array_join(F.transform(xs, lambda x: F.concat(x, F.lit(mark))), "")
    full = lambda of: F.when(F.size("left") > 0, behind(F.filter(F.transform("l", lambda x: spelt(of(x))), lambda x: x != ""), "\n")).otherwise("")
    wanted = behind(F.transform("left", lambda i: behind(F.filter(F.transform(F.get("c", i)["candidates"], spelt), lambda x: x != ""), "\n")), "\f")
    rows = settled(rows, {"w": wanted, "full": full(lambda x: x), "bare": full(source_text)})
    rows = rows.withColumn("fuzzy", _fuzzy("w", "full", "bare"))
    each = F.transform("c", lambda x, i: F.struct(x["path"].alias("path"), x["value"].alias("value"), (F.get("plain", i) | F.coalesce(F.get("fuzzy", F.array_position("left", i).cast("int") - 1), F.lit(False))).alias("grounded")))
    return rows.select(*keep, F.inline(each))


def hallucination(checks: DataFrame) -> DataFrame:
    """(doc_id, checked, hallucinated, rate) from (doc_id, grounded) rows."""
    return checks.groupBy("doc_id").agg(F.count("*").alias("checked"), F.count_if(~F.col("grounded")).alias("hallucinated")).withColumn("rate", F.col("hallucinated") / F.col("checked"))


def hallucination_rates(per_doc: DataFrame) -> DataFrame:
    """micro, the ratio of the sums, and macro, the mean of the documents' rates."""
    return per_doc.agg(F.coalesce(F.try_divide(F.sum("hallucinated").cast("double"), F.sum("checked").cast("double")), F.lit(0.0)).alias("micro"), F.coalesce(F.avg("rate"), F.lit(0.0)).alias("macro"))


def evaluation_record(docs: DataFrame) -> DataFrame:
    """The evaluation of each (doc_id, pred, truth, text) row, with raw (the reply's JSON), flags, latency_ms and cost_usd where there are such columns.

    field_f1, field_f1_conditional and exact_match_contribution are maps by field; the conditional F1 is null
    where the truth hasn't the field. Rates of flags and repairs are 0 or 1 a document.
    """
    has = lambda name, default: F.coalesce(F.col(name), default) if name in docs.columns else default
    rows = match_documents(docs).withColumn("flags", has("flags", F.array().cast("array<string>")))
    one = lambda f: F.struct(F.lit(f).alias("field"), value_tokens(F.col("pred"), f).alias("p"), value_tokens(F.col("truth"), f).alias("t"), present(F.col("truth"), f).alias("present"))
    rows = rows.withColumn("__s", F.array(*map(one, FIELDS)))
    rows = rows.withColumn("__s", F.transform("__s", lambda x: F.struct(x["field"].alias("field"), x["present"].alias("present"), overlap(x["p"], x["t"]).cast("long").alias("tp"), F.size(x["p"]).cast("long").alias("np"), F.size(x["t"]).cast("long").alias("nt"))))
    total = lambda c: F.aggregate(F.transform("__s", lambda x: x[c]), F.lit(0).cast("long"), lambda a, v: a + v)
    by_field = lambda value: F.map_from_entries(F.transform("__s", lambda x: F.struct(x["field"].alias("key"), value(x).alias("value"))))
    score = lambda x: f1(x["tp"], x["np"], x["nt"])
    valid = schema_valid(F.col("raw")) if "raw" in docs.columns else F.lit(None).cast("boolean")
    rate = lambda c: c.cast("int").cast("double")
    out = rows.select(
        "doc_id", by_field(score).alias("field_f1"), f1(total("tp"), total("np"), total("nt")).alias("field_level_f1"), rate(F.col("exact")).alias("exact_match"),
        by_field(lambda x: F.when(x["present"], score(x))).alias("field_f1_conditional"), F.transform_values("exact_without", lambda _, v: rate(v)).alias("exact_match_contribution"), rate(valid).alias("schema_valid"),
        rate(F.size("flags") > 0).alias("constraint_flag_rate"), rate(F.exists("flags", lambda x: F.contains(x, F.lit("corrected_")) | F.contains(x, F.lit("repaired")))).alias("constraint_repair_rate"),
        has("latency_ms", F.lit(0.0)).cast("double").alias("latency_ms"), has("cost_usd", F.lit(0.0)).cast("double").alias("cost_usd"),
    )
    h = hallucination(grounded(docs)).select("doc_id", F.col("rate").alias("hallucination_rate"))
    return out.join(h, "doc_id", "left").withColumn("hallucination_rate", F.coalesce("hallucination_rate", F.lit(0.0)))


# ---------------------------------------------------------------- the script scorer
def script_tokens(doc: Column, field: str) -> Column:
    """Tokens of a value written as it is: numbers are not brought to two decimals."""
    read = lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9.]+"), F.lit(0))
    if field == "line_items":
        return F.coalesce(F.flatten(F.transform(doc[field], lambda x: F.concat(*[read(x[n].cast("string")) for n in ("description", "quantity", "unit_price")]))), F.array().cast("array<string>"))
    return read(doc[field].cast("string"))


def masked_f1(docs: DataFrame, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, present, tp, fp, fn): token counts over documents whose truth has the field; missing predictions count as empty."""
    pred, truth = F.col("pred"), F.col("truth")
    one = lambda f: F.struct(F.lit(f).alias("field"), script_tokens(pred, f).alias("p"), script_tokens(truth, f).alias("t"), (F.size(truth[f]) > 0 if f == "line_items" else truth[f].cast("string") != "").alias("present"))
    rows = docs.select(F.inline(F.array(*map(one, names)))).filter("present")
    tp = overlap(F.col("p"), F.col("t"))
    return rows.select("field", tp.alias("tp"), F.size("p").alias("np"), F.size("t").alias("nt")).groupBy("field").agg(F.count("*").alias("present"), F.sum("tp").alias("tp"), (F.sum("np") - F.sum("tp")).alias("fp"), (F.sum("nt") - F.sum("tp")).alias("fn"))


def script_form(v: Column, field: str) -> Column:
    """The script scorer's normal form: two decimals for the total alone, a date's ISO part or else its text, other values as they are written."""
    text = F.nullif(F.lower(F.trim(F.regexp_replace(v.cast("string"), r"(?U)\s+", " "))), F.lit(""))
    if field == "total_amount":
        return amount_text(v)
    if field == "date":
        return F.coalesce(F.nullif(F.regexp_extract(v.cast("string"), r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit("")), text)
    return text


def script_scores(docs: DataFrame, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row over (pred, truth): micro precision, recall and F1 of the fields that the truth has, exact documents with and without items, and exact item lists among those there are."""
    pred, truth = F.col("pred"), F.col("truth")
    item = lambda x: F.to_json(F.struct(*[script_form(x[n], n).alias(n) for n in ("description", "quantity", "unit_price")]), {"ignoreNullFields": "false"})
    items = lambda d: F.coalesce(F.array_join(F.array_sort(F.transform(d["line_items"], item)), "\n"), F.lit(""))
    form = lambda d, f: items(d) if f == "line_items" else script_form(d[f], f)
    rows = settled(docs, {"__same": F.array(*[form(pred, f).eqNullSafe(form(truth, f)) for f in names])})
    listed = F.coalesce(F.size(truth["line_items"]) > 0, F.lit(False))
    all_but = F.array(*[F.get("__same", i) for i, f in enumerate(names) if f != "line_items"])
    exact = rows.agg(F.count("*").alias("n_docs"), F.count_if(F.forall("__same", lambda x: x)).alias("exact"), F.count_if(F.forall(all_but, lambda x: x)).alias("exact_without_items"), F.count_if(listed).alias("with_items"), F.count_if(listed & F.get("__same", names.index("line_items"))).alias("exact_items"))
    sums = masked_f1(docs, names).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return exact.join(F.broadcast(sums)).select("n_docs", "exact", "exact_without_items", "with_items", "exact_items", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn"), None))


#: Metrics of a record whose mean and deviation a report has.
REPORTED = ("field_level_f1", "exact_match", "schema_valid", "hallucination_rate", "constraint_flag_rate", "constraint_repair_rate", "latency_ms", "cost_usd")


def system_report(records: DataFrame) -> DataFrame:
    """A row a system of (system, …) records from ``evaluation_record``: means and deviations, totals, and each field's F1, F1 where it is present, and share of documents that are exact without it.

    Breakdowns are maps by field. One aggregation; a field's values are columns, since the fields are few.
    """
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    plain = [x for m in REPORTED for x in (F.avg(zero(F.col(m))).alias(f"{m}_mean"), F.stddev_pop(zero(F.col(m))).alias(f"{m}_std"))]
    by_field = lambda name, value: F.create_map(*[x for f in FIELDS for x in (F.lit(f), value(F.col(name)[f]))])
    spread = lambda c: F.struct(F.avg(zero(c)).alias("mean"), F.stddev_pop(zero(c)).alias("std"))
    present_ = lambda c: F.struct(F.avg(c).alias("mean"), F.count(c).alias("count"))
    return records.groupBy("system").agg(F.count("*").alias("n_docs"), F.sum(zero(F.col("cost_usd"))).alias("cost_usd_total"), F.sum(zero(F.col("latency_ms"))).alias("latency_ms_total"), *plain, by_field("field_f1", spread).alias("field_f1"), by_field("field_f1_conditional", present_).alias("field_f1_conditional"), by_field("exact_match_contribution", spread).alias("exact_match_contribution"))


def system_summary(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(system, n_docs, total_cost, total_latency_ms, <metric>_mean, <metric>_std): absent metrics count as 0."""
    zero = lambda m: F.coalesce(F.col(m), F.lit(0.0))
    return scores.groupBy("system").agg(F.count("*").alias("n_docs"), F.sum(zero("cost_usd")).alias("total_cost"), F.sum(zero("latency_ms")).alias("total_latency_ms"), *[x for m in metrics for x in (F.avg(zero(m)).alias(f"{m}_mean"), F.stddev_pop(zero(m)).alias(f"{m}_std"))])
