"""From tokens to checked fields: label, group, recover, normalize, merge, validate, constrain, confidence; warnings.

``parse`` chains the stages within a document's row. The functions beside it do single stages on a long table
(doc_id, field, value, ...). A labeler is any function from tokens to labelled tokens (doc_id, pos, label).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.helpers import mean, settled
from ..functions.scalars import ALIASES, canonical_field
from . import fields as rules
from . import packed, spans


def entities_of(labelled: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """(doc_id, pos, field, key, value, confidence, code) of labelled tokens; code is missing_value, orphan_value or null."""
    typed = labelled if "category" in labelled.columns else labelled.withColumn("category", F.lit(""))
    pairs = spans.pair_spans(spans.bio_spans(typed))
    code = F.when(F.col("status") != "paired", F.col("status"))
    field = F.when(F.col("key").isNotNull(), canonical_field("key", aliases))
    return pairs.select("doc_id", F.col("span_no").alias("pos"), field.alias("field"), "key", F.when(F.col("status") == "paired", F.col("value")).alias("value"), "confidence", code.alias("code"))


def parse(tokens: DataFrame, today: str, aliases: dict[str, str] = ALIASES, labeler: Callable[[DataFrame], DataFrame] | None = None, threshold: float = rules.MIN_CONFIDENCE, drop: bool = True, with_recovery: bool = True, with_constraints: bool = True, repair: bool = True) -> DataFrame:
    """(doc_id, field, value, confidence, valid, status, codes): the checked fields of (doc_id, pos, text, confidence, x0, y0, page_number) tokens.

    codes has the field's errors in the order of the stages. A document's errors without a field, such as
    orphan values, stand in rows without field; missing required fields in rows with status missing. The whole
    chain runs in a document's row, see ``packed``.
    """
    if labeler is not None:
        labelled = labeler(tokens)
        extra = [c for c in ("label", "category") if c in labelled.columns]
        tokens = tokens.drop("label", "category").join(labelled.select("doc_id", "pos", *extra), ["doc_id", "pos"])
    return packed.long_fields(packed.documents(tokens, today, aliases, threshold, drop, with_recovery, with_constraints, repair))


# Fixed value: the shape of a token that is an invoice number.
INVOICE_TOKEN = r"(?i)^[A-Z0-9][A-Z0-9_\-/]*[-_/][A-Z0-9][A-Z0-9_\-/]*$"


def invoice_conflicts(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_numbers, conflict): distinct invoice numbers among the tokens, whatever their case."""
    number = F.upper(F.trim("text"))
    return tokens.groupBy("doc_id").agg(F.countDistinct(F.when(number.rlike(INVOICE_TOKEN), number)).alias("n_numbers")).withColumn("conflict", F.col("n_numbers") >= 2)


def warnings(documents: DataFrame, tokens: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, warnings) of all (doc_id, page_count) documents; multi_page_inconsistency can stand twice."""
    seen = tokens.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("c")).join(invoice_conflicts(tokens).select("doc_id", "conflict"), "doc_id")
    codes = parsed.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))
    return _listed(documents.select("doc_id", "page_count").join(seen, "doc_id", "left").join(codes, "doc_id", "left"))


def _listed(both: DataFrame) -> DataFrame:
    """(doc_id, warnings) of rows (doc_id, page_count, n, c, conflict, codes)."""
    has = lambda code: F.coalesce(F.array_contains("codes", code), F.lit(False))
    several = F.col("page_count") > 1
    listed = F.array_compact(F.array(F.when((F.col("n") < 3) | (F.col("c") < 0.55), "noisy_ocr_output"), F.when(has("missing_required_field"), "missing_required_fields"), F.when(several & has("conflicting_values"), "multi_page_inconsistency"), F.when(several & F.col("conflict"), "multi_page_inconsistency")))
    return both.select("doc_id", F.when(F.col("n").isNull(), F.array(F.lit("empty_document"))).otherwise(listed).alias("warnings"))


def confidence_summary(parsed: DataFrame) -> DataFrame:
    """(doc_id, average, minimum, maximum, kept_fields, dropped_fields) of parsed fields; zeros without any."""
    c = F.when(F.col("field").isNotNull() & F.col("status").isin("kept", "retained"), F.col("confidence"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return parsed.groupBy("doc_id").agg(zero(F.avg(c)).alias("average"), zero(F.min(c)).alias("minimum"), zero(F.max(c)).alias("maximum"), F.count(c).alias("kept_fields"), F.count_if(F.array_contains("codes", "low_confidence")).alias("dropped_fields"))


def packed_summary(docs: DataFrame) -> DataFrame:
    """``confidence_summary`` of the packed documents (doc_id, fields), read off each row; without a second grouping."""
    kept = F.transform(F.filter("fields", lambda r: r["status"].isin("kept", "retained")), lambda r: r["confidence"])
    rows = settled(docs, {"__c": kept})
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    dropped = F.size(F.filter("fields", lambda r: F.array_contains(r["codes"], "low_confidence")))
    return rows.select("doc_id", zero(mean(F.col("__c"))).alias("average"), zero(F.array_min("__c")).alias("minimum"), zero(F.array_max("__c")).alias("maximum"), F.size("__c").cast("long").alias("kept_fields"), dropped.cast("long").alias("dropped_fields"))


def packed_warnings(documents: DataFrame, docs: DataFrame) -> DataFrame:
    """``warnings`` of (doc_id, page_count) documents, from the packed documents with their tokens (doc_id, t, fields): one join, nothing is grouped again."""
    number = F.transform("t", lambda x: F.upper(F.trim(x["text"])))
    numbers = F.array_distinct(F.filter(number, lambda v: v.rlike(INVOICE_TOKEN)))
    c = mean(F.filter(F.transform("t", lambda x: x["confidence"].cast("double")), lambda v: v.isNotNull()))
    codes = F.array_distinct(F.flatten(F.transform("fields", lambda r: r["codes"])))
    seen = settled(docs, {"n": F.size("t"), "c": c, "conflict": F.size(numbers) >= 2, "codes": codes}).select("doc_id", "n", "c", "conflict", "codes")
    return _listed(documents.select("doc_id", "page_count").join(seen, "doc_id", "left"))


def threshold_filter(fields: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, doc_id, field, value, confidence, message): each field at each threshold, with the message of those that are dropped."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = fields.select(levels, "doc_id", "field", "value", "confidence")
    return rows.withColumn("message", F.when(F.col("confidence") < F.col("threshold"), F.format_string("Field dropped at threshold %.2f.", "threshold")))


def structured(entities: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence, valid): raw entities without any checks, the last of a field wins."""
    last = F.row_number().over(W.partitionBy("doc_id", "field").orderBy(F.desc("pos")))
    return entities.filter("field is not null").withColumn("__n", last).filter("__n = 1").select("doc_id", "field", "value", "confidence", F.col("value").isNotNull().alias("valid"))


def suppress_prose_items(docs: DataFrame) -> DataFrame:
    """Adds suppressed and empties line_items (description, quantity, unit_price) of (doc_id, text, line_items) rows that are prose on a document that is no receipt.

    Items are prose if none has a price or quantity and at least half (rounded down, one at least) of the
    described ones have six words or 40 characters.
    """
    low = F.lower("text")
    words_ = F.aggregate(F.array(*[F.contains(low, F.lit(k)).cast("int") for k in ("subtotal", "total", "tax", "cash", "change", "qty", "items")]), F.lit(0), lambda s, v: s + v)
    receipt = (words_ >= 2) & (F.regexp_count(low, F.lit(r"\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{2})?|\d+\.\d{2}")) >= 3)
    plain = ~F.exists("line_items", lambda x: x["unit_price"].isNotNull() | x["quantity"].isNotNull())
    told = F.filter(F.transform("line_items", lambda x: F.trim(F.coalesce(x["description"], F.lit("")))), lambda d: d != "")
    long = F.filter(told, lambda d: (F.size(F.split(d, r"\s+")) >= 6) | (F.length(d) >= 40))
    prose = ~F.coalesce(receipt, F.lit(False)) & plain & (F.size(told) > 0) & (F.size(long) >= F.greatest(F.lit(1), F.floor(F.size(told) / 2)))
    return docs.withColumn("suppressed", F.coalesce(prose, F.lit(False))).withColumn("line_items", F.when(F.col("suppressed"), F.slice("line_items", 1, 0)).otherwise(F.col("line_items")))


# ---------------------------------------------------------------- the simple variants
def simple_date(c: Column) -> Column:
    """ISO text of a date in one of four layouts, day before month where both fit."""
    t = F.trim(c)
    return F.date_format(F.coalesce(*[F.try_to_date(t, f) for f in ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy")]), "yyyy-MM-dd")


def simple_document(docs: DataFrame) -> DataFrame:
    """invoice_number, date, vendor and total_amount texts of each row cleaned up; what is invalid turns null."""
    from ..functions.scalars import naive_amount, normalize_string

    number = normalize_string("invoice_number")
    cols = {"invoice_number": F.when(number.rlike("^[A-Za-z0-9][A-Za-z0-9/_-]{1,63}$"), number), "date": simple_date(F.col("date")), "vendor": normalize_string("vendor"), "total_amount": naive_amount("total_amount")}
    return docs.withColumns(cols)


def simple_constraints(docs: DataFrame) -> DataFrame:
    """Adds flags: line_items_sum_mismatch where a total isn't the sum of price times quantity, an absent quantity being 1."""
    amounts = F.transform("line_items", lambda x: x["price"] * F.when(x["has_quantity"], x["quantity"]).otherwise(F.lit(1.0)))
    sum_ = F.aggregate(F.filter(amounts, lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v)
    off = F.col("total_amount").isNotNull() & F.col("line_items").isNotNull() & (F.abs(sum_ - F.col("total_amount")) > 0.01)
    return docs.withColumn("flags", F.when(off, F.array(F.lit("line_items_sum_mismatch"))).otherwise(F.array().cast("array<string>")))
