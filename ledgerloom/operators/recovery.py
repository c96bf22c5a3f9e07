"""Heuristic recovery of fields from grouped lines (doc_id, line_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.helpers import let
from ..functions.scalars import ALIASES, is_quantity, merge_space_thousands, recovery_amount, token_amounts, words

# Date shapes, and words that mark a receipt's totals section.
DATE_SHAPES = (r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{2,4}\b")
INVOICE_SHAPES = (r"(?i)(?:invoice|receipt|bill)\s*(?:no|number|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-_/]*)", r"(?i)\b(?:inv|rcpt)[\s:#-]*([A-Z0-9][A-Z0-9\-_/]*)\b")
# The patterns of a totals section; any may match.
SECTION_SHAPES = (
    r"\btotal\w*\b|\bsub\s*total\b",
    r"\bsub\w*\b",
    r"\bgrand\b|\bamount\s*due\b|\bbalance\s*due\b",
    r"\bcash\b|\bchang\w*\b|\bkembal\w*\b|\bbayar\w*\b|\bpembayaran\b|\btunai\b",
    r"\bcg\b|\btl\b|\brp\b|\bidr\b",
    r"\bdisc\w*\b|\bdiskon\b",
    r"\bpajak\b|\bpaj\b|\bppn\b|\bpb1\b|\bservi\w*\b|\bservice\s*charge\b",
    r"\btax\b|\btips?\b|\binc\b|\bpayment\b|\bpay\b",
)
SECTION = "(?i)" + "|".join(SECTION_SHAPES)

# Words of lines that are no description, of lines that name no vendor, and of company names.
HEADER_WORDS = r"subtotal|total|tax|cash|change|date|invoice"
NO_VENDOR = "total|tax|subtotal|invoice|receipt|date|cash|change"
COMPANY = r"\b(?:store|vendor|merchant|seller|supplier|corp|inc|llc|ltd|cafe|restaurant)\b"
# Lines of a total, from the surest on, and lines that count items.
GRAND, PLAIN, SUB = r"\b(grand\s+total|total\s+due|amount\s+due|balance\s+due)\b", r"\btotal\b|\btl\b|\bnet\b", r"subtotal|\bsub\b"
COUNT_LINE = r"\btotal\s*(item|qty|count|barang)\b"


def recover_total(lines: DataFrame) -> DataFrame:
    """(doc_id, total, confidence): the line's keyword scores 6, 4 or 1, and 0.2 for every line above it; else the last plausible amount."""
    t = merge_space_thousands(F.trim("text"))
    low = F.lower(t)
    keyed = lines.select("doc_id", "line_no", low.alias("low"), token_amounts(t).alias("amounts")).filter("size(amounts) > 0")
    grand, plain, sub = F.col("low").rlike(GRAND), F.col("low").rlike(PLAIN), F.col("low").rlike(SUB)
    score = F.when(F.col("low").rlike(COUNT_LINE), None).when(grand, 6.0).when(plain, 4.0).when(sub, 1.0) + F.col("line_no") * 0.2
    conf = F.when(grand, 0.78).when(plain, 0.72).otherwise(0.55)
    last = F.element_at("amounts", -1)
    fine = F.filter("amounts", lambda v: v.between(1, 50_000_000))
    scored = keyed.select("doc_id", "line_no", score.alias("score"), conf.alias("conf"), last.alias("last"), F.try_element_at(fine, F.lit(-1)).alias("spare"))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("last", "conf"), F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("line_no")).alias("n")))).alias("b"), F.max_by("spare", F.when(F.col("spare").isNotNull(), F.col("line_no"))).alias("spare"))
    return best.select("doc_id", F.coalesce("b.last", "spare").alias("total"), F.coalesce("b.conf", F.when(F.col("spare").isNotNull(), 0.5), F.lit(0.0)).alias("confidence"))


def resolve_price(numbers: Column, quantity: Column) -> Column:
    """STRUCT(quantity, unit_price) from a line's numbers and its leading quantity."""

    def rule(n: Column) -> Column:
        one, two = F.get(n, 0), F.get(n, 1)
        first_price = F.coalesce(F.get(F.filter(n, lambda v: ~is_quantity(v)), 0), one)
        pick = lambda q, p: F.struct(q.cast("double").alias("quantity"), p.cast("double").alias("unit_price"))
        nothing = F.lit(None)
        return (
            F.when((F.size(n) == 0) | (F.array_max(n) > 1e9), pick(quantity, nothing))
            .when(F.size(n) == 1, pick(quantity, one))
            .when(quantity.isNotNull(), pick(quantity, first_price))
            .when(is_quantity(one) & ~is_quantity(two), pick(one, two))
            .when(is_quantity(two) & ~is_quantity(one), pick(two, one))
            .when(F.size(n) == 2, pick(quantity, two))
            .otherwise(pick(quantity, one))
        )

    return let(numbers, rule)


def clean_description(c: Column) -> Column:
    """One blank between words, a leading x and blanks and dashes at the ends dropped."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"(?i)^x ", ""), r"^[ -]+|[ -]+$", "")


def recover_line_items(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, description, quantity, unit_price) of single-line items and of a description followed by a line of numbers.

    The pending description joins the description lines since the last item, section line or line of
    numbers; lines of marks alone, or with a header's keyword, leave it as it is. The lines are read once:
    what is pending for a line is a window over the lines of its island.
    """
    t = merge_space_thousands(F.trim("text"))
    base = lines.select("doc_id", "line_no", t.alias("t")).filter("t <> ''").select("*", words(F.col("t")).alias("w"))
    lead = F.regexp_extract(F.get("w", 0), r"(?i)^(\d{1,2})\s*x?$", 1)
    rest = F.when(lead != "", F.slice("w", 2, F.size("w"))).otherwise(F.col("w"))
    parsed = base.select("doc_id", "line_no", "t", F.nullif(lead, F.lit("")).cast("double").alias("lead"), rest.alias("rest"), F.col("t").rlike(SECTION).alias("section"), token_amounts(F.col("t")).alias("all"))
    numbers = F.filter("rest", lambda x: x.rlike(r"^[0-9.,]+$"))
    desc = clean_description(F.array_join(F.filter("rest", lambda x: ~x.rlike(r"^[0-9.,]+$") & ~F.lower(x).isin("x", "@")), " "))
    parsed = parsed.select("doc_id", "line_no", "t", "lead", "section", "all", F.filter(F.transform(numbers, recovery_amount), lambda v: v.isNotNull()).alias("numbers"), (F.size(numbers) > 0).alias("has_number"), desc.alias("description"))
    is_item = F.col("has_number") & ((F.col("description") != "") | (F.coalesce("lead", F.lit(0.0)) != 0))
    only_text = F.col("t").rlike("[A-Za-z]") & (F.size("all") == 0) & ~F.lower("t").rlike(HEADER_WORDS)
    kind = F.when(F.col("section"), "section").when(is_item, "item").when(F.size("all") > 0, "numbers").when(only_text, "text").otherwise("none")
    w = W.partitionBy("doc_id").orderBy("line_no")
    ends = F.when(F.col("kind").isin("section", "item", "numbers"), 1).otherwise(0)
    kinds = parsed.withColumn("kind", kind).withColumn("island", F.coalesce(F.sum(ends).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = W.partitionBy("doc_id", "island").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    pending = F.array_join(F.collect_list(F.when(F.col("kind") == "text", clean_description(F.col("t")))).over(before), " ")
    ready = kinds.withColumn("pending", F.nullif(F.trim(pending), F.lit(""))).filter("kind in ('item', 'numbers')")
    price = resolve_price(F.when(F.col("kind") == "item", F.col("numbers")).otherwise(F.col("all")), F.when(F.col("kind") == "item", F.col("lead")))
    out = ready.select("doc_id", "line_no", "kind", F.coalesce(F.when(F.col("kind") == "item", F.nullif(F.col("description"), F.lit(""))), F.col("pending")).alias("description"), price.alias("p"))
    return out.filter("description is not null and (kind = 'item' or p.unit_price is not null)").select("doc_id", "line_no", "description", "p.quantity", "p.unit_price")


def recover_header(lines: DataFrame, first: int = 5, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """doc_id, invoice_number, date, vendor, receipt and head_confidence in one aggregation over the lines.

    head_confidence is that of recovered fields: the mean confidence of the first three lines between
    0.45 and 0.75, 0.55 without any. The date is looked for line by line, then over the whole text.
    """
    text, conf = F.trim("text"), (F.col("confidence") if "confidence" in lines.columns else F.lit(None).cast("double"))
    found = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 0), F.lit("")) for p in DATE_SHAPES])
    low = F.lower(text)
    vendor = (F.col("line_no") < first) & (text != "") & ~low.rlike(NO_VENDOR) & ~low.isin(*map(str.lower, aliases)) & (F.regexp_count(text, F.lit(r"\d")) <= 0.05 * F.length(text)) & low.rlike(COMPANY) & ((F.size(words(text)) >= 2) | (text == F.upper(text)))
    got = lines.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("t"),
        F.min_by(found, F.when(found.isNotNull(), F.struct(~low.contains("date"), F.col("line_no")))).alias("by_line"),
        F.min_by(text, F.when(vendor, F.col("line_no"))).alias("vendor"),
        (F.bool_or(F.col("text").rlike(SECTION)) & (F.sum(F.size(token_amounts(merge_space_thousands("text")))) >= 2)).alias("receipt"),
        F.avg(F.when(F.col("line_no") < 3, conf)).alias("c"),
    )
    whole = F.coalesce(*[F.nullif(F.regexp_extract("t", p, 0), F.lit("")) for p in DATE_SHAPES])
    number = F.coalesce(*[F.nullif(F.regexp_extract("t", p, 1), F.lit("")) for p in INVOICE_SHAPES])
    return got.select("doc_id", number.alias("invoice_number"), F.coalesce("by_line", whole).alias("date"), "vendor", "receipt", F.when(F.col("c").isNull(), 0.55).otherwise(F.greatest(F.lit(0.45), F.least(F.lit(0.75), F.col("c")))).alias("head_confidence"))


def items_confidence(items: Column) -> Column:
    """The mean of 0.78 for items with price and quantity, 0.68 with a price and 0.55 for others, between 0.5 and 0.78; 0.5 without items."""
    scores = F.transform(items, lambda x: F.when(x["unit_price"].isNull(), 0.55).when(x["quantity"].isNull(), 0.68).otherwise(0.78))
    mean = F.aggregate(scores, F.lit(0.0), lambda s, v: s + v) / F.size(items)
    return F.when(F.size(items) > 0, F.greatest(F.lit(0.5), F.least(F.lit(0.78), mean))).otherwise(0.5)


def looks_valid(field: Column, value: Column) -> Column:
    """Whether an extracted value is good enough to need no recovery."""
    text = F.trim(value)
    rule = (
        F.when(field == "date", text.rlike(DATE_SHAPES[0]) | text.rlike(DATE_SHAPES[1]) | text.rlike(DATE_SHAPES[2]))
        .when(field == "invoice_number", text.rlike(r"(?i)^[A-Z0-9][A-Z0-9\-_/]*$"))
        .when(field == "total_amount", F.size(token_amounts(merge_space_thousands(text))) > 0)
        .when(field == "vendor", (F.size(words(text)) >= 2) & ~text.rlike(r"\d"))
        .otherwise(F.lit(True))
    )
    return F.coalesce((value != "") & rule, F.lit(False))
