"""Field records: merging duplicates, validation, constraints with repair, confidence policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.helpers import let

# Field classes, patterns and thresholds of the default settings.
DATE_FIELDS = ("date", "invoice_date", "due_date")
CURRENCY_FIELDS = ("total_amount", "subtotal", "tax_amount")
REQUIRED = ("invoice_number", "date", "total_amount")
PATTERNS = {"invoice_number": r"^[A-Za-z0-9][A-Za-z0-9_/-]{1,63}$", "date": r"^\d{4}-\d{2}-\d{2}$", "invoice_date": r"^\d{4}-\d{2}-\d{2}$", "due_date": r"^\d{4}-\d{2}-\d{2}$", "total_amount": r"^-?\d+(\.\d+)?$", "subtotal": r"^-?\d+(\.\d+)?$", "tax_amount": r"^-?\d+(\.\d+)?$"}
TOLERANCE, MIN_CONFIDENCE = 0.01, 0.60


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def is_iso_date(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def merge_duplicates(entities: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence, conflicts) folded in order of pos: equal values average pairwise, others keep the preferred one."""
    packed = entities.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "confidence"))).alias("e"))
    kind = "struct<value:string,confidence:double,conflicts:int>"
    good = F.when(F.col("field").isin(*DATE_FIELDS), 1).when(F.col("field").isin(*CURRENCY_FIELDS), 2).otherwise(0)

    def valid(v: Column) -> Column:
        return F.coalesce(F.when(good == 1, is_iso_date(v)).when(good == 2, v.rlike(r"^-?\d+(\.\d+)?$")).otherwise(F.lit(True)), F.lit(False))

    def step(s: Column, e: Column) -> Column:
        same = s["value"].eqNullSafe(e["value"])
        has_s, has_e = ~blank(s["value"]), ~blank(e["value"])
        take = F.when(has_e & ~has_s, True).when(has_s & ~has_e, False).when(valid(e["value"]) & ~valid(s["value"]), True).when(valid(s["value"]) & ~valid(e["value"]), False).otherwise(e["confidence"] > s["confidence"])
        return F.struct(F.when(~same & take, e["value"]).otherwise(s["value"]).alias("value"), F.when(same, (s["confidence"] + e["confidence"]) / 2).when(take, e["confidence"]).otherwise(s["confidence"]).alias("confidence"), (s["conflicts"] + (~same).cast("int")).alias("conflicts")).cast(kind)

    first = F.struct(F.col("e")[0]["value"].alias("value"), F.col("e")[0]["confidence"].alias("confidence"), F.lit(0).alias("conflicts")).cast(kind)
    return packed.select("doc_id", "field", F.aggregate(F.slice("e", F.lit(2), F.size("e")), first, step).alias("m")).select("doc_id", "field", "m.*")


def validate(fields: DataFrame) -> DataFrame:
    """Adds valid and codes (the error codes) to (doc_id, field, value, …) rows."""
    pattern = F.create_map(*[F.lit(x) for kv in PATTERNS.items() for x in kv])
    rule = F.try_element_at(pattern, F.col("field"))
    v = F.col("value")
    codes = F.array_compact(F.array(
        F.when(blank(v), "missing_value"),
        F.when(~blank(v) & rule.isNotNull() & ~F.regexp_like(v, rule), "regex_validation_failed"),
        F.when(~blank(v) & F.col("field").isin(*DATE_FIELDS) & ~is_iso_date(v), "invalid_date"),
        F.when(~blank(v) & F.col("field").isin(*CURRENCY_FIELDS) & ~v.rlike(r"^-?\d+(\.\d+)?$"), "invalid_numeric"),
    ))
    return fields.withColumn("codes", codes).withColumn("valid", F.size("codes") == 0)


def confidence_policy(fields: DataFrame, threshold: float = MIN_CONFIDENCE, drop: bool = True) -> DataFrame:
    """Adds status: kept, retained (below the threshold, not valid) or dropped (also below max(0.35, threshold - 0.2)), and the message."""
    keep = max(0.35, round(threshold - 0.2, 6))
    c = F.col("confidence")
    status = F.when(c >= threshold, "kept").when(F.lit(drop) & (c < keep), "dropped").otherwise("retained")
    return fields.withColumn("status", status).withColumn("message", F.when(c < threshold, F.format_string("Field confidence %.6f is below threshold %.6f.", c, F.lit(threshold))))


def check_amounts(docs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds computed_total, flags, fixed_total and fixed_items to (doc_id, total_amount, line_items) rows.

    line_items has quantity, has_quantity and unit_price: an absent quantity counts as 1, a null one does
    not contribute. A missing total is filled; one missing quantity is derived if it is whole, 1 to 99.
    """
    items = F.col("line_items")

    def amount(x: Column) -> Column:
        return x["unit_price"] * F.when(x["has_quantity"], x["quantity"]).otherwise(F.lit(1.0))

    amounts = F.filter(F.transform(items, amount), lambda v: v.isNotNull())
    staged = docs.withColumn("__a", F.struct(F.aggregate(amounts, F.lit(0.0), lambda s, v: s + v).alias("sum"), F.size(amounts).alias("n"), F.filter(F.transform(items, lambda x, i: F.when(x["unit_price"].isNotNull() & x["quantity"].isNull(), i)), lambda i: i.isNotNull()).alias("open")))
    total, sum_, open_ = F.col("total_amount"), F.col("__a.sum"), F.col("__a.open")
    quiet = (F.col("__a.n") == 0) | (F.abs(sum_) <= tolerance)
    fill = ~quiet & total.isNull()
    off = ~quiet & total.isNotNull() & (F.abs(total - sum_) > tolerance)
    price = F.get(items, F.get(open_, 0))["unit_price"]
    guess = F.bround(F.try_divide(total - sum_, price))
    repair = off & (F.size(open_) == 1) & guess.between(1, 99) & (F.abs(sum_ + guess * price - total) <= tolerance)
    repair = F.coalesce(repair, F.lit(False))
    flags = F.array_compact(F.array(F.when(fill, "corrected_total_amount_from_line_items"), F.when(repair, "corrected_quantity_derived_from_total"), F.when(off & ~repair, "line_items_total_mismatch")))
    fixed = F.when(repair, F.transform(items, lambda x, i: F.when(i == F.get(open_, 0), x.withField("quantity", guess)).otherwise(x))).otherwise(items)
    return staged.select(*docs.columns, sum_.alias("computed_total"), flags.alias("flags"), F.when(fill, sum_).otherwise(total).alias("fixed_total"), fixed.alias("fixed_items"))


def required_flags(fields: DataFrame, today: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(doc_id, flags): missing required fields and dates after ``today``, as a sorted set."""
    got = fields.groupBy("doc_id").agg(F.collect_set(F.when(~blank(F.col("value")), F.col("field"))).alias("have"), F.collect_set(F.when(F.col("field").isin(*DATE_FIELDS) & (F.try_to_date("value", "yyyy-MM-dd") > F.lit(today).cast("date")), F.concat(F.lit("future_date:"), "field"))).alias("late"))
    need = F.array(*[F.lit(x) for x in required])
    return got.select("doc_id", F.array_sort(F.concat(F.transform(F.array_except(need, "have"), lambda x: F.concat(F.lit("missing_required_field:"), x)), "late")).alias("flags"))


def backfill(fields: DataFrame, names: tuple[str, ...] = ("invoice_number", "date", "vendor", "total_amount", "line_items")) -> DataFrame:
    """A row for every document and name; absent ones have a null value and confidence 0."""
    grid = fields.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("field"))
    return grid.join(fields.select("doc_id", "field", "value", "confidence"), ["doc_id", "field"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def first_value(c: Column) -> Column:
    return let(c, lambda x: F.when(~blank(x), x))
