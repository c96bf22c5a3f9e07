"""Turning form and receipt datasets into annotations: dates, amounts, vendors, ground truth; loaders' coercions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.helpers import let
from ..functions.scalars import dataset_amount, plausible_total

# Patterns and keywords of the datasets.
AMOUNT = r"(?<!\d)(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d{2})?(?!\d)"
DATES = (r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b")
NUMBER = r"(?i)(?:invoice|receipt|bill)\s*(?:no|number|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-\/]*)"
COMPANY = r"\b(ltd|limited|inc|incorporated|corp|corporation|gmbh|llc|co|company|associates|group|holdings)\b"
DATE_WORDS = ("date", "invoice date", "receipt date", "bill date")
VENDOR_WORDS = ("vendor", "seller", "supplier", "merchant", "store", "company", "from")
TOTAL_WORDS = ("total", "amount", "amount due", "grand total", "total due", "balance")
TOTAL_LABELS = ("I-total.total_price", "I-total.cashprice", "I-total.creditcardprice", "I-total.emoneyprice", "I-sub_total.subtotal_price")
ITEM_LABELS = {"description": ("I-menu.nm", "I-menu.sub_nm"), "quantity": ("I-menu.cnt", "I-menu.sub_cnt"), "unit_price": ("I-menu.unitprice", "I-menu.price", "I-menu.sub_price")}


def dataset_date(c: Column) -> Column:
    """Month-first date as ISO text by its numbers alone, no calendar; two-digit years are 20yy; what is no date stays."""

    def rule(t: Column) -> Column:
        parts = F.split(F.replace(t, F.lit("/"), F.lit("-")), "-")
        first = F.length(F.get(parts, 0)) == 4
        y, m, d = (F.when(first, F.get(parts, a)).otherwise(F.get(parts, b)) for a, b in ((0, 2), (1, 0), (2, 1)))
        y = F.when(~first & (F.length(y) == 2), F.concat(F.lit("20"), y)).otherwise(y)
        number = lambda x: F.when(x.rlike(r"^\s*[0-9]{1,9}\s*$"), F.trim(x).cast("int"))
        ok = (F.size(parts) == 3) & number(m).between(1, 12) & number(d).between(1, 31) & (number(y) > 0)
        return F.when(F.coalesce(ok, F.lit(False)), F.format_string("%04d-%02d-%02d", number(y), number(m), number(d))).otherwise(t)

    return let(F.trim(c), rule)


def is_iso(c: Column) -> Column:
    """A calendar date as yyyy-mm-dd or yyyymmdd."""
    return F.coalesce((c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()) | (c.rlike(r"^\d{8}$") & F.try_to_date(c, "yyyyMMdd").isNotNull()), F.lit(False))


def looks_like_vendor(c: Column) -> Column:
    """No digits, and a company word or several words in capitals."""
    t = F.trim(c)
    capitals = t.rlike(r"\s") & (t == F.upper(t)) & t.rlike("[A-Z]") & ~t.rlike(r"[^A-Za-z .&'\-]")
    return F.coalesce((t != "") & ~t.rlike(r"\d") & (F.lower(t).rlike(COMPANY) | capitals), F.lit(False))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def amounts_in(c: Column) -> Column:
    """All amounts of a text, commas dropped."""
    return F.transform(F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def first_plausible(c: Column) -> Column:
    return F.get(F.filter(amounts_in(c), plausible_total), 0)


def edge_amount(c: Column, last: bool) -> Column:
    return F.try_element_at(amounts_in(c), F.lit(-1 if last else 1))


def first_date(c: Column) -> Column:
    """The first date shape of a text, year first before others; empty without one."""
    return F.coalesce(*[dataset_date(F.nullif(F.regexp_extract(c, p, 0), F.lit(""))) for p in DATES], F.lit(""))


def first_number(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, NUMBER, 1))


def form_truth(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Ground truth of forms: doc_id, invoice_number (empty), date, vendor, total_amount from (doc_id, n, question, answer) pairs, else from the text."""
    low = F.lower("question")
    is_date, is_vendor, is_total = (contains_any(low, w) for w in (DATE_WORDS, VENDOR_WORDS, TOTAL_WORDS))
    amount = dataset_amount("answer")
    # A pair speaks for the first of date, vendor and total that is still open when its turn comes.
    date_at = F.min(F.when(is_date & (F.trim("answer") != ""), F.col("n")))
    vendor_at = F.min(F.when(is_vendor & looks_like_vendor(F.col("answer")), F.col("n")))
    places = pairs.groupBy("doc_id").agg(date_at.alias("date_at"), vendor_at.alias("vendor_at"))
    rows = pairs.join(places, "doc_id")
    taken = (is_date & (F.coalesce("date_at", F.lit(1 << 30)) >= F.col("n"))) | (is_vendor & (F.coalesce("vendor_at", F.lit(1 << 30)) >= F.col("n")))
    free_vendor = is_vendor & looks_like_vendor(F.col("answer")) & ~(is_date & (F.coalesce("date_at", F.lit(1 << 30)) >= F.col("n")))
    got = rows.groupBy("doc_id").agg(F.min_by(F.when(is_date, dataset_date(F.col("answer"))), F.when(F.col("n") == F.col("date_at"), F.col("n"))).alias("date"), F.min_by(F.trim("answer"), F.when(free_vendor, F.col("n"))).alias("vendor"), F.min_by(amount, F.when(is_total & ~taken & plausible_total(amount), F.col("n"))).alias("total"))
    out = docs.select("doc_id", "text").join(got, "doc_id", "left")
    date = F.coalesce(F.nullif(F.col("date"), F.lit("")), first_date(F.col("text")))
    return out.select("doc_id", F.lit("").alias("invoice_number"), F.when(is_iso(date), date).otherwise("").alias("date"), F.coalesce("vendor", F.lit("")).alias("vendor"), F.coalesce("total", first_plausible(F.col("text"))).alias("total_amount"))


def clean_form_truth(truth: DataFrame) -> DataFrame:
    """Ground truth of forms with implausible vendors, totals and dates removed, and changed for rows that differ."""
    date = dataset_date(F.col("date"))
    new = {"invoice_number": F.lit(""), "vendor": F.when(looks_like_vendor(F.col("vendor")), F.trim("vendor")).otherwise(""), "total_amount": F.when(plausible_total(F.col("total_amount")), F.col("total_amount")), "date": F.when(is_iso(date), date).otherwise("")}
    changed = F.lit(False)
    for name, c in new.items():
        changed = changed | ~c.eqNullSafe(F.col(name))
    return truth.withColumn("changed", changed).withColumns(new)


def receipt_totals(runs: DataFrame) -> DataFrame:
    """(doc_id, total): the first amount under the first label, in the order of ``TOTAL_LABELS``, that has one; runs are (doc_id, label, start, text)."""
    rank = F.array_position(F.array(*map(F.lit, TOTAL_LABELS)), F.col("label"))
    amount = dataset_amount("text")
    return runs.filter(F.col("label").isin(*TOTAL_LABELS) & amount.isNotNull()).groupBy("doc_id").agg(F.min_by(amount, F.struct(rank, "start")).alias("total"))


def receipt_items(runs: DataFrame) -> DataFrame:
    """(doc_id, n, description, quantity, unit_price): names, counts and prices side by side by their order; wholly empty ones go."""
    every = [x for labels in ITEM_LABELS.values() for x in labels]
    rank = F.array_position(F.array(*map(F.lit, every)), F.col("label"))
    listed = lambda labels: F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isin(*labels), F.struct(rank, "start", "text")))), lambda x: x["text"])
    packed = runs.filter(F.col("label").isin(*every)).groupBy("doc_id").agg(*[listed(labels).alias(k) for k, labels in ITEM_LABELS.items()])
    rows = packed.select("doc_id", F.posexplode(F.arrays_zip("description", "quantity", "unit_price")).alias("n", "z"))
    out = rows.select("doc_id", "n", F.coalesce(F.trim("z.description"), F.lit("")).alias("description"), dataset_amount("z.quantity").alias("quantity"), dataset_amount("z.unit_price").alias("unit_price"))
    return out.filter("description <> '' or quantity is not null or unit_price is not null")


# ---------------------------------------------------------------- loaders
def validation_rows(rows: DataFrame) -> DataFrame:
    """doc_id, words, boxes and labels under any of their usual names; rows without words go."""
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rows.columns])
    out = rows.select("doc_id", "words", pick("bboxes", "boxes").alias("boxes"), pick("ner_tags", "labels", "bio_labels").alias("labels"))
    return out.filter(F.size("words") > 0)


def rebase_path(path: Column, root: str, markers: tuple[str, ...] = ("data",)) -> Column:
    """The part of a path from the last folder named as a marker on, under ``root``; other relative paths go under it whole, absolute ones stay."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    tail = F.regexp_extract(clean, rf"^(?:.*/)?((?:{'|'.join(markers)})/.*)$", 1)
    return F.when(tail != "", F.concat(F.lit(root.rstrip("/") + "/"), tail)).when(clean.startswith("/"), clean).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), clean))


def ocr_metadata(meta: Column, tokens: Column) -> Column:
    """Defaults of a document's recognition metadata; counts come from the tokens where they are missing."""
    pages = F.size(F.array_distinct(F.transform(tokens, lambda t: F.coalesce(t["page_number"], F.lit(1)))))
    text = lambda name, default: F.coalesce(F.nullif(meta[name], F.lit("")), F.lit(default)).alias(name)
    return F.struct(text("source", "dataset"), text("engine", "unknown"), text("language", "en"), F.coalesce(meta["page_count"], F.greatest(F.lit(1), pages)).alias("page_count"), F.coalesce(meta["token_count"], F.size(tokens)).alias("token_count"), F.coalesce(meta["reused_cached_ocr"], F.lit(False)).alias("reused_cached_ocr"))


def prepared(docs: DataFrame, extract: Callable[[DataFrame], DataFrame], force: bool = False, tokens: str = "ocr_tokens") -> DataFrame:
    """Documents with their tokens: those that have some pass through, the others (or all) go to ``extract``; reused_cached_ocr tells which."""
    has = F.coalesce(F.size(tokens) > 0, F.lit(False)) & F.lit(not force)
    kept = docs.filter(has).withColumn("reused_cached_ocr", F.lit(True))
    return kept.unionByName(extract(docs.filter(~has)).withColumn("reused_cached_ocr", F.lit(False)))


def token_defaults(tokens: Column) -> Column:
    """Page 1 and confidence 1 where they are missing."""
    return F.transform(tokens, lambda t: t.withField("page_number", F.coalesce(t["page_number"], F.lit(1))).withField("confidence", F.coalesce(t["confidence"], F.lit(1.0))))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of several annotation tables; columns that one lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def in_dataset_order(results: DataFrame, dataset: DataFrame, order: str) -> DataFrame:
    """Results of documents in the dataset, in its order."""
    return results.join(dataset.select("doc_id", F.col(order).alias("__order")), "doc_id").orderBy("__order").drop("__order")


def parse_number(c: Column, locale: str = "id") -> Column:
    """A number under a locale's separators: id has points for thousands, en commas, auto decides by the text."""
    digits = F.regexp_replace(c, r"[^0-9,.\-]", "")
    number = lambda t: F.when(t.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))
    drop = lambda t, mark: F.replace(t, F.lit(mark), F.lit(""))
    if locale == "id":
        return let(digits, lambda t: number(F.replace(drop(t, "."), F.lit(","), F.lit("."))))
    if locale == "en":
        return let(digits, lambda t: number(drop(t, ",")))

    def single(t: Column, mark: str) -> Column:
        m = "\\" + mark
        several = t.rlike(rf"{m}.*{m}")
        joined = F.regexp_replace(t, rf"{m}(?=.*{m})", "")
        return F.when(~t.rlike(rf"^-*[^{m}]{{1,3}}{m}"), t).when(t.rlike(rf"^-*[^{m}]{{1,3}}({m}\d{{3}})+$"), drop(t, mark)).when(several, F.replace(F.regexp_replace(joined, "^-+", ""), F.lit(mark), F.lit("."))).otherwise(F.replace(t, F.lit(mark), F.lit(".")))

    def auto(t: Column) -> Column:
        comma, point = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
        both = F.when(t.rlike(r",[^.]*$"), F.replace(drop(t, "."), F.lit(","), F.lit("."))).otherwise(drop(t, ","))
        return F.when(comma & point, both).when(point, single(t, ".")).when(comma, single(t, ",")).otherwise(t)

    return let(let(digits, auto), number)
