"""The deterministic stand-in for a language model: patterns over text, and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field patterns of the offline extractor.
PATTERNS = {
    "invoice_number": r"(?i)(?:invoice(?:\s+(?:number|no))?|receipt)\s*#?\s*[:\-]?\s*([A-Za-z0-9/_-]+)",
    "date": r"\b(\d{4}-\d{2}-\d{2})\b",
    "vendor": r"(?i)vendor\s*[:\-]?\s*(.+)",
    "total_amount": r"(?i)(?:total(?:\s+amount)?|amount\s+due)\s*[:\-]?\s*\$?\s*([0-9]+(?:\.[0-9]{1,2})?)",
}
ITEM = r"(?i)item\s*[:\-]?\s*([^,]+),\s*qty\s*[:\-]?\s*([0-9]+(?:\.[0-9]+)?),\s*price\s*[:\-]?\s*\$?\s*([0-9]+(?:\.[0-9]{1,2})?)"


def extract_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the four scalar fields (null if absent) and line_items, one for each line that reads as an item."""
    lines = F.filter(F.transform(F.split(F.col(text), r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    joined = F.array_join(lines, "\n")
    cols = {k: F.nullif(F.trim(F.regexp_extract(joined, p, 1)), F.lit("")) for k, p in PATTERNS.items()}
    cols["total_amount"] = cols["total_amount"].cast("double")
    part = lambda x, i: F.regexp_extract(x, ITEM, i)
    items = F.transform(F.filter(lines, lambda x: x.rlike(ITEM)), lambda x: F.struct(F.trim(part(x, 1)).alias("description"), part(x, 2).cast("double").alias("quantity"), part(x, 3).cast("double").alias("unit_price")))
    return docs.select("doc_id", *[c.alias(k) for k, c in cols.items()], F.coalesce(items, F.array().cast("array<struct<description:string,quantity:double,unit_price:double>>")).alias("line_items"))


def prompts(docs: DataFrame, field: str, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.format_string("Extract the field '%s' from the document below. Reply with JSON.\n\n%s", F.lit(field), F.col(text)).alias("prompt"))
