"""Annotation files, uploads and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, image_path string, ocr_text string, ocr_tokens array<struct<text:string,bbox:array<int>,confidence:double,page_number:int>>, ground_truth struct<invoice_number:string,date:string,vendor:string,total_amount:double,line_items:array<struct<description:string,quantity:double,unit_price:double>>>"

# Accepted extensions and their leading bytes.
MAGIC = {"pdf": "25504446", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF"}


def read_annotations(spark: SparkSession, path: str, form: str = "jsonl") -> DataFrame:
    """JSON lines, a JSON array ('array'), or an object with samples ('samples'), under one fixed schema."""
    if form == "samples":
        return spark.read.schema(f"samples array<struct<{SCHEMA.replace(' string', ':string').replace(' array', ':array').replace(' struct', ':struct')}>>").json(path, multiLine=True).selectExpr("inline(samples)")
    return spark.read.schema(SCHEMA).json(path, multiLine=form == "array")


def coerce_documents(rows: DataFrame) -> DataFrame:
    """Text from tokens, and an id from the image's stem, else the text's first 24 characters, else 'document'."""
    text = F.coalesce(F.nullif(F.trim("ocr_text"), F.lit("")), F.array_join(F.filter(F.transform("ocr_tokens", lambda t: t["text"]), lambda x: x.isNotNull() & (x != "")), "\n"), F.lit(""))
    rows = rows.withColumn("ocr_text", text)
    stem = F.nullif(F.regexp_extract("image_path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1), F.lit(""))
    return rows.withColumn("doc_id", F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), stem, F.nullif(F.replace(F.substring("ocr_text", 1, 24), F.lit(" "), F.lit("_")), F.lit("")), F.lit("document")))


def clean_items(items: Column) -> Column:
    """Zero prices become null, empty items go, and a quantity alone joins the item before it at the same price or without one."""
    kind = "array<struct<description:string,quantity:double,unit_price:double>>"
    ready = F.filter(F.transform(items, lambda x: F.struct(F.nullif(F.trim(x["description"]), F.lit("")).alias("description"), x["quantity"].cast("double").alias("quantity"), F.nullif(x["unit_price"].cast("double"), F.lit(0.0)).alias("unit_price"))), lambda x: x["description"].isNotNull() | x["quantity"].isNotNull() | x["unit_price"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fold = x["description"].isNull() & x["quantity"].isNotNull() & (F.size(acc) > 0) & last["quantity"].isNull() & (x["unit_price"].isNull() | last["unit_price"].eqNullSafe(x["unit_price"]))
        return F.when(fold, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), last.withField("quantity", x["quantity"]))).otherwise(F.array_append(acc, x)).cast(kind)

    return F.aggregate(ready, F.array().cast(kind), step)


def sanitize_filename(c: Column) -> Column:
    """Base name with other characters than letters, digits, point, line and underscore replaced, at most 128."""
    base = F.regexp_extract(c, r"([^/\\]*)$", 1)
    return F.substring(F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_"), r"^[._]+|[._]+$", ""), 1, 128)


def validate_uploads(files: DataFrame, max_bytes: int = 10_485_760) -> DataFrame:
    """Adds extension, sha256 and error (null if accepted) to (path, length, content) rows of the binaryFile source."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    magic = F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv])
    want = F.try_element_at(magic, ext)
    head = F.substring(F.hex("content"), F.lit(1), F.length(want))
    error = F.when(want.isNull(), "unsupported_extension").when(F.col("length") == 0, "empty_file").when(F.col("length") > max_bytes, "too_large").when(head != want, "content_mismatch")
    return files.select("path", ext.alias("extension"), "length", F.sha2("content", 256).alias("sha256"), sanitize_filename(F.col("path")).alias("safe_name"), error.alias("error"))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("system").parquet(path)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(summary: DataFrame, most: int = 1000) -> str:
    """A small summary as a Markdown table, a row a system; more than ``most`` rows are an error."""
    rows = summary.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    head = "| " + " | ".join(summary.columns) + " |\n|" + "---|" * len(summary.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)])
