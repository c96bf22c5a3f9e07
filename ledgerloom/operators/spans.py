"""Label spans and key-value pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bio_spans(tokens: DataFrame) -> DataFrame:
    """(doc_id, span_no, type, category, start, end, text, confidence) of labelled tokens (doc_id, pos, text, label, category, confidence).

    A fold, because an uncategorized I- can extend a categorized span: a token continues a span of its
    type if its category is empty and its prefix is I, or equals the span's first category.
    """
    label = F.upper("label")
    clean = tokens.filter(F.trim("text") != "").select("doc_id", "pos", "text", F.coalesce("category", F.lit("")).alias("cat"), "confidence", F.regexp_extract(label, "^([BI])-(KEY|VALUE)$", 1).alias("p"), F.regexp_extract(label, "^([BI])-(KEY|VALUE)$", 2).alias("type"))
    packed = clean.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "cat", "confidence", "p", "type"))).alias("t"))
    state = "struct<span:int,open:boolean,type:string,cat:string,out:array<int>>"
    start = F.struct(F.lit(-1).alias("span"), F.lit(False).alias("open"), F.lit("").alias("type"), F.lit("").alias("cat"), F.array().cast("array<int>").alias("out")).cast(state)

    def step(s: Column, t: Column) -> Column:
        inside = t["type"] != ""
        goes_on = s["open"] & (s["type"] == t["type"]) & F.when(t["cat"] != "", t["cat"] == s["cat"]).otherwise(t["p"] == "I")
        span = F.when(inside & ~goes_on, s["span"] + 1).otherwise(s["span"])
        return F.struct(span.alias("span"), inside.alias("open"), t["type"].alias("type"), F.when(goes_on, s["cat"]).otherwise(t["cat"]).alias("cat"), F.array_append(s["out"], F.when(inside, span).otherwise(F.lit(-1))).alias("out")).cast(state)

    rows = packed.select("doc_id", F.explode(F.arrays_zip("t", F.aggregate("t", start, step)["out"].alias("span_no"))).alias("z")).select("doc_id", F.col("z.span_no").alias("span_no"), "z.t.*").filter("span_no >= 0")
    grouped = rows.groupBy("doc_id", "span_no").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "cat"))).alias("m"), F.first("type").alias("type"), F.avg("confidence").alias("confidence"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    return grouped.select("doc_id", "span_no", "type", F.col("m")[0]["cat"].alias("category"), "start", "end", F.array_join(F.transform("m", lambda x: x["text"]), " ").alias("text"), "confidence")


def pair_spans(spans: DataFrame) -> DataFrame:
    """A KEY with the VALUE right after it is a pair; other keys miss a value, other values are orphans."""
    w = W.partitionBy("doc_id").orderBy("span_no")
    seen = spans.select("*", F.lead("type").over(w).alias("next_type"), F.lead("text").over(w).alias("next_text"), F.lead("confidence").over(w).alias("next_conf"), F.lag("type").over(w).alias("last_type"))
    paired = (F.col("type") == "KEY") & (F.coalesce("next_type", F.lit("")) == "VALUE")
    status = F.when(paired, "paired").when(F.col("type") == "KEY", "missing_value").when(F.coalesce("last_type", F.lit("")) != "KEY", "orphan_value")
    return seen.select("doc_id", "span_no", status.alias("status"), F.when(F.col("type") == "KEY", F.col("text")).alias("key"), F.when(paired, F.col("next_text")).when(F.col("type") == "VALUE", F.col("text")).alias("value"), F.when(paired, (F.col("confidence") + F.col("next_conf")) / 2).otherwise(F.col("confidence")).alias("confidence")).filter("status is not null")
