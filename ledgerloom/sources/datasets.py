"""Labelled-word datasets as annotations: two layouts, told apart by their columns.

Files are read by Spark's own readers, so splits, column pruning and file systems are Spark's. A dataset has either a
column ``ground_truth`` with JSON of lines and their words, or columns ``words``, ``bboxes`` and ``ner_tags``.

Defined cases: blank words go with their box and label; a missing box is one of zeros; a tag beyond the names is
its own text; JSON that can't be read gives no words; a table with neither layout's columns is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.helpers import let, settled

LINES = "valid_line array<struct<category:string,words:array<struct<text:string,quad:map<string,int>,is_key:int>>>>"
WORD = "array<struct<text:string,box:array<int>,kind:string>>"


def bio(kinds: Column) -> Column:
    """BIO labels of the kinds KEY, VALUE and O: a key begins unless one stands before it, a value begins after an O or at the start."""
    before = lambda i: F.coalesce(F.get(kinds, i - 1), F.lit(""))
    key = lambda i: F.when(before(i) == "KEY", "I-KEY").otherwise("B-KEY")
    value = lambda i: F.when(before(i).isin("", "O"), "B-VALUE").otherwise("I-VALUE")
    return F.transform(kinds, lambda k, i: F.when(k == "KEY", key(i)).when(k == "VALUE", value(i)).otherwise("O"))


def of_category(c: Column) -> Column:
    """The kind of a word by its category's name; those that begin with an O are no value."""
    return F.when(F.coalesce(c, F.lit("")).rlike("^($|O)"), "O").otherwise("VALUE")


def json_words(ground_truth: Column) -> Column:
    """The words of a JSON layout, line by line; printed field names are keys."""
    lines = F.from_json(ground_truth, LINES)["valid_line"]
    corner = lambda q, axis: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.coalesce(F.try_element_at(q, F.concat(F.lit(axis), i.cast("string"))), F.lit(0)))
    box = lambda q: let(F.struct(corner(q, "x").alias("x"), corner(q, "y").alias("y")), lambda p: F.array(F.array_min(p["x"]), F.array_min(p["y"]), F.array_max(p["x"]), F.array_max(p["y"])))
    word = lambda line: lambda w: F.struct(F.trim(F.coalesce(w["text"], F.lit(""))).alias("text"), box(w["quad"]).alias("box"), F.when(F.coalesce(w["is_key"], F.lit(0)) != 0, "KEY").otherwise(of_category(line["category"])).alias("kind"))
    every = F.flatten(F.transform(lines, lambda x: F.transform(F.coalesce(x["words"], F.array().cast("array<struct<text:string,quad:map<string,int>,is_key:int>>")), word(x))))
    return F.coalesce(every, F.array()).cast(WORD)


def flat_words(words: Column, boxes: Column, tags: Column, names: list[str] | None, forms: bool) -> Column:
    """The words of the flat layout; tags are numbers or names. In forms questions are keys and answers values, in receipts every category is a value."""
    listed = F.array(*map(F.lit, names or [""]))
    name = lambda t: F.coalesce(F.when(t.rlike("^[0-9]{1,9}$"), F.get(listed, t.try_cast("int"))), t, F.lit("O")) if names else F.coalesce(t, F.lit("O"))
    kind = lambda t: F.when(t.rlike("^[BI]-QUESTION$"), "KEY").when(t.rlike("^[BI]-ANSWER$"), "VALUE").otherwise("O") if forms else of_category(t)
    zero = F.array(*[F.lit(0)] * 4)
    one = lambda z: F.struct(F.trim(F.coalesce(z["w"].cast("string"), F.lit(""))).alias("text"), F.when(F.size(z["b"]) > 0, z["b"]).otherwise(zero).alias("box"), kind(name(z["t"].cast("string"))).alias("kind"), name(z["t"].cast("string")).alias("tag"))
    size = F.least(F.size(words), F.size(boxes), F.size(tags))
    both = F.slice(F.arrays_zip(words.alias("w"), boxes.cast("array<array<int>>").alias("b"), tags.alias("t")), F.lit(1), size)
    return F.transform(both, one)


def examples(rows: DataFrame, names: list[str] | None = None, forms: bool = False) -> DataFrame:
    """Adds words, boxes and bio_labels, and leaves out the columns they are made of; the layout is told by the columns."""
    if "ground_truth" in rows.columns:
        made, gone = json_words(F.col("ground_truth")), ["ground_truth"]
    elif {"words", "bboxes", "ner_tags"} <= set(rows.columns):
        made, gone = flat_words(F.col("words"), F.col("bboxes"), F.col("ner_tags"), names, forms), ["words", "bboxes", "ner_tags"]
    else:
        raise ValueError("expected a column ground_truth, or words, bboxes and ner_tags")
    kept = settled(rows, {"__w": F.filter(made, lambda x: x["text"] != "")})
    # Forms carry their own B- and I-; receipts and JSON begin a span by the word before.
    if forms and "ground_truth" not in rows.columns:
        labels = F.transform("__w", lambda x: F.when(x["kind"] == "O", "O").otherwise(F.concat(F.substring(x["tag"], 1, 2), x["kind"])))
    else:
        labels = bio(F.transform("__w", lambda x: x["kind"]))
    out = kept.withColumns({"__words": F.transform("__w", lambda x: x["text"]), "boxes": F.transform("__w", lambda x: x["box"]), "bio_labels": labels})
    return out.drop("__w", *gone).withColumnRenamed("__words", "words")


def annotations(rows: DataFrame, source: str, split: str, names: list[str] | None = None, forms: bool = False) -> DataFrame:
    """(doc_id, ocr_text, ocr_tokens, bio_labels, metadata) of a dataset's rows with an id: what an annotation file holds, without its truth."""
    found = examples(rows, names, forms)
    token = F.transform(F.arrays_zip("words", "boxes"), lambda z: F.struct(z["words"].alias("text"), z["boxes"].alias("bbox"), F.lit(1.0).alias("confidence"), F.lit(1).alias("page_number")))
    text = F.array_join("words", " ")
    meta = F.struct(F.lit(source).alias("source_dataset"), F.lit(split).alias("source_split"), F.col("id").cast("string").alias("source_id"))
    return found.select(F.concat(F.lit(f"{source}_{split}_"), F.col("id").cast("string")).alias("doc_id"), text.alias("ocr_text"), token.alias("ocr_tokens"), "bio_labels", meta.alias("metadata"))


def read_dataset(spark: SparkSession, path: str, file_format: str = "parquet", schema: str | None = None) -> DataFrame:
    """A dataset's rows by Spark's reader; JSON lines need their schema, as inferring one reads every file."""
    if file_format == "json" and schema is None:
        raise ValueError("JSON lines need a schema")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(file_format).load(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A line of JSON for each row, nulls included."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
