"""Labels of tokens: coercion, word and subword alignment, alias matching, spans and their grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ALIASES

# The labels in the order of their ids.
LABELS = ("O", "B-KEY", "I-KEY", "B-VALUE", "I-VALUE")


def label_of(tag: Column) -> Column:
    """The label of an id or name written as text; others, and booleans, are O."""
    names = F.array(*[F.lit(x) for x in LABELS])
    return F.when(tag.rlike("^[0-9]{1,9}$"), F.coalesce(F.get(names, tag.try_cast("int")), F.lit("O"))).when(tag.isin(*LABELS), tag).otherwise("O")


def name_of(tag: Column, names: list[str]) -> Column:
    """The dataset's name of a tag id; a text that is no id stays."""
    return F.coalesce(F.when(tag.rlike("^[0-9]{1,9}$"), F.get(F.array(*[F.lit(x) for x in names]), tag.try_cast("int"))), tag)


def value_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds bio: a category that is no O begins a value where the token before is O, else goes on with it."""
    outside = F.col(label).startswith("O")
    before = F.lag(outside).over(W.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("bio", F.when(outside, "O").when(F.coalesce(before, F.lit(True)), "B-VALUE").otherwise("I-VALUE"))


def form_label(tag: Column) -> Column:
    """Question and answer tags as key and value labels; others are O."""
    base = F.regexp_extract(tag, "^[BI]-(QUESTION|ANSWER)$", 1)
    return F.when(base == "", "O").otherwise(F.concat(F.substring(tag, 1, 2), F.when(base == "QUESTION", "KEY").otherwise("VALUE")))


def subword_labels(subwords: DataFrame, ignore: int = -100) -> DataFrame:
    """Adds label_id to (doc_id, tok, word_id, label) rows: ``ignore`` without word or label, later subwords of a word continue its label."""
    inner = F.when(F.lag("word_id").over(W.partitionBy("doc_id").orderBy("tok")) == F.col("word_id"), F.regexp_replace("label", "^B-", "I-")).otherwise(F.col("label"))
    ids = F.create_map(*[F.lit(x) for i, name in enumerate(LABELS) for x in (name, i)])
    return subwords.withColumn("label_id", F.when(F.col("word_id").isNull() | F.col("label").isNull(), ignore).otherwise(F.coalesce(F.try_element_at(ids, inner), F.lit(0))))


def first_subwords(subwords: DataFrame) -> DataFrame:
    """The first subword's row of each word; rows without word go."""
    first = F.row_number().over(W.partitionBy("doc_id", "word_id").orderBy("tok"))
    return subwords.filter("word_id is not null").withColumn("__n", first).filter("__n = 1").drop("__n")


def confident_labels(rows: DataFrame, threshold: float) -> DataFrame:
    """Labels under the confidence turn to O."""
    return rows.withColumn("label", F.when(F.col("confidence") < threshold, "O").otherwise(F.col("label")))


def match_key(c: Column) -> Column:
    """Lower case, letters, digits and # only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9#]+", "")


def alias_labels(tokens: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """(doc_id, pos, text, confidence, label) of (doc_id, pos, text, confidence) tokens by field aliases.

    From left to right the longest alias that starts at a token is a key, and the search goes on behind it. What
    stands between a key and the next is its value, from the first token that is neither blank nor a colon on;
    blank tokens inside stay O. A fold finds the keys, since a key's tokens can't begin another; it keeps only
    the place where the last key ends, and the labels are read off windows.
    """
    w = W.partitionBy("doc_id").orderBy("pos")
    by_size = sorted({a: a.split(" ") for a in aliases}.values(), key=len, reverse=True)
    longest = max(map(len, by_size))
    t = tokens.select("doc_id", "pos", "text", "confidence", match_key(F.col("text")).alias("k"))
    t = t.withColumn("n", F.row_number().over(w) - 1).select("*", *[F.lead("k", i).over(w).alias(f"k{i}") for i in range(1, longest)])
    reads = lambda parts: F.lit(True) if not parts else reduce(lambda a, b: a & b, [F.coalesce(F.col("k" if i == 0 else f"k{i}") == p, F.lit(False)) for i, p in enumerate(parts)])
    size = F.lit(0)
    for parts in reversed(by_size):
        size = F.when(reads(parts), len(parts)).otherwise(size)
    t = t.withColumn("size", size).drop(*[f"k{i}" for i in range(1, longest)])
    # Only candidates are gathered; a document has few beside its tokens.
    starts = t.filter("size > 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "size"))).alias("c"))
    kind = "struct<end:int,keys:array<struct<n:int,size:int>>>"
    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<n:int,size:int>>").alias("keys")).cast(kind)
    fold = F.aggregate("c", first, lambda s, x: F.when(x["n"] < s["end"], s).otherwise(F.struct((x["n"] + x["size"]).alias("end"), F.array_append(s["keys"], x).alias("keys")).cast(kind)))
    keys = starts.select("doc_id", F.explode(fold["keys"]).alias("x")).select("doc_id", F.col("x.n").alias("n"), F.col("x.size").alias("key_size"))
    t = t.drop("size").join(keys, ["doc_id", "n"], "left")
    key_at, key_len = F.last(F.when(F.col("key_size").isNotNull(), F.col("n")), True).over(w), F.last("key_size", True).over(w)
    t = t.withColumns({"key_at": key_at, "key_len": key_len})
    inside = F.col("n") < F.col("key_at") + F.col("key_len")
    # The value begins at the first token behind the key that says something.
    says = ~inside & (F.col("k") != "")
    said = F.sum(F.when(says, 1).otherwise(0)).over(W.partitionBy("doc_id", "key_at").orderBy("pos"))
    label = F.when(F.col("key_at").isNull(), "O").when(F.col("n") == F.col("key_at"), "B-KEY").when(inside, "I-KEY").when(~says, "O").when(said == 1, "B-VALUE").otherwise("I-VALUE")
    return t.select("doc_id", "pos", "text", "confidence", label.alias("label"))


def alias_pairs(tokens: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """(doc_id, field, value, confidence): a token that is an alias makes the next one the field's value; the last of a field wins.

    A value that is an alias itself is no key: within a run of aliases every second one is. A document's tokens are
    packed once, so they are dealt out and sorted a single time.
    """
    from . import benchmarks, packed

    rows = packed.pack(tokens.select("doc_id", "pos", "text", "confidence"))
    return rows.select("doc_id", F.inline(benchmarks.last_of_each(benchmarks.alias_pairs(F.col("t"), aliases)))).withColumnRenamed("text", "value")


def tagged_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, label, start, end, text) of runs of equal tags (doc_id, pos, word, tag); O is no run."""
    w = W.partitionBy("doc_id").orderBy("pos")
    new = F.when(F.lag("tag").over(w).eqNullSafe(F.col("tag")), 0).otherwise(1)
    return _runs(rows.withColumn("__new", new).withColumn("label", F.col("tag")), w)


def bio_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, label, start, end, text) of B- and I- tags: a B-, another type or an O before begins a run."""
    w = W.partitionBy("doc_id").orderBy("pos")
    base = F.regexp_replace("tag", "^[^-]*-", "")
    rows = rows.withColumn("label", F.when(F.col("tag") == "O", "O").otherwise(base))
    goes_on = (F.lag("label").over(w) == F.col("label")) & ~F.col("tag").startswith("B-")
    return _runs(rows.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)), w)


def _runs(rows: DataFrame, w) -> DataFrame:
    numbered = rows.withColumn("__run", F.sum("__new").over(w)).filter(F.col("tag") != "O")
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " "))
    return numbered.groupBy("doc_id", "__run", "label").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), text.alias("text")).drop("__run")


def pair_nearest(spans: DataFrame) -> DataFrame:
    """(doc_id, question, answer): questions in order take the nearest unused answer, by start less question's end, then by start.

    A fold over a document's questions, since an answer can be taken once.
    """
    packed = spans.filter("text <> ''").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("label") == "QUESTION", F.struct("start", "end", "text")))).alias("q"),
        F.array_sort(F.collect_list(F.when(F.col("label") == "ANSWER", F.struct("start", "end", "text")))).alias("a"),
    )
    kind = "struct<used:array<int>,out:array<struct<question:string,answer:string>>>"
    first = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<question:string,answer:string>>").alias("out")).cast(kind)

    def step(s: Column, q: Column) -> Column:
        free = F.filter("a", lambda a: ~F.array_contains(s["used"], a["start"]))
        best = F.array_min(F.transform(free, lambda a: F.struct(F.abs(a["start"] - q["end"]).alias("d"), a["start"].alias("start"), a["text"].alias("text"))))
        return F.when(best.isNull(), s).otherwise(F.struct(F.array_append(s["used"], best["start"]).alias("used"), F.array_append(s["out"], F.struct(q["text"].alias("question"), best["text"].alias("answer"))).alias("out")).cast(kind))

    return packed.select("doc_id", F.inline(F.aggregate("q", first, step)["out"]))
