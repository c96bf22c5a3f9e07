"""Baselines, ablations and confidence thresholds of the parsing chain as one plan.

Samples are rows (doc_id, t, truth): packed tokens and a payload of the true fields; ``gold``, labels beside t,
is optional. A system is a way through the same stages: which tokens it sees (as they are, without boxes,
degraded), whether it is labelled, and whether its entities are checked. A document's systems stand in rows of
their own from labelling to scoring, so tokens are read once, every stage is one expression for all systems, and
the only exchange is the one that adds the scores up.

Defined cases: a document without tokens has no fields, and required ones are missing; of raw entities and of
pairs the last of a field counts; a truth that is no object has no fields; two systems of one name add up.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions.helpers import let, scan, settled
from ..functions.scalars import ALIASES
from ..session import ship
from . import chain, packed, payloads
from . import fields as rules
from .evaluation import precision_recall, stringify_items

# Confidences at which checked fields are kept, and how many examples of an error are shown.
THRESHOLDS, EXAMPLES = (0.50, 0.60, 0.75, 0.90), 5
#: name: (tokens, labelled, checked).
SYSTEMS = {"ocr_only": ("plain", False, False), "text_only": ("flat", True, True), "no_postprocessing": ("plain", True, False), "full": ("plain", True, True), "degraded": ("degraded", True, True)}
#: The studies' names for what a system shows.
BASELINES = {"ocr_only": "ocr_only", "text_only": "text_only", "no_postprocessing": "no_postprocessing", "full": "full"}
ABLATIONS = {"remove_layout": "text_only", "remove_postprocessing": "no_postprocessing", "reduce_ocr_quality": "degraded"}
PAIR = "struct<field:string,text:string,confidence:double>"


def declared_ablations(spark) -> DataFrame:
    """The declared runs with their four switches. Fixed values."""
    rows = [("without_preprocessing", "Disable image normalization before OCR.", False, True, True, True), ("without_layoutlmv3", "Use OCR-only baseline without multimodal classification.", True, True, False, True), ("without_constraints", "Disable deterministic validation and constraint checks.", True, True, True, False)]
    return spark.createDataFrame(rows, "name string, description string, preprocessing boolean, ocr boolean, layoutlmv3 boolean, constraints boolean")


# ---------------------------------------------------------------- tokens and labels of the systems
def flat(t: Column) -> Column:
    """Tokens without layout: all boxes at the origin."""
    return F.transform(t, lambda x: x.withField("x0", F.lit(0)).withField("y0", F.lit(0)))


def degraded(t: Column) -> Column:
    """Confidence 0.25 lower, at least 0; every fourth token, from the first, without its last character."""

    def one(x: Column, i: Column) -> Column:
        short = F.substring(x["text"], F.lit(1), F.greatest(F.length(x["text"]) - 1, F.lit(0)))
        return x.withField("text", F.when(i % 4 == 0, short).otherwise(x["text"])).withField("confidence", F.greatest(F.lit(0.0), x["confidence"].cast("double") - 0.25))

    return F.transform(t, one)


def noisy(t: Column, doc_id: Column, factor: Column) -> Column:
    """Tokens of which a share ``factor`` is misread: their vowels are gone, or else the last character is a #, and the confidence is 0.3 lower.

    Which ones follows from a hash of document, place and factor, so every run and partitioning misreads the same.
    """

    def one(x: Column, i: Column) -> Column:
        seed = F.concat_ws("::", doc_id.cast("string"), i.cast("string"), factor.cast("string"))
        hit = F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("long") % 1_000_000 < factor * 1_000_000
        bare = F.regexp_replace(x["text"], "[aeiouAEIOU]", "")
        wrong = F.when(x["text"] == "", "").when((bare != "") & (bare != x["text"]), bare).otherwise(F.concat(F.substring(x["text"], F.lit(1), F.length(x["text"]) - 1), F.lit("#")))
        low = F.greatest(F.lit(0.0), x["confidence"].cast("double") - 0.3)
        return x.withField("text", F.when(hit, wrong).otherwise(x["text"])).withField("confidence", F.when(hit, low).otherwise(x["confidence"].cast("double")))

    return F.transform(t, one)


def with_noise(samples: DataFrame, factors: list[float]) -> DataFrame:
    """A row for each sample and factor; doc_id is a struct of both from here on."""
    grid = F.array(*[F.struct(F.lit(float(f)).alias("factor")) for f in factors])
    rows = samples.select("*", F.inline(grid))
    return settled(rows, {"t": noisy(F.col("t"), F.col("doc_id"), F.col("factor")), "doc_id": F.struct("factor", "doc_id")}).drop("factor")


def noise_sweep(samples: DataFrame, factors: list[float], today: str, aliases: dict[str, str] = ALIASES, labeler: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(variant, factor, n_docs, field_f1, exact_match): the means of all variants at each share of noise, from one reading of the tokens."""
    scored = run(with_noise(samples, factors), today, aliases, labeler)
    f1 = F.when(F.col("n_pred") + F.col("n_true") > 0, 2.0 * F.col("tp") / (F.col("n_pred") + F.col("n_true"))).otherwise(1.0)
    return scored.groupBy("variant", F.col("doc_id.factor").alias("factor")).agg(F.count("*").alias("n_docs"), F.avg(f1).alias("field_f1"), F.avg(F.col("exact").cast("int")).alias("exact_match"))


def systems(samples: DataFrame, labeler: Callable[[DataFrame], DataFrame] | None, names: dict[str, tuple[str, bool, bool]] = SYSTEMS) -> DataFrame:
    """A row for each sample and system, with its tokens and labels. ``labeler`` adds labels to rows with tokens t; without one labels are null where a system has some."""
    make = {"plain": lambda t: t, "flat": flat, "degraded": degraded}
    rows = samples.withColumnRenamed("t", "__t")
    for kind in sorted({k for k, labelled, _ in names.values() if labelled}):
        made = settled(rows, {"t": make[kind](F.col("__t"))})
        made = labeler(made) if labeler else made.withColumn("labels", F.lit(None).cast("array<string>"))
        rows = made.withColumnRenamed("t", f"__t_{kind}").withColumnRenamed("labels", f"__l_{kind}")

    def of(name: str, kind: str, labelled: bool, checked: bool) -> Column:
        t = F.col(f"__t_{kind}") if labelled else make[kind](F.col("__t"))
        labels = F.col(f"__l_{kind}") if labelled else F.transform(t, lambda x: F.lit("O"))
        return F.struct(F.lit(name).alias("system"), t.alias("t"), labels.alias("labels"), F.lit(checked).alias("checked"))

    kept = [c for c in samples.columns if c != "t"]
    return rows.select(*kept, F.inline(F.array(*[of(n, *spec) for n, spec in names.items()])))


def alias_pairs(t: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """ARRAY<field, text, confidence>: a token that is an alias makes the next one the field's value."""
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    state = f"struct<waits:string,out:{PAIR}>"
    nothing = F.lit(None).cast(PAIR)

    def step(s: Column, x: Column) -> Column:
        text = F.trim(x["text"])
        key = F.try_element_at(names, F.rtrim(F.lower(text), F.lit(":")))
        pair = F.struct(s["waits"].alias("field"), text.alias("text"), x["confidence"].cast("double").alias("confidence")).cast(PAIR)
        to = lambda waits, out: F.struct(waits.alias("waits"), out.alias("out")).cast(state)
        none = F.lit(None).cast("string")
        return F.when(F.coalesce(text, F.lit("")) == "", to(s["waits"], nothing)).when(s["waits"].isNotNull(), to(none, pair)).otherwise(to(key, nothing))

    return F.filter(scan(t, F.struct(F.lit(None).cast("string").alias("waits"), nothing.alias("out")), step, state, lambda s: s["out"], PAIR), lambda x: x.isNotNull())


def last_of_each(pairs: Column) -> Column:
    """The last pair of each field, in order of the fields' first."""
    return F.transform(F.array_distinct(F.transform(pairs, lambda x: x["field"])), lambda f: F.try_element_at(F.filter(pairs, lambda x: x["field"] == f), F.lit(-1)))


def outputs(rows: DataFrame, today: str, aliases: dict[str, str] = ALIASES, with_recovery: bool = False) -> DataFrame:
    """Adds raw (the entities as they are grouped) and output (field, text, confidence) to each system's row."""
    rows = packed.entities(packed.spans(rows), aliases).withColumn("raw", F.col("entities"))
    rows = packed.recover(rows, aliases) if with_recovery else rows
    rows = packed.check(settled(rows, {"entities": F.when(F.col("checked"), F.col("entities")).otherwise(F.slice("entities", 1, 0))}), today)
    there = F.filter("fields", lambda r: r["status"].isin("kept", "retained"))
    done = F.transform(there, lambda r: F.struct(r["field"].alias("field"), F.when(r["items"].isNotNull(), stringify_items(r["items"])).otherwise(r["value"]).alias("text"), r["confidence"].alias("confidence")).cast(PAIR))
    plain = F.transform("raw", lambda e: F.struct(e["field"].alias("field"), e["value"].alias("text"), e["confidence"].alias("confidence")).cast(PAIR))
    made = F.when(F.col("checked"), done).when(F.col("system") == "ocr_only", last_of_each(alias_pairs(F.col("t"), aliases))).otherwise(last_of_each(plain))
    return settled(rows, {"output": made}).drop("entities", "fields", "flags", "orphans", "spans", "checked")


def shown(rows: DataFrame, today: str, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """``outputs`` without recovery, by ``chain`` in Python, with n_tokens in place of the tokens; null labels are made by aliases."""
    ship(rows.sparkSession)
    carried = [c for c in rows.columns if c not in ("t", "labels", "checked")]
    kind = StructType([rows.schema[n] for n in carried] + StructType.fromDDL(f"n_tokens int, labels array<string>, raw array<{PAIR}>, output array<{PAIR}>").fields)
    settings = (today, aliases, rules.MIN_CONFIDENCE, True, False, True, True)
    return rows.mapInArrow(chain.apply_systems(lambda: chain.Chain(*settings), carried), kind)


# ---------------------------------------------------------------- scores
@F.arrow_udf(ArrayType(DoubleType()))
def _ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp similarity of each two texts of two lists."""
    from difflib import SequenceMatcher

    rows = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([[SequenceMatcher(None, x, y).ratio() for x, y in zip(p, q, strict=True)] for p, q in rows], pa.list_(pa.float64()))


def label_spans(labels: Column) -> Column:
    """ARRAY<type, start, end> of B- and I- labels: a B-, another type or an O before begins a span."""
    kind = lambda x: F.when(F.contains(x, F.lit("-")), F.regexp_replace(x, "^[^-]*-", "")).otherwise("")
    goes_on = lambda x, i: (x != "O") & ~x.startswith("B-") & F.coalesce(kind(F.get(labels, i - 1)) == kind(x), F.lit(False))
    bounds = F.filter(F.transform(labels, lambda x, i: F.when(~goes_on(x, i), i)), lambda i: i.isNotNull())
    each = lambda b: F.transform(b, lambda s, j: F.when(F.get(labels, s) != "O", F.struct(kind(F.get(labels, s)).alias("type"), s.alias("start"), F.coalesce(F.get(b, j + 1), F.size(labels)).alias("end"))))
    return F.filter(let(bounds, each), lambda x: x.isNotNull())


def scores(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, names: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each document and variant: sums of its fields, entities and labels, and whether all its fields are right; rows have the true fields in ``true``.

    ``names`` gives the variants that show a system; the thresholds are variants of the full one.
    """
    names = names or {s: [n for n, x in {**BASELINES, **ABLATIONS}.items() if x == s] for s in SYSTEMS}
    variant = lambda name, least: F.struct(F.lit(name).alias("variant"), F.lit(least).cast("double").alias("least"))
    shown = F.array().cast("array<struct<variant:string,least:double>>")
    for system, listed in names.items():
        more = [variant(f"confidence_threshold_{x:.2f}", x) for x in thresholds] if system == "full" else []
        shown = F.when(F.col("system") == system, F.array(*[variant(n, None) for n in listed], *more)).otherwise(shown)
    rows = settled(rows, {"__true": F.col("true"), "n_tokens": F.col("n_tokens") if "n_tokens" in rows.columns else F.size("t")})

    # Entities and labels are the system's, whatever the threshold.
    value = "text" if "text" in rows.schema["raw"].dataType.elementType.names else "value"
    signature = lambda f, v: F.struct(F.lower(F.trim(f)).alias("f"), F.trim(F.coalesce(v, F.lit(""))).alias("v"))
    rows = settled(rows, {"__pe": F.array_distinct(F.transform("raw", lambda e: signature(e["field"], e[value]))), "__te": F.array_distinct(F.transform("__true", lambda x: signature(x["field"], x["text"])))})
    rows = settled(rows, {"entity_tp": F.size(F.array_intersect("__pe", "__te"))}).withColumn("entity_fp", F.size("__pe") - F.col("entity_tp")).withColumn("entity_fn", F.size("__te") - F.col("entity_tp"))
    if "gold" in rows.columns:
        rows = settled(rows, {"__ps": label_spans(F.col("labels")), "__gs": label_spans(F.col("gold"))})
        rows = settled(rows, {"token_tp": F.size(F.array_intersect("__ps", "__gs")), "token_pred": F.size("__ps"), "token_true": F.size("__gs")})
    else:
        rows = settled(rows, {c: F.lit(0) for c in ("token_tp", "token_pred", "token_true")})
    sums = ["entity_tp", "entity_fp", "entity_fn", "token_tp", "token_pred", "token_true"]
    rows = rows.select("doc_id", "n_tokens", *sums, "__true", "output", F.inline(shown))

    said = lambda xs: F.filter(F.transform(xs, lambda x: F.struct(x["field"].alias("field"), F.trim(x["text"]).alias("text"))), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    rows = settled(rows, {"__pred": said(F.filter("output", lambda x: F.col("least").isNull() | (x["confidence"] >= F.col("least")))), "__true": said("__true")})
    field = lambda xs: F.transform(xs, lambda x: x["field"])
    text = lambda xs, f: F.get(F.filter(xs, lambda x: x["field"] == f), 0)["text"]
    rows = settled(rows, {"__both": F.transform(F.array_union(field("__pred"), field("__true")), lambda f: F.struct(f.alias("field"), text("__pred", f).alias("p"), text("__true", f).alias("t")))})
    near = F.filter("__both", lambda x: x["p"].isNotNull() & x["t"].isNotNull() & (x["p"] != x["t"]))
    rows = settled(rows, {"__near": _ratios(F.transform(near, lambda x: x["p"]), F.transform(near, lambda x: x["t"]))})
    count = lambda test: F.size(F.filter("__both", test))
    tp = count(lambda x: F.coalesce(x["p"] == x["t"], F.lit(False)))
    return rows.select(
        "doc_id", "variant", "n_tokens", *sums, tp.alias("tp"), F.size("__pred").alias("n_pred"), F.size("__true").alias("n_true"), (tp == F.size("__both")).alias("exact"),
        (F.aggregate("__near", F.lit(0.0), lambda s, v: s + v) + tp).alias("partial_sum"), count(lambda x: x["p"].isNotNull() & x["t"].isNotNull()).alias("partial_n"), F.col("__both").alias("fields"),
    )


def summary(scored: DataFrame) -> DataFrame:
    """A row for each variant: its documents and the precision, recall and F1 of its labels, entities and fields."""
    total = lambda c: F.sum(c).cast("long")
    got = scored.groupBy("variant").agg(F.count("*").alias("n_docs"), F.avg(F.col("exact").cast("int")).alias("exact_match_accuracy"), *[total(c).alias(c) for c in ("tp", "n_pred", "n_true", "entity_tp", "entity_fp", "entity_fn", "token_tp", "token_pred", "token_true", "partial_n")], F.sum("partial_sum").alias("partial_sum"))
    parts = lambda name, tp, fp, fn: [c.alias(f"{name}{k}") for c, k in zip(precision_recall(tp, fp, fn), ("precision", "recall", "f1"), strict=True)]
    c = F.col
    return got.select(
        "variant", "n_docs", "exact_match_accuracy", *parts("", c("tp"), c("n_pred") - c("tp"), c("n_true") - c("tp")), *parts("entity_", c("entity_tp"), c("entity_fp"), c("entity_fn")),
        *parts("token_", c("token_tp"), c("token_pred") - c("token_tp"), c("token_true") - c("token_tp")), F.coalesce(F.try_divide("partial_sum", "partial_n"), F.lit(0.0)).alias("partial_match"),
    )


def field_summary(scored: DataFrame) -> DataFrame:
    """(variant, field, n_pred, n_true, tp, precision, recall, f1, accuracy): what each field adds to the variants' scores."""
    rows = scored.select("variant", F.inline("fields"))
    got = rows.groupBy("variant", "field").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count_if(F.col("p") == F.col("t")).alias("tp"))
    return got.select("*", *precision_recall(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_true").cast("double")), F.lit(0.0)).alias("accuracy"))


def run(samples: DataFrame, today: str, aliases: dict[str, str] = ALIASES, labeler: Callable[[DataFrame], DataFrame] | None = None, thresholds: tuple[float, ...] = THRESHOLDS, with_recovery: bool = False) -> DataFrame:
    """The scores of all variants by document; ``summary`` adds them up, ``errors`` sorts the documents by what went wrong."""
    # The truth is read once a document, before its systems stand in rows of their own.
    true = payloads.pairs_of(payloads.payload_of(F.col("truth"), dict(samples.dtypes)["truth"]))
    rows = settled(samples, {"true": true}).drop("truth")
    if with_recovery:
        return scores(outputs(systems(rows, labeler or (lambda r: packed.label(r, aliases))), today, aliases, True), thresholds)
    return scores(shown(systems(rows, labeler), today, aliases), thresholds)


def samples_of(tokens: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc_id, t, truth) of a token table and (doc_id, truth); documents without tokens have an empty t."""
    rows = truth.select("doc_id", "truth").join(packed.pack(tokens), "doc_id", "left")
    empty = F.array().cast(dict(rows.dtypes)["t"])
    return rows.select("doc_id", F.coalesce("t", empty).alias("t"), "truth")


# ---------------------------------------------------------------- errors
def errors(scored: DataFrame) -> DataFrame:
    """(doc_id, category): a row for each kind of error a document shows, by comparing its baselines."""
    of = lambda name, value: F.max(F.when(F.col("variant") == name, value))
    f1 = precision_recall(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp"))[2]
    partial = F.coalesce(F.try_divide("partial_sum", "partial_n"), F.lit(0.0))
    wide = scored.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"), of("ocr_only", partial).alias("ocr"), of("text_only", f1).alias("text_f1"), of("no_postprocessing", f1).alias("raw_f1"), of("full", f1).alias("full_f1"), of("text_only", partial).alias("text"), of("no_postprocessing", partial).alias("raw"))
    tests = {"ocr_errors": (F.col("n_tokens") == 0) | (F.col("ocr") == 0), "layout_errors": F.col("text_f1") > F.col("raw_f1"), "model_misclassification": F.col("raw") < F.col("text"), "postprocessing_failures": F.col("raw_f1") > F.col("full_f1")}
    return wide.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))).alias("category"))


def examples(rows: DataFrame, by: str, order: str, limit: int = EXAMPLES) -> DataFrame:
    """The first ``limit`` rows of each group. The limit on the rank goes below the exchange, so a task sends few rows of a group, however many it has."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(order)))
    return ranked.filter(F.col("rank") <= limit)


def error_report(scored: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """(category, n, examples): counts of each kind of error and its first documents."""
    found = errors(scored)
    first = examples(found, "category", "doc_id", limit).groupBy("category").agg(F.array_sort(F.collect_list("doc_id")).alias("examples"))
    return found.groupBy("category").agg(F.count("*").alias("n")).join(first, "category")
