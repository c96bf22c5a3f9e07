"""From tokens to checked fields in one row a document: label, group, recover, normalize, merge, validate, constrain, confidence.

A document's tokens are packed once (the only exchange); each stage after that is a projection that reads the
columns of the stages before it. So the whole chain is one narrow plan, whatever stages a caller leaves out, and
rows may carry any key: a system's or a variant's name beside the document's id.

Codes are in the order of the stages, each as often as it occurs: missing_value, normalization_failed,
conflicting_values, the validation's, the constraints', low_confidence. A document's orphan values have no field.

Defined cases: blank and null texts are no tokens; documents without tokens don't occur in a token table, so they
have no row; tokens of one place stay in the order of their texts; a required field that is absent has status
missing; a total filled from the items has confidence 0, by which the confidence policy drops it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.helpers import let, mean, runs, scan, settled
from ..functions.scalars import ALIASES, canonical_field, cleanup_text, fix_artifacts, merge_space_thousands, normalize_currency, normalize_date, recovery_amount, token_amounts, words
from ..session import ship
from . import chain
from . import fields as rules
from .labels import match_key
from .recovery import COMPANY, COUNT_LINE, DATE_SHAPES, GRAND, HEADER_WORDS, INVOICE_SHAPES, NO_VENDOR, PLAIN, SECTION, SUB, clean_description, items_confidence, looks_valid, resolve_price

ITEM = "struct<description:string,quantity:double,unit_price:double>"
ENTITY = f"struct<field:string,key:string,value:string,confidence:double,code:string,items:array<{ITEM}>>"
RECORD = f"struct<field:string,value:string,confidence:double,valid:boolean,codes:array<string>,items:array<{ITEM}>,absent:boolean>"
FIELD = f"struct<field:string,value:string,confidence:double,valid:boolean,status:string,codes:array<string>,items:array<{ITEM}>>"
#: Lines whose tokens' heights differ by so much at most, and the bounds of a recovered field's confidence.
TOLERANCE, LOW, HIGH, UNKNOWN = 18, 0.45, 0.75, 0.55


def number_text(v: Column) -> Column:
    """A number with up to six decimals, without zeros at the end."""
    return F.when(v.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v), "0+$", ""), r"\.$", ""))


def amount_text(v: Column) -> Column:
    """A recovered amount as text: whole, or with two decimals."""
    return F.when(v == F.floor(v), F.format_string("%.0f", v)).when(v.isNotNull(), F.format_string("%.2f", v))


def pack(tokens: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys…, t): a row for each document with its tokens in their order; label and category go with them where there are such columns."""
    columns = ["pos", "text", "confidence", *(c for c in ("x0", "y0", "page_number", "label", "category") if c in tokens.columns)]
    return tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("t"))


# ---------------------------------------------------------------- labels and entities
def label(rows: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Adds labels, beside t: keys by the longest alias from left to right, and what follows them as their values.

    A value begins at the first token behind the key that is neither blank nor a colon; blank tokens stay O.
    """
    parts = sorted({a: a.split(" ") for a in aliases}.values(), key=len)
    rows = settled(rows, {"__k": F.transform("t", lambda x: match_key(x["text"]))})

    def size(i: Column) -> Column:
        out = F.lit(0)
        for p in parts:  # the longest is tried first, since the last condition added stands outermost
            out = F.when(reduce(lambda a, b: a & b, [F.coalesce(F.get("__k", i + j) == w, F.lit(False)) for j, w in enumerate(p)]), len(p)).otherwise(out)
        return out

    begins = F.filter(F.transform("__k", lambda _, i: F.struct(i.alias("n"), size(i).alias("size"))), lambda x: x["size"] > 0)
    kind = "struct<end:int,keys:array<struct<n:int,size:int>>>"
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<n:int,size:int>>").alias("keys")).cast(kind)
    keys = F.aggregate(begins, none, lambda s, x: F.when(x["n"] < s["end"], s).otherwise(F.struct((x["n"] + x["size"]).alias("end"), F.array_append(s["keys"], x).alias("keys")).cast(kind)), lambda s: s["keys"])
    said = F.filter(F.transform("__k", lambda w, i: F.when(w != "", i)), lambda i: i.isNotNull())
    rows = settled(rows, {"__keys": keys, "__said": said})
    with_first = F.transform("__keys", lambda x: F.struct(x["n"].alias("n"), (x["n"] + x["size"]).alias("end"), F.get(F.filter("__said", lambda p: p >= x["n"] + x["size"]), 0).alias("first")))
    rows = settled(rows, {"__keys": with_first})

    def one(w: Column, i: Column) -> Column:
        of = lambda x: F.when(x.isNull(), "O").when(i == x["n"], "B-KEY").when(i < x["end"], "I-KEY").when(w == "", "O").when(i == x["first"], "B-VALUE").otherwise("I-VALUE")
        return let(F.try_element_at(F.filter("__keys", lambda x: x["n"] <= i), F.lit(-1)), of)

    return settled(rows, {"labels": F.transform("__k", one)}).drop("__k", "__keys", "__said")


def spans(rows: DataFrame, labels: str = "labels", has_category: bool = False) -> DataFrame:
    """Adds spans (type, text, confidence): a token goes on with the open span of its type if its category is that of the span's first token, or it has none and is an I-."""
    upper = F.transform(labels, lambda x: F.upper(F.trim(x)))
    shape = "^([BI])-(KEY|VALUE)$"
    cat = (lambda x: F.trim(F.coalesce(x["category"], F.lit("")))) if has_category else (lambda x: F.lit(""))
    seen = F.zip_with("t", upper, lambda x, g: F.struct(F.trim(x["text"]).alias("text"), F.coalesce(x["confidence"], F.lit(0.0)).cast("double").alias("confidence"), cat(x).alias("cat"), F.regexp_extract(F.coalesce(g, F.lit("O")), shape, 1).alias("p"), F.regexp_extract(F.coalesce(g, F.lit("O")), shape, 2).alias("type")))
    rows = settled(rows, {"__g": F.filter(seen, lambda x: F.coalesce(x["text"], F.lit("")) != "")})
    state = "struct<span:int,open:boolean,type:string,cat:string>"
    first = F.struct(F.lit(-1).alias("span"), F.lit(False).alias("open"), F.lit("").alias("type"), F.lit("").alias("cat"))

    def step(s: Column, x: Column) -> Column:
        inside = x["type"] != ""
        goes_on = s["open"] & (s["type"] == x["type"]) & F.when(x["cat"] != "", x["cat"] == s["cat"]).otherwise(x["p"] == "I")
        return F.struct(F.when(inside & ~goes_on, s["span"] + 1).otherwise(s["span"]).alias("span"), inside.alias("open"), x["type"].alias("type"), F.when(goes_on, s["cat"]).otherwise(x["cat"]).alias("cat"))

    rows = settled(rows, {"__id": scan(F.col("__g"), first, step, state, lambda s: F.when(s["open"], s["span"]).otherwise(-1), "int")})
    make = lambda i, m: F.struct(i.alias("id"), F.get(m, 0)["type"].alias("type"), F.array_join(F.transform(m, lambda x: x["text"]), " ").alias("text"), mean(F.transform(m, lambda x: x["confidence"])).alias("confidence"))
    return settled(rows, {"spans": F.filter(runs(F.col("__id"), F.col("__g"), make), lambda x: x["id"] >= 0)}).drop("__g", "__id")


def entities(rows: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Adds entities and orphans: a KEY with the VALUE right behind it is a pair, other keys miss a value, other values are orphans (counted)."""

    def one(s: Column, i: Column) -> Column:
        after = F.get("spans", i + 1)
        paired = F.coalesce(after["type"] == "VALUE", F.lit(False))
        return F.struct(canonical_field(s["text"], aliases).alias("field"), s["text"].alias("key"), F.when(paired, after["text"]).alias("value"), F.when(paired, (s["confidence"] + after["confidence"]) / 2).otherwise(s["confidence"]).alias("confidence"), F.when(~paired, "missing_value").alias("code"), F.lit(None).cast(f"array<{ITEM}>").alias("items")).cast(ENTITY)

    found = F.filter(F.transform("spans", lambda s, i: F.when(s["type"] == "KEY", one(s, i))), lambda x: x.isNotNull())
    stray = F.size(F.filter(F.transform("spans", lambda s, i: (s["type"] == "VALUE") & ~F.coalesce(F.get("spans", i - 1)["type"] == "KEY", F.lit(False))), lambda x: x))
    return settled(rows, {"entities": found, "orphans": stray})


# ---------------------------------------------------------------- lines and what they give
def lines(rows: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Adds lines (text, confidence): by page and height, a token joins while its height is near the line's least."""
    ordered = F.array_sort(F.transform("t", lambda x: F.struct(F.coalesce(x["page_number"], F.lit(1)).alias("page"), x["y0"].alias("y"), x["x0"].alias("x"), x["pos"].alias("pos"), x["text"].alias("text"), x["confidence"].cast("double").alias("confidence"))))
    rows = settled(rows, {"__o": ordered})
    state = "struct<line:int,y:int,page:int>"
    first = F.struct(F.lit(-1).alias("line"), F.lit(0).alias("y"), F.lit(0).alias("page"))

    def step(s: Column, x: Column) -> Column:
        same = (s["line"] >= 0) & (F.abs(x["y"] - s["y"]) <= tolerance) & (x["page"] == s["page"])
        return F.struct(F.when(same, s["line"]).otherwise(s["line"] + 1).alias("line"), F.when(same, F.least(s["y"], x["y"])).otherwise(x["y"]).alias("y"), x["page"].alias("page"))

    rows = settled(rows, {"__id": scan(F.col("__o"), first, step, state, lambda s: s["line"], "int")})

    def make(i: Column, m: Column) -> Column:
        across = F.array_sort(F.transform(m, lambda x: F.struct(x["x"].alias("x"), x["pos"].alias("pos"), x["text"].alias("text"))))
        text = F.array_join(F.filter(F.transform(across, lambda x: F.trim(x["text"])), lambda x: x != ""), " ")
        return F.struct(text.alias("text"), bounded(mean(F.filter(F.transform(m, lambda x: x["confidence"]), lambda c: c.isNotNull()))).alias("confidence"))

    return settled(rows, {"lines": runs(F.col("__id"), F.col("__o"), make)}).drop("__o", "__id")


def bounded(c: Column) -> Column:
    """A recovered field's confidence from a mean: within its bounds, and a middle one where nothing is known."""
    return F.when(c.isNull(), UNKNOWN).otherwise(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), c)))


def first_hit(text: Column, shapes: tuple[str, ...], group: int) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in shapes])


def recovered(rows: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Adds found: the entities that the lines give by patterns, without regard to those there are; items on receipts alone."""
    texts = F.transform("lines", lambda x: F.trim(x["text"]))
    rows = settled(rows, {"__text": F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), "__head": bounded(mean(F.transform(F.slice("lines", 1, 3), lambda x: x["confidence"]))), "__n": F.transform(texts, merge_space_thousands)})
    rows = settled(rows, {"__l": F.transform("__n", lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"), words(t).alias("w"), token_amounts(t).alias("amounts")))})
    # Date: lines that say so before others.
    dated = F.filter(F.transform("lines", lambda x, i: F.struct((~F.lower(x["text"]).contains("date")).alias("plain"), i.alias("i"), first_hit(x["text"], DATE_SHAPES, 0).alias("d"))), lambda x: x["d"].isNotNull())
    day = F.coalesce(F.array_min(dated)["d"], first_hit(F.col("__text"), DATE_SHAPES, 0))
    # Vendor: one of the first five lines that reads like a company and is no alias.
    upper = lambda t: (t == F.upper(t)) & t.rlike("[A-Za-z]")
    company = lambda t: (t != "") & ~F.lower(t).rlike(NO_VENDOR) & ~F.lower(t).isin(*map(str.lower, aliases)) & (F.regexp_count(t, F.lit(r"\d")) <= 0.05 * F.length(t)) & F.lower(t).rlike(COMPANY) & ((F.size(words(t)) >= 2) | upper(t))
    vendor = F.get(F.filter(F.slice(texts, 1, 5), company), 0)
    # Total: the surest keyword, lower lines before higher ones; else the last plausible amount.
    score = lambda x: F.when(x["low"].rlike(COUNT_LINE), F.lit(None).cast("double")).when(x["low"].rlike(GRAND), 6.0).when(x["low"].rlike(PLAIN), 4.0).when(x["low"].rlike(SUB), 1.0)
    sure = lambda x: F.when(x["low"].rlike(GRAND), 0.78).when(x["low"].rlike(PLAIN), 0.72).otherwise(0.55)
    scored = F.filter(F.transform("__l", lambda x, i: F.struct((score(x) + 0.2 * i).alias("score"), (-i).alias("i"), F.try_element_at(x["amounts"], F.lit(-1)).alias("value"), sure(x).alias("confidence"))), lambda x: x["score"].isNotNull() & x["value"].isNotNull())
    spare = F.try_element_at(F.filter(F.flatten(F.transform("__l", lambda x: x["amounts"])), lambda v: v.between(1, 50_000_000)), F.lit(-1))
    total = let(F.array_max(scored), lambda b: F.struct(F.coalesce(b["value"], spare).alias("value"), F.coalesce(b["confidence"], F.lit(0.5)).alias("confidence")))
    receipt = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["text"]), " "), r"\s+", " ").rlike(SECTION) & (F.size(F.flatten(F.transform("__l", lambda x: x["amounts"]))) >= 2)
    rows = settled(rows, {"__date": day, "__vendor": vendor, "__total": total, "__number": F.trim(first_hit(F.col("__text"), INVOICE_SHAPES, 1)), "__receipt": receipt})
    rows = line_items(rows)
    none = F.lit(None).cast(f"array<{ITEM}>")
    one = lambda name, value, c, items=none: F.struct(F.lit(name).alias("field"), F.lit(f"heuristic_{name}").alias("key"), value.alias("value"), c.alias("confidence"), F.lit(None).cast("string").alias("code"), items.alias("items")).cast(ENTITY)
    items = F.when(F.col("__receipt") & (F.size("__items") > 0), F.col("__items"))
    every = F.array(one("invoice_number", F.col("__number"), F.col("__head")), one("date", F.col("__date"), F.col("__head")), one("vendor", F.col("__vendor"), F.col("__head")), one("total_amount", amount_text(F.col("__total.value")), F.col("__total.confidence")), one("line_items", F.to_json(items), items_confidence(F.col("__items")), items))
    return settled(rows, {"found": F.filter(every, lambda x: x["value"].isNotNull())}).drop("__text", "__head", "__n", "__l", "__date", "__vendor", "__total", "__number", "__receipt", "__items")


def line_items(rows: DataFrame) -> DataFrame:
    """Adds __items, from the lines' parts in __l: items on one line, and a description followed by a line of numbers.

    A fold over the lines, whose state is the description that waits for its numbers. Section lines, items and
    lines of numbers end it; lines of marks alone, or with a header's keyword, leave it as it is.
    """
    number = r"^[0-9.,]+$"

    def parts(x: Column) -> Column:
        lead = F.nullif(F.regexp_extract(F.coalesce(F.get(x["w"], 0), F.lit("")), r"(?i)^(\d{1,2})\s*x?$", 1), F.lit(""))
        rest = F.when(lead.isNotNull(), F.slice(x["w"], F.lit(2), F.greatest(F.size(x["w"]), F.lit(1)))).otherwise(x["w"])
        return F.struct(x["t"].alias("t"), x["low"].alias("low"), x["amounts"].alias("amounts"), lead.cast("double").alias("lead"), rest.alias("rest"))

    def read(x: Column) -> Column:
        numbers = F.filter(x["rest"], lambda w: w.rlike(number))
        described = clean_description(F.array_join(F.filter(x["rest"], lambda w: ~w.rlike(number) & ~F.lower(w).isin("x", "@")), " "))
        return F.struct(*[x[c].alias(c) for c in ("t", "low", "amounts", "lead")], (F.size(numbers) > 0).alias("has"), F.filter(F.transform(numbers, recovery_amount), lambda v: v.isNotNull()).alias("numbers"), described.alias("described"))

    def kinds(x: Column) -> Column:
        item = x["has"] & ((x["described"] != "") | (F.coalesce(x["lead"], F.lit(0.0)) != 0))
        says = x["t"].rlike("[A-Za-z]") & ~x["low"].rlike(HEADER_WORDS)
        kind = F.when(x["t"] == "", "none").when(x["t"].rlike(SECTION), "section").when(item, "item").when(F.size(x["amounts"]) > 0, "numbers").when(says, "text").otherwise("none")
        return F.struct(kind.alias("kind"), F.when(kind == "text", clean_description(x["t"])).otherwise(x["described"]).alias("described"), resolve_price(F.when(item, x["numbers"]).otherwise(x["amounts"]), F.when(item, x["lead"])).alias("price"))

    for stage in (parts, read, kinds):
        rows = settled(rows, {"__l": F.transform("__l", stage)})
    state = f"struct<waits:string,out:{ITEM}>"
    nothing = F.lit(None).cast(ITEM)

    def step(s: Column, x: Column) -> Column:
        item = lambda d: F.struct(d.alias("description"), x["price"]["quantity"].alias("quantity"), x["price"]["unit_price"].alias("unit_price")).cast(ITEM)
        to = lambda waits, out: F.struct(waits.alias("waits"), out.alias("out")).cast(state)
        gone = F.lit("")
        told = F.when(x["described"] != "", x["described"]).otherwise(s["waits"])
        return (
            F.when(x["kind"] == "section", to(gone, nothing))
            .when(x["kind"] == "item", to(gone, F.when(told != "", item(told)).otherwise(nothing)))
            .when(x["kind"] == "numbers", to(gone, F.when((s["waits"] != "") & x["price"]["unit_price"].isNotNull(), item(s["waits"])).otherwise(nothing)))
            .when(x["kind"] == "text", to(F.trim(F.concat_ws(" ", F.nullif(s["waits"], F.lit("")), x["described"])), nothing))
            .otherwise(to(s["waits"], nothing))
        )

    got = scan(F.col("__l"), F.struct(F.lit("").alias("waits"), nothing.alias("out")), step, state, lambda s: s["out"], ITEM)
    return settled(rows, {"__items": F.filter(got, lambda x: x.isNotNull())})


def recover(rows: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Entities, and behind them what the lines give for each field without a plausible value."""
    rows = recovered(lines(rows), aliases)
    good = lambda f: F.exists("entities", lambda e: (e["field"] == f) & looks_valid(e["field"], e["value"]) & (f != "line_items"))
    return settled(rows, {"entities": F.concat("entities", F.filter("found", lambda x: ~good(x["field"])))}).drop("found", "lines")


# ---------------------------------------------------------------- fields
def normal_items(items: Column) -> Column:
    """Item texts cleaned up; quantities and prices read as the amounts they are written as."""
    amount = lambda v: F.when(v.isNotNull(), normalize_currency(number_text(v)))
    return F.transform(items, lambda x: F.struct(cleanup_text(x["description"]).alias("description"), amount(x["quantity"]).alias("quantity"), amount(x["unit_price"]).alias("unit_price")).cast(ITEM))


def normalize(rows: DataFrame) -> DataFrame:
    """Values by the class of their field; a value that can't be read is null, its code normalization_failed."""

    def one(e: Column) -> Column:
        text = cleanup_text(e["value"])
        read = F.when(e["field"].isin(*rules.DATE_FIELDS), normalize_date(fix_artifacts(text))).when(e["field"].isin(*rules.CURRENCY_FIELDS), number_text(normalize_currency(fix_artifacts(text)))).otherwise(text)
        items = normal_items(e["items"])
        value = F.when(e["items"].isNotNull(), F.to_json(items)).otherwise(read)
        return let(value, lambda v: F.struct(e["field"].alias("field"), e["key"].alias("key"), v.alias("value"), e["confidence"].alias("confidence"), F.when(e["value"].isNotNull() & v.isNull(), "normalization_failed").otherwise(e["code"]).alias("code"), items.alias("items")).cast(ENTITY))

    return settled(rows, {"entities": F.transform("entities", one)})


def merge(rows: DataFrame) -> DataFrame:
    """Adds fields, a record for each field in order of its first entity: equal values average pairwise, others keep the preferred one."""
    state = f"struct<value:string,confidence:double,items:array<{ITEM}>,conflicts:int>"

    def valid(f: Column, v: Column) -> Column:
        return F.coalesce(F.when(f.isin(*rules.DATE_FIELDS), rules.is_iso_date(v)).when(f.isin(*rules.CURRENCY_FIELDS), v.rlike(r"^-?\d+(\.\d+)?$")).otherwise(F.lit(True)), F.lit(False))

    def record(f: Column) -> Column:
        own = F.filter("entities", lambda e: e["field"] == f)

        def step(s: Column, e: Column) -> Column:
            same = s["value"].eqNullSafe(e["value"])
            has_s, has_e = ~rules.blank(s["value"]), ~rules.blank(e["value"])
            take = F.when(has_e & ~has_s, True).when(has_s & ~has_e, False).when(valid(f, e["value"]) & ~valid(f, s["value"]), True).when(valid(f, s["value"]) & ~valid(f, e["value"]), False).otherwise(e["confidence"] > s["confidence"])
            pick = lambda c: F.when(~same & take, e[c]).otherwise(s[c])
            return F.struct(pick("value").alias("value"), F.when(same, (s["confidence"] + e["confidence"]) / 2).when(take, e["confidence"]).otherwise(s["confidence"]).alias("confidence"), pick("items").alias("items"), (s["conflicts"] + (~same).cast("int")).alias("conflicts")).cast(state)

        def fold(es: Column) -> Column:
            first = F.struct(F.get(es, 0)["value"].alias("value"), F.get(es, 0)["confidence"].alias("confidence"), F.get(es, 0)["items"].alias("items"), F.lit(0).alias("conflicts")).cast(state)
            said = lambda code: F.array_repeat(F.lit(code), F.size(F.filter(es, lambda e: e["code"] == code)))
            done = F.aggregate(F.slice(es, F.lit(2), F.size(es)), first, step)
            return let(done, lambda m: F.struct(f.alias("field"), m["value"].alias("value"), m["confidence"].alias("confidence"), F.lit(True).alias("valid"), F.concat(said("missing_value"), said("normalization_failed"), F.array_repeat(F.lit("conflicting_values"), m["conflicts"])).alias("codes"), m["items"].alias("items"), F.lit(False).alias("absent")).cast(RECORD))

        return let(own, fold)

    return settled(rows, {"fields": F.transform(F.array_distinct(F.transform("entities", lambda e: e["field"])), record)})


def with_codes(r: Column, *codes: Column, **other: Column) -> Column:
    """The record with these codes (nulls left out) behind its own; it is invalid if there is one."""
    own = F.array_compact(F.array(*codes))
    out = r.withField("codes", F.concat(r["codes"], own)).withField("valid", r["valid"] & (F.size(own) == 0))
    for name, value in other.items():
        out = out.withField(name, value)
    return out


def validate(rows: DataFrame) -> DataFrame:
    """Fields without a value, against their pattern, or of the wrong kind."""
    pattern = F.create_map(*[F.lit(x) for kv in rules.PATTERNS.items() for x in kv])

    def one(r: Column) -> Column:
        v, has, rule = r["value"], ~rules.blank(r["value"]), F.try_element_at(pattern, r["field"])
        return with_codes(r, F.when(~has, "missing_value"), F.when(has & rule.isNotNull() & ~F.regexp_like(v, rule), "regex_validation_failed"), F.when(has & r["field"].isin(*rules.DATE_FIELDS) & ~rules.is_iso_date(v), "invalid_date"), F.when(has & r["field"].isin(*rules.CURRENCY_FIELDS) & ~v.rlike(r"^-?\d+(\.\d+)?$"), "invalid_numeric"))

    return settled(rows, {"fields": F.transform("fields", one)})


def constrain(rows: DataFrame, today: str, repair: bool = True, tolerance: float = rules.TOLERANCE) -> DataFrame:
    """Adds flags: required fields, dates after ``today``, and the total against the sum of the items.

    A missing total is filled; with ``repair`` a quantity that alone is missing is derived if it is whole, 1 to 99.
    """
    names = F.transform("fields", lambda r: r["field"])
    need = F.array(*map(F.lit, rules.REQUIRED))
    late = lambda r: F.coalesce(r["field"].isin(*rules.DATE_FIELDS) & (F.try_to_date(r["value"], "yyyy-MM-dd") > F.lit(today).cast("date")), F.lit(False))
    blank = lambda r: F.array_contains(need, r["field"]) & rules.blank(r["value"])
    there = F.transform("fields", lambda r: with_codes(r, F.when(blank(r), "missing_required_field"), F.when(late(r), "future_date")))
    new = F.transform(F.array_except(need, names), lambda f: F.struct(f.alias("field"), F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.lit(False).alias("valid"), F.array(F.lit("missing_required_field")).alias("codes"), F.lit(None).cast(f"array<{ITEM}>").alias("items"), F.lit(True).alias("absent")).cast(RECORD))
    missing = F.transform(F.array_union(F.array_except(need, names), F.transform(F.filter("fields", blank), lambda r: r["field"])), lambda f: F.concat(F.lit("missing_required_field:"), f))
    flags = F.concat(missing, F.transform(F.filter("fields", late), lambda r: F.concat(F.lit("future_date:"), r["field"])))
    rows = settled(rows, {"flags": flags, "fields": F.concat(there, new)})

    of = lambda name, part: F.get(F.filter("fields", lambda r: r["field"] == name), 0)[part]
    rows = settled(rows, {"__items": of("line_items", "items"), "__total": of("total_amount", "value").try_cast("double")})
    amounts = F.filter(F.transform("__items", lambda x: x["unit_price"] * x["quantity"]), lambda v: v.isNotNull())
    open_ = F.filter(F.transform("__items", lambda x, i: F.when(x["unit_price"].isNotNull() & x["quantity"].isNull(), i)), lambda i: i.isNotNull())
    rows = settled(rows, {"__sum": F.when(F.size(amounts) > 0, F.aggregate(amounts, F.lit(0.0), lambda s, v: s + v)), "__open": open_})
    total, sum_ = F.col("__total"), F.col("__sum")
    counts = F.coalesce(F.abs(sum_) > tolerance, F.lit(False))
    price = F.get("__items", F.get("__open", 0))["unit_price"]
    guess = F.bround(F.try_divide(total - sum_, price))
    off = counts & F.coalesce(F.abs(total - sum_) > tolerance, F.lit(False))
    fits = F.coalesce((F.size("__open") == 1) & guess.between(1, 99) & (F.abs(sum_ + guess * price - total) <= tolerance), F.lit(False)) if repair else F.lit(False)
    rows = settled(rows, {"__fill": counts & total.isNull(), "__fix": off & fits, "__off": off & ~fits, "__guess": guess})
    fixed = F.transform("__items", lambda x, i: F.when(i == F.get("__open", 0), x.withField("quantity", F.col("__guess"))).otherwise(x))
    rows = settled(rows, {"__items": F.when(F.col("__fix"), fixed).otherwise(F.col("__items"))})

    def one(r: Column) -> Column:
        filled = r.withField("value", number_text(F.round("__sum", 2))).withField("confidence", F.lit(0.0)).withField("valid", F.lit(True)).withField("absent", F.lit(False))
        items = r.withField("items", F.col("__items")).withField("value", F.to_json("__items"))
        is_total = r["field"] == "total_amount"
        return F.when(is_total & F.col("__fill"), filled).when(is_total & F.col("__off"), with_codes(r, F.lit("line_items_total_mismatch"))).when((r["field"] == "line_items") & F.col("__fix"), items).otherwise(r)

    more = F.array_compact(F.array(F.when(F.col("__fill"), "corrected_total_amount_from_line_items"), F.when(F.col("__fix"), "corrected_quantity_derived_from_total"), F.when(F.col("__off"), "line_items_total_mismatch")))
    return settled(rows, {"fields": F.transform("fields", one), "flags": F.concat("flags", more)}).drop("__items", "__total", "__sum", "__open", "__fill", "__fix", "__off", "__guess")


def confident(rows: DataFrame, threshold: float = rules.MIN_CONFIDENCE, drop: bool = True) -> DataFrame:
    """Adds a status to each field: kept, retained (below the threshold, not valid), dropped (far below it), or missing."""
    least = max(0.35, round(threshold - 0.2, 6))

    def one(r: Column) -> Column:
        low = r["confidence"] < threshold
        status = F.when(r["absent"], "missing").when(~low, "kept").when(F.lit(drop) & (r["confidence"] < least), "dropped").otherwise("retained")
        codes = F.concat(r["codes"], F.when(low & ~r["absent"], F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>")))
        return F.struct(r["field"].alias("field"), r["value"].alias("value"), r["confidence"].alias("confidence"), (r["valid"] & ~low).alias("valid"), status.alias("status"), codes.alias("codes"), r["items"].alias("items"))

    return settled(rows, {"fields": F.transform("fields", one)})


# ---------------------------------------------------------------- the chain
def check(rows: DataFrame, today: str, threshold: float = rules.MIN_CONFIDENCE, drop: bool = True, with_constraints: bool = True, repair: bool = True) -> DataFrame:
    """From entities to checked fields and flags."""
    rows = validate(merge(normalize(rows)))
    rows = constrain(rows, today, repair) if with_constraints else settled(rows, {"flags": F.array().cast("array<string>")})
    return confident(rows, threshold, drop)


def documents(tokens: DataFrame, today: str, aliases: dict[str, str] = ALIASES, threshold: float = rules.MIN_CONFIDENCE, drop: bool = True, with_recovery: bool = True, with_constraints: bool = True, repair: bool = True, keys: tuple[str, ...] = ("doc_id",), keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys…, fields, flags, orphans) of tokens, a row a document, with the columns ``keep`` (its tokens t). Tokens with a label column keep their labels; others are labelled by aliases.

    A document's row goes through ``chain`` in Python, which gives what ``by_stages`` gives, in a fraction of its time.
    """
    rows = pack(tokens, keys)
    carried = [*keys, *keep]
    settings = (today, aliases, threshold, drop, with_recovery, with_constraints, repair, TOLERANCE)
    ship(tokens.sparkSession)
    kind = StructType([rows.schema[n] for n in carried] + StructType.fromDDL(f"fields array<{FIELD}>, flags array<string>, orphans int").fields)
    made = rows.select(*dict.fromkeys([*carried, "t"])).mapInArrow(chain.apply(lambda: chain.Chain(*settings), carried), kind)
    return made.select(*keys, "fields", "flags", "orphans", *keep)


def by_stages(tokens: DataFrame, today: str, aliases: dict[str, str] = ALIASES, threshold: float = rules.MIN_CONFIDENCE, drop: bool = True, with_recovery: bool = True, with_constraints: bool = True, repair: bool = True, keys: tuple[str, ...] = ("doc_id",), keep: tuple[str, ...] = ()) -> DataFrame:
    """``documents`` by the single stages as expressions; ``keep`` may name any column of theirs."""
    rows = pack(tokens, keys)
    own = "label" in tokens.columns
    rows = settled(rows, {"labels": F.transform("t", lambda x: x["label"])}) if own else label(rows, aliases)
    rows = entities(spans(rows, has_category="category" in tokens.columns), aliases)
    rows = recover(rows, aliases) if with_recovery else rows
    return check(rows, today, threshold, drop, with_constraints, repair).select(*keys, "fields", "flags", "orphans", *keep)


def long_fields(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys…, field, value, confidence, valid, status, codes): a row a field, and one without field for a document's orphan values."""
    stray = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.lit(False).alias("valid"), F.lit("error").alias("status"), F.array_repeat(F.lit("orphan_value"), F.col("orphans")).alias("codes"))
    plain = F.transform("fields", lambda r: F.struct(*[r[c].alias(c) for c in ("field", "value", "confidence", "valid", "status", "codes")]))
    every = F.when(F.col("orphans") > 0, F.concat(plain, F.array(stray))).otherwise(plain)
    return docs.select(*keys, F.inline(every))
