"""Scalar normalizers as column expressions. The amount parsers are separate families on purpose: each has its own separator rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .helpers import last_index, let, number, to_col

# Date layouts of the post-processing normalizer, in the order they are tried (day first).
DATE_LAYOUTS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d", "d.M.yyyy", "MMM d yyyy", "d MMM yyyy", "MMMM d yyyy", "d MMMM yyyy")
# Characters that recognition confuses with digits.
ARTIFACTS = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5"}
# Field aliases.
ALIASES = {"invoice number": "invoice_number", "invoice no": "invoice_number", "invoice #": "invoice_number", "date": "date", "invoice date": "date", "total amount": "total_amount", "total": "total_amount", "amount due": "total_amount", "subtotal": "subtotal", "tax": "tax_amount", "tax amount": "tax_amount"}


def cleanup_text(c: Column | str) -> Column:
    """White space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(to_col(c), r"(?U)\s+", " "))


def normalize_string(c: Column | str) -> Column:
    return F.nullif(cleanup_text(c), F.lit(""))


def canonical_field(c: Column | str, aliases: dict[str, str] = ALIASES) -> Column:
    """An exact alias, else the longest alias contained, else the words joined by underscores."""
    text = F.lower(F.trim(F.regexp_replace(to_col(c), r"(?U)[:\s]+", " ")))

    def choose(t: Column) -> Column:
        out = F.regexp_replace(t, " ", "_")
        for alias in sorted(aliases, key=len):
            out = F.when(F.contains(t, F.lit(alias)), aliases[alias]).otherwise(out)
        for alias, field in aliases.items():
            out = F.when(t == alias, field).otherwise(out)
        return out

    return let(text, choose)


def fix_artifacts(c: Column | str) -> Column:
    """Letters mistaken for digits, beside a digit of the original text; repairs do not cascade."""
    text = to_col(c)
    table = F.create_map(*[F.lit(x) for kv in ARTIFACTS.items() for x in kv])

    def repair(chars: Column) -> Column:
        def one(ch: Column, i: Column) -> Column:
            beside = F.coalesce(F.get(chars, i - 1).rlike("[0-9]"), F.lit(False)) | F.coalesce(F.get(chars, i + 1).rlike("[0-9]"), F.lit(False))
            return F.when(beside, F.coalesce(F.try_element_at(table, ch), ch)).otherwise(ch)

        return F.array_join(F.transform(chars, one), "")

    return F.when(text.rlike(r"^[0-9A-Za-z$€£¥,.\-:/() ]+$"), let(F.filter(F.split(text, ""), lambda x: x != ""), repair)).otherwise(text)


def normalize_date(c: Column | str) -> Column:
    """ISO text of a date in one of the layouts, day before month where both fit; else null."""
    text = F.replace(cleanup_text(c), F.lit(","), F.lit(""))
    return let(text, lambda t: F.date_format(F.coalesce(*[F.try_to_date(t, layout) for layout in DATE_LAYOUTS]), "yyyy-MM-dd"))


def _thousands(t: Column, mark: str) -> Column:
    m = "\\" + mark
    return t.rlike(rf"^-*[^{m}-][^{m}]{{0,2}}({m}[0-9]{{3}})+$")


def plain_separators(candidate: Column) -> Column:
    """Digits with a decimal point from digits with either separator; groups of three are thousands."""

    def rule(t: Column) -> Column:
        dot, comma = F.contains(t, F.lit(".")), F.contains(t, F.lit(","))
        no_dot, no_comma = F.replace(t, F.lit("."), F.lit("")), F.replace(t, F.lit(","), F.lit(""))
        both = F.when(last_index(t, ",") > last_index(t, "."), F.replace(no_dot, F.lit(","), F.lit("."))).otherwise(no_comma)
        first_kept = lambda mark: F.concat(F.substring_index(t, mark, 1), F.lit("."), F.replace(F.substr(t, F.instr(t, mark) + 1), F.lit(mark), F.lit("")))
        only_dot = F.when(_thousands(t, "."), no_dot).when(t.rlike(r"\..*\."), first_kept(".")).otherwise(t)
        only_comma = F.when(_thousands(t, ","), no_comma).otherwise(first_kept(","))
        return F.when(dot & comma, both).when(dot, only_dot).when(comma, only_comma).otherwise(t)

    return let(candidate, rule)


def normalize_currency(c: Column | str) -> Column:
    """Amount of a text; brackets around it make it negative."""

    def rule(t: Column) -> Column:
        digits = F.regexp_replace(F.trim(F.regexp_replace(t, r"^[()]+|[()]+$", "")), r"[^0-9,.\-]", "")
        value = let(plain_separators(digits), number)
        return F.when(t.rlike(r"^\(.*\)$"), -value).otherwise(value)

    return let(cleanup_text(c), rule)


def recovery_amount(c: Column | str) -> Column:
    """Amount of one token of a receipt: 73,45 has decimals, 28.000 and 28,000 have thousands."""

    def rule(t: Column) -> Column:
        no_dot, no_comma = F.replace(t, F.lit("."), F.lit("")), F.replace(t, F.lit(","), F.lit(""))
        comma_last = F.replace(no_dot, F.lit(","), F.lit("."))
        plain = (
            F.when(F.contains(t, F.lit(",")) & F.contains(t, F.lit(".")), F.when(last_index(t, ",") > last_index(t, "."), comma_last).otherwise(no_comma))
            .when(F.contains(t, F.lit(",")), F.when(t.rlike(r"^[^,]{1,2},[^,]{1,2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(no_comma))
            .when(t.rlike(r"^[^.]{0,3}\.[0-9]{3}$") | t.rlike(r"\..*\."), no_dot)
            .otherwise(t)
        )
        return let(plain, number)

    return let(to_col(c), rule)


def naive_amount(c: Column | str) -> Column:
    """Amount with every comma dropped."""
    return let(F.regexp_replace(to_col(c), r"[^0-9.\-]", ""), number)


def dataset_amount(c: Column | str) -> Column:
    """The last number of a text, commas dropped."""
    found = F.regexp_extract_all(to_col(c), F.lit(r"-?\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return number(F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")))


def merge_space_thousands(c: Column | str) -> Column:
    return F.regexp_replace(to_col(c), r"(?<=\d) (?=\d{3}(?:\s|$))", "")


def words(c: Column | str) -> Column:
    return F.filter(F.split(to_col(c), r"\s+"), lambda x: x != "")


def token_amounts(c: Column | str) -> Column:
    """Amounts of the tokens that are digits, points and commas only."""
    return F.filter(F.transform(F.filter(words(c), lambda x: x.rlike(r"^[0-9.,]+$")), recovery_amount), lambda v: v.isNotNull())


def is_quantity(v: Column) -> Column:
    return (v == F.floor(v)) & v.between(1, 99)


def evaluation_text(c: Column | str) -> Column:
    """Lower case, one blank between words, marks at the end dropped."""
    return F.regexp_replace(F.lower(cleanup_text(c)), r"(?U)[^\w\s/-]+$", "")


def value_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(to_col(c)), F.lit("[a-z0-9.]+"), F.lit(0))


def grounding_text(c: Column | str) -> Column:
    """Lower case without commas and currency signs."""
    return F.translate(F.lower(to_col(c)), ",$€£¥", "")


def semantic_category(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(to_col(c), "^[BI]-", ""), "(?i)_(key|value)$", ""))


def remap_label(c: Column | str, strict: bool = False) -> Column:
    """BIO labels to key and value labels. Every B- and I- label is a value, keys too, unless strict."""
    label = F.upper(to_col(c))
    keep = F.when(label.isin("B-KEY", "I-KEY"), label) if strict else F.when(F.lit(False), label)
    return keep.when(label.startswith("B-"), "B-VALUE").when(label.startswith("I-"), "I-VALUE").otherwise("O")


def plausible_total(v: Column) -> Column:
    return (v >= 1) & (v < 1e12) & ~((v == F.floor(v)) & v.between(1800, 2100))


def json_candidate(c: Column | str) -> Column:
    """From the first opening bracket to the last closing one, of whatever kind; null without both."""
    text = to_col(c)

    def rule(t: Column) -> Column:
        brace, square = F.instr(t, "{"), F.instr(t, "[")
        start = F.least(F.nullif(brace, F.lit(0)), F.nullif(square, F.lit(0)))
        end = F.greatest(last_index(t, "]"), last_index(t, "}"))
        return F.when(end > start, F.substr(t, start, end - start + 1))

    return let(text, rule)


def whole_json(c: Column) -> Column:
    """The VARIANT of a text that is one JSON value; null else. try_parse_json alone reads a value and passes over what follows it."""
    return let(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), lambda v: F.when(F.size(F.try_variant_get(v, "$", "array<variant>")) == 1, F.try_variant_get(v, "$[0]", "variant")))


def loads_with_repair(c: Column | str) -> Column:
    """A VARIANT from the whole text, else its bracketed part, else what follows the first colon, else the last line that can be read, itself or behind its colon."""
    text = to_col(c)
    behind = lambda t: F.trim(F.regexp_extract(t, r"(?s)^[^:]*:(.*)$", 1))
    lines = F.reverse(F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != ""))
    tried = F.concat(F.array(text, json_candidate(text), behind(text)), F.flatten(F.transform(lines, lambda x: F.array(x, behind(x)))))
    return whole_json(F.get(F.filter(tried, lambda x: whole_json(x).isNotNull()), 0))


def token_estimate(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.size(words(c)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), F.nullif(norm, F.lit(0.0))), F.lit(0.0))


def hashing_embedding(c: Column | str, size: int = 256) -> Column:
    """Counts of the words' SHA-256 modulo ``size`` (a power of two up to 256), scaled to unit length."""
    if size & (size - 1) or not 0 < size <= 256:
        raise ValueError("size must be a power of two up to 256")
    slots = F.transform(F.filter(F.split(F.lower(to_col(c)), r"\s+"), lambda x: x != ""), lambda w: F.conv(F.right(F.sha2(w, 256), F.lit(2)), 16, 10).cast("int") % size)

    def build(s: Column) -> Column:
        # array_remove passes over the words natively; a filter would call a lambda for each word and slot.
        counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (F.size(s) - F.size(F.array_remove(s, k))).cast("double"))
        return let(counts, lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x / n))))

    return let(slots, build)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; both empty gives 1, one empty 0."""
    from difflib import SequenceMatcher

    def one(x, y):
        x, y = x or "", y or ""
        return 1.0 if not x and not y else 0.0 if not x or not y else SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def evaluation_date(default: str = "2000-01-01"):
    """The evaluator's date reading, month first and fuzzy; missing parts come from ``default``. A text that can't be read so gives the first ISO date that stands in it."""

    @F.pandas_udf(StringType())
    def read(c: pd.Series) -> pd.Series:
        import re
        from datetime import datetime

        from dateutil import parser

        base = datetime.fromisoformat(default)

        def one(x):
            try:
                return parser.parse(x, fuzzy=True, default=base).date().isoformat() if x else None
            except (ValueError, OverflowError):
                found = re.search(r"\b\d{4}-\d{2}-\d{2}\b", x)
                return found.group(0) if found else None

        return c.map(one, na_action=None).astype("object")

    return read
