"""The stages of ``packed`` for one document in plain Python, applied to Arrow batches: the same rules, without interpreted lambdas.

Spark interprets higher-order functions: a document took 2.3 ms of CPU by expressions. Patterns are those of the
expressions, put into Python's syntax with Java's classes (``java``); numbers are written as Java writes them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import lru_cache

import pyarrow as pa

from . import fields as rules
from .recovery import COMPANY, COUNT_LINE, DATE_SHAPES, GRAND, HEADER_WORDS, INVOICE_SHAPES, NO_VENDOR, PLAIN, SECTION, SECTION_SHAPES, SUB

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CLASSES = {"d": "0-9", "s": r" \t\n\x0b\f\r", "w": "A-Za-z0-9_"}
END = r"(?=(?:\r\n|(?<!\r)\n|[\r\x85\u2028\u2029])?\Z)"
CACHED = 1 << 16
DIGITS = Context(prec=800)


def java(pattern: str) -> re.Pattern:
    """A pattern of the expressions with Java's meaning: ASCII classes, case ignored for ASCII letters alone, ``$`` before a last line end too."""
    fold = pattern.startswith("(?i)")
    p, out, inside, i = pattern.removeprefix("(?i)"), [], False, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            kind = CLASSES.get(p[i + 1])
            out.append((kind if inside else f"[{kind}]") if kind else p[i : i + 2])
            i += 2
            continue
        if inside and fold and c.isalpha():
            span = p[i : i + 3] if p[i + 1] == "-" and p[i + 2].isalpha() else c
            out.append(span + span.swapcase())
            i += len(span)
            continue
        inside = c == "[" or inside and c != "]"
        out.append(f"[{c}{c.swapcase()}]" if fold and c.isalpha() and not inside else END if c == "$" and not inside else r"[^\n\r\x85\u2028\u2029]" if c == "." and not inside else c)
        i += 1
    return re.compile("".join(out))


WHITE, ALIAS_WHITE, BLANKS, KEY = re.compile(f"[{SPACE}]+"), re.compile(f"[:{SPACE}]+"), java(r"\s+"), re.compile("[^a-z0-9#]+")
LABEL, WORD_NUMBER, LEAD, NUMBER = java("^([BI])-(KEY|VALUE)$"), java(r"^[0-9.,]+$"), java(r"(?i)^(\d{1,2})\s*x?$"), re.compile(r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)")
SHORT_COMMA, SHORT_DOT, TWO_DOTS, MERGED = java(r"^[^,]{1,2},[^,]{1,2}$"), java(r"^[^.]{0,3}\.[0-9]{3}$"), java(r"\..*\."), java(r"(?<=\d) (?=\d{3}(?:\s|$))")
THOUSANDS = {m: java(rf"^-*[^\{m}-][^\{m}]{{0,2}}(\{m}[0-9]{{3}})+$") for m in ".,"}
LEADING_X, ENDS, LETTER, DIGIT, PRINTED = java("(?i)^x "), java(r"^[ -]+|[ -]+$"), re.compile("[A-Za-z]"), re.compile("[0-9]"), re.compile(r"[0-9A-Za-z$€£¥,.\-:/() ]+")
DATES, NUMBERS, SECTIONS, HEADERS = [java(p) for p in DATE_SHAPES], [java(p) for p in INVOICE_SHAPES], java(SECTION), java(HEADER_WORDS)
NO_VENDORS, COMPANIES, COUNTS, GRANDS, PLAINS, SUBS = (java(p) for p in (NO_VENDOR, COMPANY, COUNT_LINE, GRAND, PLAIN, SUB))
INVOICE, AMOUNT = java(r"(?i)^[A-Z0-9][A-Z0-9\-_/]*$"), java(r"^-?\d+(\.\d+)?$")
RULES = {f: java(p) for f, p in rules.PATTERNS.items()}
#: What a section line has somewhere: the letters that each of its patterns begins with.
SECTION_STARTS = sorted({m[1][:-1] if m[2] else m[1] for s in SECTION_SHAPES for m in re.finditer(r"(?:^|\|)\\b([a-z0-9]+)(\??)", s)})
MONTHS = "January February March April May June July August September October November December".lower().split()
_NAMES = {3: {m[:3]: i + 1 for i, m in enumerate(MONTHS)}, 4: {m: i + 1 for i, m in enumerate(MONTHS)}}
_YEAR, _PART = r"(?P<y>[0-9]{4}|\+[0-9]{5,6}|-[0-9]{4,6})", r"(?P<{}>[0-9]{{1,19}})"
_D, _M = _PART.format("d"), _PART.format("m")
LAYOUTS = [(re.compile(p), names) for p, names in (
    (f"{_YEAR}-{_M}-{_D}", None), (f"{_D}/{_M}/{_YEAR}", None), (f"{_M}/{_D}/{_YEAR}", None), (f"{_D}-{_M}-{_YEAR}", None), (f"{_YEAR}/{_M}/{_D}", None), (rf"{_D}\.{_M}\.{_YEAR}", None),
    (f"(?P<m>[A-Za-z]+) {_D} {_YEAR}", 3), (f"{_D} (?P<m>[A-Za-z]+) {_YEAR}", 3), (f"(?P<m>[A-Za-z]+) {_D} {_YEAR}", 4), (f"{_D} (?P<m>[A-Za-z]+) {_YEAR}", 4),
)]
ISO, ISO_ANY = re.compile("[0-9]{4}-[0-9]{2}-[0-9]{2}"), re.compile(f"{_YEAR}-(?P<m>[0-9]{{2}})-(?P<d>[0-9]{{2}})")


# ---------------------------------------------------------------- texts and numbers
def shown(v: float) -> Decimal:
    """The digits that Java shows a number with: Python's, except for whole ones from 2**53 to 2**63, of which it drops only those below a bit's worth. Beyond 2**63 the last digit can differ."""
    if not 2**53 <= abs(v) < 2**63:
        return Decimal(repr(v))
    whole = abs(int(v))
    spare = whole.bit_length() - 55
    unit = 10 ** (0 if spare < 4 else 1 if spare < 7 else 2)
    return Decimal((whole // unit + (whole % unit >= unit // 2 if unit > 1 else 0)) * unit * (1 if v > 0 else -1))


def decimals(v: float, n: int) -> str:
    """A number as Java's %.nf: the digits it is shown with, rounded half up."""
    if v != v or v in (float("inf"), float("-inf")):
        return "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
    if abs(v) < 1e15 and v == int(v):
        return f"{v:.{n}f}"
    return format(shown(v).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP, DIGITS), "f")


def number_text(v: float | None) -> str | None:
    if v is None:
        return None
    out = decimals(v, 6).rstrip("0")
    return out.removesuffix(".")


def amount_text(v: float | None) -> str | None:
    return None if v is None else decimals(v, 0 if abs(v) < 2**63 and v == int(v) else 2)


def java_double(v: float) -> str:
    if v != v or v in (float("inf"), float("-inf")):
        return f'"{decimals(v, 0)}"'
    if v == 0 or 1e-3 <= abs(v) < 1e7:
        return repr(v)
    sign, digits, exponent = shown(v).normalize(DIGITS).as_tuple()
    text = "".join(map(str, digits))
    return f"{'-' if sign else ''}{text[0]}.{text[1:] or '0'}E{exponent + len(text) - 1}"


ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
ESCAPED = {ord(k): v for k, v in {**{chr(i): f"\\u{i:04X}" for i in range(32)}, **ESCAPES}.items()}


def items_json(items: list[tuple] | None) -> str | None:
    if items is None:
        return None
    one = lambda d, q, p: ",".join(x for x in (None if d is None else f'"description":"{d.translate(ESCAPED)}"', None if q is None else f'"quantity":{java_double(q)}', None if p is None else f'"unit_price":{java_double(p)}') if x)
    return "[" + ",".join("{" + one(*x) + "}" for x in items) + "]"


def cleanup(text: str) -> str:
    return WHITE.sub(" ", text).strip(" ")


def words(text: str) -> list[str]:
    return [w for w in BLANKS.split(text) if w]


def number(text: str) -> float | None:
    return float(text) if NUMBER.fullmatch(text) else None


@lru_cache(CACHED)
def recovery_amount(t: str) -> float | None:
    dot, comma = "." in t, "," in t
    if dot and comma:
        t = t.replace(".", "").replace(",", ".") if t.rindex(",") > t.rindex(".") else t.replace(",", "")
    elif comma:
        t = t.replace(",", "." if SHORT_COMMA.search(t) else "")
    elif dot and (SHORT_DOT.search(t) or TWO_DOTS.search(t)):
        t = t.replace(".", "")
    return number(t)


def amounts_of(ws: list[str]) -> list[float]:
    return [v for v in (recovery_amount(w) for w in ws if WORD_NUMBER.search(w)) if v is not None]


@lru_cache(CACHED)
def fix_artifacts(text: str) -> str:
    if not PRINTED.fullmatch(text):
        return text
    digit = [c in "0123456789" for c in text]
    table = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5"}
    return "".join(table.get(c, c) if (i and digit[i - 1]) or (i + 1 < len(text) and digit[i + 1]) else c for i, c in enumerate(text))


def _date(m: re.Match, names: int | None = None) -> tuple[int, int, int] | None:
    y, d = int(m["y"]), int(m["d"])
    month = _NAMES[names].get(m["m"].lower(), 0) if names else int(m["m"])
    if not 1 <= month <= 12 or d < 1 or abs(y) > 290_000 or m["y"][0] == "+" and y <= 9999 or m["y"][0] == "-" and y == 0:
        return None
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return (y, month, d) if d <= (29 if leap and month == 2 else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]) else None


@lru_cache(CACHED)
def normalize_date(text: str) -> str | None:
    text = cleanup(text).replace(",", "")
    for layout, names in LAYOUTS:
        m = layout.fullmatch(text)
        got = m and _date(m, names)
        if got:
            return f"{'+' if got[0] > 9999 else '-' if got[0] < 0 else ''}{abs(got[0]):04d}-{got[1]:02d}-{got[2]:02d}"
    return None


@lru_cache(CACHED)
def is_iso_date(v: str | None) -> bool:
    return v is not None and bool(ISO.fullmatch(v)) and _date(ISO_ANY.fullmatch(v)) is not None


def day_of(v: str | None) -> tuple[int, int, int] | None:
    m = ISO_ANY.fullmatch(v) if v is not None else None
    return m and _date(m)


def plain_separators(t: str) -> str:
    kept = lambda mark: t.partition(mark)[0] + "." + t.partition(mark)[2].replace(mark, "")
    if "." in t and "," in t:
        return t.replace(".", "").replace(",", ".") if t.rindex(",") > t.rindex(".") else t.replace(",", "")
    if "." in t:
        return t.replace(".", "") if THOUSANDS["."].search(t) else kept(".") if t.count(".") > 1 else t
    return t.replace(",", "") if "," in t and THOUSANDS[","].search(t) else kept(",") if "," in t else t


BRACKETS, NO_DIGITS = java(r"^[()]+|[()]+$"), re.compile(r"[^0-9,.\-]")


@lru_cache(CACHED)
def normalize_currency(text: str) -> float | None:
    t = cleanup(text)
    v = number(plain_separators(NO_DIGITS.sub("", BRACKETS.sub("", t).strip(" "))))
    return -v if v is not None and len(t) > 1 and t[0] == "(" and t[-1] == ")" else v


def clean_description(text: str) -> str:
    return ENDS.sub("", LEADING_X.sub("", BLANKS.sub(" ", text).strip(" ")))


def is_quantity(v: float) -> bool:
    return 1 <= v <= 99 and v == int(v)


def resolve_price(n: list[float], q: float | None) -> tuple[float | None, float | None]:
    if not n or max(n) > 1e9:
        return q, None
    if len(n) == 1:
        return q, n[0]
    if q is not None:
        return q, next((v for v in n if not is_quantity(v)), n[0])
    if is_quantity(n[0]) != is_quantity(n[1]):
        return (n[0], n[1]) if is_quantity(n[0]) else (n[1], n[0])
    return q, n[1] if len(n) == 2 else n[0]


def is_section(text: str) -> bool:
    low = text.lower()
    return any(s in low for s in SECTION_STARTS) and bool(SECTIONS.search(text))


def first_hit(text: str, shapes: list[re.Pattern], group: int) -> str | None:
    return next((m[group] for m in (p.search(text) for p in shapes) if m and m[group]), None)


def mean(xs: list[float]) -> float | None:
    total = 0.0
    for x in xs:  # in order and plain, as Spark adds; sum() compensates
        total += x
    return total / len(xs) if xs else None


def bounded(c: float | None) -> float:
    return 0.55 if c is None else max(0.45, min(0.75, c))


@lru_cache(CACHED)
def looks_valid(field: str, value: str | None) -> bool:
    if not value:
        return False
    text = value.strip(" ")
    if field == "date":
        return any(p.search(text) for p in DATES)
    if field == "invoice_number":
        return bool(INVOICE.search(text))
    if field == "total_amount":
        return bool(amounts_of(words(MERGED.sub("", text))))
    return field != "vendor" or len(words(text)) >= 2 and not DIGIT.search(text)


# ---------------------------------------------------------------- the stages
class Chain:
    """The chain with its settings; ``fields_of`` gives a document's fields, flags and orphans."""

    def __init__(self, today: str, aliases: dict[str, str], threshold: float, drop: bool, with_recovery: bool, with_constraints: bool, repair: bool, tolerance: int = 18):
        self.aliases, self.threshold, self.drop, self.with_recovery, self.with_constraints, self.repair, self.tolerance = aliases, threshold, drop, with_recovery, with_constraints, repair, tolerance
        self.least = max(0.35, round(threshold - 0.2, 6))
        self.today = tuple(map(int, today.split("-")))
        self.lower = {a.lower() for a in aliases}
        self.parts: dict[str, list[list[str]]] = {}
        for p in sorted({a: a.split(" ") for a in aliases}.values(), key=len, reverse=True):
            self.parts.setdefault(p[0], []).append(p)
        self.by_length = sorted(aliases, key=len, reverse=False)[::-1]
        self.match_key = lru_cache(CACHED)(lambda text: None if text is None else KEY.sub("", text.lower()))
        self.canonical = lru_cache(CACHED)(self._canonical)

    def _canonical(self, text: str) -> str:
        t = ALIAS_WHITE.sub(" ", text).strip(" ").lower()
        if t in self.aliases:
            return self.aliases[t]
        return next((self.aliases[a] for a in self.by_length if a in t), None) or t.replace(" ", "_")

    def labels(self, texts: list[str | None]) -> list[str]:
        ks = [self.match_key(t) for t in texts]
        n, out, i, first, keyed = len(ks), [], 0, None, False
        while i < n:
            size = next((len(p) for p in self.parts.get(ks[i], ()) if ks[i : i + len(p)] == p), 0)
            if size:
                out += ["B-KEY", *["I-KEY"] * (size - 1)]
                i, keyed = i + size, True
                first = next((j for j in range(i, n) if ks[j]), None)
                continue
            out.append("O" if not keyed or ks[i] == "" else "B-VALUE" if i == first else "I-VALUE")
            i += 1
        return out

    @staticmethod
    def spans(texts: list, confidences: list, labels: list, categories: list | None) -> list[tuple[str, str, float]]:
        out, open_, kind, cat = [], False, "", ""
        for i, text in enumerate(texts):
            text = text.strip(" ") if text else text
            if not text:
                continue
            m = LABEL.search((labels[i] if labels[i] is not None else "O").strip(" ").upper())
            own = ((categories[i] or "").strip(" ")) if categories else ""
            if not m:
                open_, kind, cat = False, "", own
                continue
            goes_on = open_ and kind == m[2] and (own == cat if own else m[1] == "I")
            if not goes_on:
                out.append((m[2], [], []))
                cat = own
            open_, kind = True, m[2]
            out[-1][1].append(text)
            out[-1][2].append(0.0 if confidences[i] is None else float(confidences[i]))
        return [(k, " ".join(w), mean(c)) for k, w, c in out]

    def entities(self, spans: list) -> tuple[list[tuple], int]:
        """(field, value, confidence, code, items) of the keys, and how many values stand behind no key."""
        out, stray = [], 0
        for i, (kind, text, c) in enumerate(spans):
            if kind == "KEY":
                after = spans[i + 1] if i + 1 < len(spans) and spans[i + 1][0] == "VALUE" else None
                out.append((self.canonical(text), after[1], (c + after[2]) / 2, None, None) if after else (self.canonical(text), None, c, "missing_value", None))
            elif not i or spans[i - 1][0] != "KEY":
                stray += 1
        return out, stray

    def lines(self, tokens: list[tuple]) -> list[tuple[str, float]]:
        low = float("-inf")
        at = lambda x: (1 if x[0] is None else x[0], low if x[1] is None else x[1], low if x[2] is None else x[2], low if x[3] is None else x[3], x[4] or "", low if x[5] is None else x[5])
        out, least, page = [], None, None
        for x in sorted(tokens, key=at):
            p, y = 1 if x[0] is None else x[0], x[1]
            if out and y is not None and least is not None and p == page and abs(y - least) <= self.tolerance:
                out[-1].append(x)
                least = int(min(least, y))
            else:
                out.append([x])
                least = None if y is None else int(y)
            page = p
        make = lambda m: (" ".join(w for w in ((x[4] or "").strip(" ") for x in sorted(m, key=lambda x: at(x)[2:5])) if w), bounded(mean([float(x[5]) for x in m if x[5] is not None])))
        return [make(m) for m in out]

    def found(self, lines: list[tuple[str, float]]) -> list[tuple]:
        """What the lines give by patterns, without regard to the entities there are."""
        raw = [t for t, _ in lines]
        texts, whole, head = [t.strip(" ") for t in raw], "\n".join(raw), bounded(mean([c for _, c in lines[:3]]))
        merged = [MERGED.sub("", t) for t in texts]
        parts = [(t, t.lower(), words(t)) for t in merged]
        amounts = [amounts_of(w) for _, _, w in parts]
        dated = min(((("date" not in t.lower()), i, d) for i, (t, d) in enumerate((t, first_hit(t, DATES, 0)) for t in raw) if d), default=None)
        day = dated[2] if dated else first_hit(whole, DATES, 0)
        vendor = next((t for t in texts[:5] if self.is_company(t)), None)
        scored = []
        for i, (_, l, _) in enumerate(parts):  # noqa: E741
            if amounts[i] and not COUNTS.search(l):
                score, sure = (6.0, 0.78) if GRANDS.search(l) else (4.0, 0.72) if PLAINS.search(l) else (1.0, 0.55) if SUBS.search(l) else (None, None)
                if score:
                    scored.append((score + 0.2 * i, -i, amounts[i][-1], sure))
        every = [v for a in amounts for v in a]
        best = max(scored) if scored else (0, 0, next((v for v in reversed(every) if 1 <= v <= 50_000_000), None), 0.5)
        receipt = len(every) >= 2 and is_section(BLANKS.sub(" ", " ".join(raw)))
        number_ = first_hit(whole, NUMBERS, 1)
        items = self.items(parts, amounts) if receipt else []
        share = mean([0.55 if p is None else 0.68 if q is None else 0.78 for _, q, p in items])
        out = [("invoice_number", number_ and number_.strip(" "), head, None, None), ("date", day, head, None, None), ("vendor", vendor, head, None, None), ("total_amount", amount_text(best[2]), best[3], None, None)]
        if items:
            out.append(("line_items", items_json(items), max(0.5, min(0.78, share)), None, items))
        return [x for x in out if x[1] is not None]

    def is_company(self, t: str) -> bool:
        low = t.lower()
        return bool(t) and bool(COMPANIES.search(low)) and not NO_VENDORS.search(low) and low not in self.lower and len(DIGIT.findall(t)) <= 0.05 * len(t) and (len(words(t)) >= 2 or t == t.upper() and bool(LETTER.search(t)))

    @staticmethod
    def items(parts: list[tuple], amounts: list[list[float]]) -> list[tuple]:
        """(description, quantity, unit_price): items on one line, and a description followed by a line of numbers."""
        out, waits = [], ""
        for (t, low, ws), own in zip(parts, amounts, strict=True):
            if t == "":
                continue
            if is_section(t):
                waits = ""
                continue
            m = LEAD.search(ws[0]) if ws else None
            lead, rest = (float(m[1]), ws[1:]) if m else (None, ws)
            is_number = [bool(WORD_NUMBER.search(w)) for w in rest]
            described = clean_description(" ".join(w for w, n in zip(rest, is_number, strict=True) if not n and w.lower() not in ("x", "@")))
            if any(is_number) and (described != "" or lead):
                told = described or waits
                if told:
                    out.append((told, *resolve_price([v for v in (recovery_amount(w) for w, n in zip(rest, is_number, strict=True) if n) if v is not None], lead)))
                waits = ""
            elif own:
                q, p = resolve_price(own, None)
                if waits and p is not None:
                    out.append((waits, q, p))
                waits = ""
            elif LETTER.search(t) and not HEADERS.search(low):
                said = clean_description(t)
                waits = (f"{waits} {said}" if waits else said).strip(" ")
        return out

    @staticmethod
    def normal(e: tuple) -> tuple:
        field, value, c, code, items = e
        if items is not None:
            amount = lambda v: None if v is None else normalize_currency(number_text(v))
            items = [(cleanup(d), amount(q), amount(p)) for d, q, p in items]
            return field, items_json(items), c, code, items
        if value is None:
            return e
        text = cleanup(value)
        if field in rules.DATE_FIELDS:
            text = normalize_date(fix_artifacts(text))
        elif field in rules.CURRENCY_FIELDS:
            text = number_text(normalize_currency(fix_artifacts(text)))
        return field, text, c, "normalization_failed" if text is None else code, None

    @staticmethod
    def merged(field: str, own: list[tuple]) -> dict:
        def valid(v: str | None) -> bool:
            return is_iso_date(v) if field in rules.DATE_FIELDS else v is not None and bool(AMOUNT.search(v)) if field in rules.CURRENCY_FIELDS else True

        _, value, c, _, items = own[0]
        conflicts = 0
        for _, v, ec, _, more in own[1:]:
            if v == value:
                c = (c + ec) / 2
                continue
            conflicts += 1
            take = bool(v) if bool(v) != bool(value) else valid(v) if valid(v) != valid(value) else ec > c
            if take:
                value, c, items = v, ec, more
        said = [e[3] for e in own]
        codes = ["missing_value"] * said.count("missing_value") + ["normalization_failed"] * said.count("normalization_failed") + ["conflicting_values"] * conflicts
        return {"field": field, "value": value, "confidence": c, "valid": True, "codes": codes, "items": items, "absent": False}

    @staticmethod
    def validate(r: dict) -> None:
        v, field = r["value"], r["field"]
        if not v:
            more = ["missing_value"]
        else:
            more = ["regex_validation_failed"] if field in RULES and not RULES[field].search(v) else []
            if field in rules.DATE_FIELDS and not is_iso_date(v):
                more.append("invalid_date")
            if field in rules.CURRENCY_FIELDS and not AMOUNT.search(v):
                more.append("invalid_numeric")
        if more:
            r["codes"], r["valid"] = r["codes"] + more, False

    def constrain(self, records: list[dict]) -> list[str]:
        names = {r["field"] for r in records}
        absent = [f for f in rules.REQUIRED if f not in names]
        blank, late = [], []
        for r in records:
            more = []
            if r["field"] in rules.REQUIRED and not r["value"]:
                more.append("missing_required_field")
                blank.append(r["field"])
            if r["field"] in rules.DATE_FIELDS and (day_of(r["value"]) or self.today) > self.today:
                more.append("future_date")
                late.append(r["field"])
            if more:
                r["codes"], r["valid"] = r["codes"] + more, False
        flags = [f"missing_required_field:{f}" for f in absent + blank] + [f"future_date:{f}" for f in late]
        records += [{"field": f, "value": None, "confidence": 0.0, "valid": False, "codes": ["missing_required_field"], "items": None, "absent": True} for f in absent]

        items = next((r["items"] for r in records if r["field"] == "line_items"), None)
        amounts = [p * q for _, q, p in items or () if p is not None and q is not None]
        if not amounts:
            return flags
        sum_ = 0.0
        for v in amounts:
            sum_ += v
        if not abs(sum_) > rules.TOLERANCE:
            return flags
        told = next((r for r in records if r["field"] == "total_amount"), None)
        total = float(told["value"]) if told and told["value"] is not None else None
        if total is None:
            if told:
                cents = float(Decimal(repr(sum_)).quantize(Decimal("0.01"), ROUND_HALF_UP, DIGITS)) if abs(sum_) < 1e300 else sum_
                told |= {"value": number_text(cents), "confidence": 0.0, "valid": True, "absent": False}
            return [*flags, "corrected_total_amount_from_line_items"]
        if abs(total - sum_) > rules.TOLERANCE:
            open_ = [i for i, (_, q, p) in enumerate(items) if p is not None and q is None]
            price = items[open_[0]][2] if self.repair and len(open_) == 1 else None
            guess = float(round((total - sum_) / price)) if price and abs((total - sum_) / price) < 1e6 else None
            if guess is not None and 1 <= guess <= 99 and abs(sum_ + guess * price - total) <= rules.TOLERANCE:
                items = [(d, guess if i == open_[0] else q, p) for i, (d, q, p) in enumerate(items)]
                for r in records:
                    if r["field"] == "line_items":
                        r["items"], r["value"] = items, items_json(items)
                return [*flags, "corrected_quantity_derived_from_total"]
            told["codes"], told["valid"] = told["codes"] + ["line_items_total_mismatch"], False
            return [*flags, "line_items_total_mismatch"]
        return flags

    def checked(self, entities: list[tuple]) -> tuple[list[tuple], list[str]]:
        """The fields of entities, as (field, value, confidence, valid, status, codes, items), and the flags."""
        own: dict[str, list[tuple]] = {}
        for e in entities:
            own.setdefault(e[0], []).append(self.normal(e))
        records = [self.merged(f, es) for f, es in own.items()]
        for r in records:
            self.validate(r)
        flags = self.constrain(records) if self.with_constraints else []
        out = []
        for r in records:
            c = r["confidence"]
            low = c < self.threshold
            status = "missing" if r["absent"] else "kept" if not low else "dropped" if self.drop and c < self.least else "retained"
            out.append((r["field"], r["value"], c, r["valid"] and not low, status, r["codes"] + ["low_confidence"] if low and not r["absent"] else r["codes"], r["items"]))
        return out, flags

    def fields_of(self, pos: list, texts: list, confidences: list, x0: list, y0: list, pages: list, labels: list | None, categories: list | None) -> tuple[list[tuple], list[str], int]:
        entities, stray = self.entities(self.spans(texts, confidences, self.labels(texts) if labels is None else labels, categories))
        if self.with_recovery:
            lines = self.lines(list(zip(pages, y0, x0, pos, texts, confidences, strict=True)))
            good = {f for f, v, *_ in entities if f != "line_items" and looks_valid(f, v)}
            entities = entities + [e for e in self.found(lines) if e[0] not in good]
        return *self.checked(entities), stray


    # ------------------------------------------------------------ what a system shows
    def alias_pairs(self, texts: list, confidences: list) -> list[tuple]:
        """(field, text, confidence): a token that is an alias makes the next one the field's value."""
        out, waits = [], None
        for text, c in zip(texts, confidences, strict=True):
            text = text.strip(" ") if text else text
            if not text:
                continue
            if waits is not None:
                out.append((waits, text, None if c is None else float(c)))
                waits = None
            else:
                waits = self.aliases.get(text.lower().rstrip(":"))
        return out

    def output_of(self, system: str, checked: bool, texts: list, confidences: list, labels: list) -> tuple[list[tuple], list[tuple]]:
        """The entities as they are grouped, and (field, text, confidence) of what a system shows."""
        entities, _ = self.entities(self.spans(texts, confidences, labels, None))
        raw = [e[:3] for e in entities]
        if checked:
            return raw, [(f, v, c) for f, v, c, _, status, _, _ in self.checked(entities)[0] if status in ("kept", "retained")]
        return raw, list({x[0]: x for x in (self.alias_pairs(texts, confidences) if system == "ocr_only" else raw)}.values())


# ---------------------------------------------------------------- batches
def lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    """Lists as one array; ``None`` is a null list."""
    offsets, n = [], 0
    for v in values:
        offsets.append(None if v is None else n)
        n += len(v) if v is not None else 0
    return pa.ListArray.from_arrays(pa.array([*offsets, n], pa.int32()), pa.array([x for v in values if v is not None for x in v], kind) if not pa.types.is_struct(kind) else structs([x for v in values if v is not None for x in v], kind))


def structs(rows: list[tuple], kind: pa.StructType) -> pa.StructArray:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kind]
    return pa.StructArray.from_arrays([lists(list(c), f.type.value_type) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))


_ITEM = pa.struct([("description", pa.string()), ("quantity", pa.float64()), ("unit_price", pa.float64())])
_FIELD = pa.struct([("field", pa.string()), ("value", pa.string()), ("confidence", pa.float64()), ("valid", pa.bool_()), ("status", pa.string()), ("codes", pa.list_(pa.string())), ("items", pa.list_(_ITEM))])


def token_columns(t: pa.ListArray) -> tuple[list[int], dict[str, list]]:
    """Where each document's tokens begin and end, and the tokens' columns, of a list of structs."""
    flat = t.flatten()
    ends = [0]
    for n in t.value_lengths().to_pylist():
        ends.append(ends[-1] + (n or 0))
    return ends, {f.name: c.to_pylist() for f, c in zip(flat.type, flat.flatten(), strict=True)}


def apply(make: Callable[[], Chain], carried: list[str], batch: int = 1000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows with packed tokens t to rows of the carried columns, fields, flags and orphans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = make()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                b = whole.slice(start, batch)
                ends, c = token_columns(b.column("t"))
                part = lambda name, i, j: c[name][i:j] if name in c else None  # noqa: B023, E731
                got = []
                for i, j in zip(ends, ends[1:], strict=False):
                    n = [None] * (j - i)
                    got.append(chain.fields_of(part("pos", i, j), part("text", i, j), part("confidence", i, j), part("x0", i, j) or n, part("y0", i, j) or n, part("page_number", i, j) or n, part("label", i, j), part("category", i, j)))
                made = [lists([g[0] for g in got], _FIELD), lists([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32())]
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in carried], *made], names=[*carried, "fields", "flags", "orphans"])

    return run


_PAIR = pa.struct([("field", pa.string()), ("text", pa.string()), ("confidence", pa.float64())])


def apply_systems(make: Callable[[], Chain], carried: list[str], batch: int = 1000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows of systems (system, t, labels, checked) to rows of the carried columns, n_tokens, labels, raw and output. Null labels are made by aliases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = make()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                b = whole.slice(start, batch)
                ends, c = token_columns(b.column("t"))
                columns = [b.column(n).to_pylist() for n in ("system", "checked", "labels")]
                labels, got = [], []
                for i, j, system, checked, own in zip(ends, ends[1:], *columns, strict=False):
                    texts, confidences = c["text"][i:j], c["confidence"][i:j]
                    labels.append(chain.labels(texts) if own is None else own)
                    got.append(chain.output_of(system, checked, texts, confidences, labels[-1]))
                made = [pa.array([j - i for i, j in zip(ends, ends[1:], strict=False)], pa.int32()), lists(labels, pa.string()), *[lists([g[k] for g in got], _PAIR) for k in (0, 1)]]
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in carried], *made], names=[*carried, "n_tokens", "labels", "raw", "output"])

    return run
