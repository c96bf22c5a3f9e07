"""Small builders for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; merged projections would otherwise compute it at every use."""
    return F.get(F.transform(F.array(value), body), 0)


def settled(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows with these columns, each made once a row.

    Projections are merged where a column is named once, also where that is within a lambda, which then makes the
    column again for every element. A generator of one row isn't merged with anything.
    """
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def to_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(text: Column) -> Column:
    """A plain decimal number, else null. try_cast alone would also take '5d', '1e5' and 'NaN'."""
    return F.when(text.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), text.try_cast("double"))


def last_index(text: Column, mark: str) -> Column:
    """One-based place of the last mark, 0 without one."""
    back = F.instr(F.reverse(text), mark)
    return F.when(back == 0, 0).otherwise(F.length(text) - back + 1)


def scan(xs: Column, first: Column, step: Callable[[Column, Column], Column], state: str, emit: Callable[[Column], Column], out: str, block: int = 256) -> Column:
    """What ``emit`` makes of the state after each element, as one array.

    The results are gathered in blocks, so the copies that array_append makes stay short for long arrays.
    """
    kind = f"struct<s:{state},now:array<{out}>,done:array<array<{out}>>>"
    none, nothing = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def grow(a: Column, n: Column) -> Column:
        full = F.size(a["now"]) >= block
        now = F.when(full, F.array(emit(n).cast(out))).otherwise(F.array_append(a["now"], emit(n).cast(out)))
        done = F.when(full, F.array_append(a["done"], a["now"])).otherwise(a["done"])
        return F.struct(n.alias("s"), now.alias("now"), done.alias("done")).cast(kind)

    begin = F.struct(first.cast(state).alias("s"), none.alias("now"), nothing.alias("done")).cast(kind)
    return F.aggregate(xs, begin, lambda a, x: let(step(a["s"], x).cast(state), lambda n: grow(a, n)), lambda a: F.flatten(F.array_append(a["done"], a["now"])))


def runs(ids: Column, xs: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make(id, elements)`` of every run of equal ids; ``ids`` stands beside ``xs``."""
    starts = F.filter(F.transform(ids, lambda s, i: F.when((i == 0) | ~s.eqNullSafe(F.get(ids, i - 1)), i)), lambda i: i.isNotNull())
    return let(starts, lambda c: F.transform(c, lambda at, j: make(F.get(ids, at), F.slice(xs, at + 1, F.coalesce(F.get(c, j + 1), F.size(xs)) - at))))


def mean(xs: Column) -> Column:
    """The mean of an array of numbers; null of none."""
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, v: s + v) / F.size(xs))
