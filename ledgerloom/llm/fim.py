"""Fill-in-the-middle rewriting of documents by a parallel automaton scan.

A text is cut into units (a word with the white space before it, or the white space that ends the text) by a
three-state automaton over the classes "white space" and "other". A chunk of a text emits its state-transition
function (the state it ends in for every state it may start in) and the number of units that end in it for
every start state; such functions compose associatively, so the state and the number of units before every
chunk follow from a prefix scan in two levels (runs of chunks, then a document's runs), and a cut after k units
is selected in the one chunk that holds the k-th end.

Documents up to ``chunk_chars`` code points are one chunk, whose scan from the first state is the whole
composition; it stays in the task that reads the row. Longer ones are dealt out by chunk: text goes once to the
tasks that scan it, and after that only functions, counts and two-byte end places move. Sentinels, order of the
parts and random numbers are parameters; numbers come from a hash of seed and doc_id, so they don't depend on
the partitioning.

Defined cases: a null text is empty; empty texts and texts that hold a sentinel stay plain; a null doc_id is
hashed as the empty string; repeated rows give repeated results; texts of one unit or of white space alone are
cut like any other; an empty table gives none; extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, ship, stored

#: States, and by [state][class] whether a unit ends before the symbol. Class 0: other, 1: white space.
BEGIN, SPACE, WORD = 0, 1, 2
AFTER = np.array([WORD, SPACE])  # the state after a symbol, whatever came before it
ENDS = np.array([[False, False], [False, False], [False, True]])
#: Units that end with the text, by last state.
AT_END = np.array([0, 1, 1])

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK_CHARS, RUN = 1 << 16, 1024


# ---------------------------------------------------------------- the automaton
def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return ((codes == 32) | ((codes >= 9) & (codes <= 13))).astype(np.int8)


def scan(symbols: np.ndarray, state: int) -> tuple[int, np.ndarray]:
    """The last state, and the places where units end, for one start state."""
    if not len(symbols):
        return state, np.zeros(0, np.int64)
    before = np.concatenate(([state], AFTER[symbols[:-1]]))
    return int(AFTER[symbols[-1]]), np.flatnonzero(ENDS[before, symbols])


def transition(symbols: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """(last state, units ended) for every start state, and the ends that don't depend on it.

    Only a chunk's first symbol meets the start state; an end at place 0 is thus added by whoever knows it.
    """
    _, inner = scan(symbols, BEGIN)
    to = [scan(symbols[-1:], s)[0] for s in (BEGIN, SPACE, WORD)]
    counts = [len(inner) + int(len(symbols) > 0 and ENDS[s, symbols[0]]) for s in (BEGIN, SPACE, WORD)]
    return to, counts, inner


def compose(first: tuple, second: tuple) -> tuple:
    """The function of two neighbouring chunks: (to, counts, size)."""
    to, counts, size = first
    return [second[0][s] for s in to], [c + second[1][s] for s, c in zip(to, counts, strict=True)], size + second[2]


# ---------------------------------------------------------------- parts
def draw(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th eight-digit group of the hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def join_parts(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restore(form: str, output: str) -> str:
    """The text of an output. Sentinels don't overlap themselves or each other, so their first places are the true ones."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, seed: int = 42, plain_percent: int = 50, spm_percent: int = 80, keep: tuple[str, ...] = (), keep_output: bool = False, chunk_chars: int = CHUNK_CHARS, run: int = RUN, broadcast_rows: int = 100_000) -> DataFrame:
    """Every document in its form, with the digests of the output and of the text rebuilt from it; the output itself on demand.

    A text is plain if its third number modulo 100 is ``plain_percent`` or more.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *(draw(F.col("doc_id").cast("long"), seed, k).alias(f"h{k}") for k in (1, 2, 3, 4)))
    long = F.char_length("text") > chunk_chars
    small = base.filter(~long).withColumns({c: F.lit(None).cast("long") for c in ("n", "low", "high")})
    giant = base.filter(long).withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"), 256))
    cuts = stored(giant_cuts(giant, chunk_chars, run))
    if cuts.count() <= broadcast_rows:
        cuts = F.broadcast(cuts)
    rows = small.unionByName(giant.join(cuts, "key").drop("key"))
    kinds = [f"keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["doc_id long", "n long", "form string", "prefix_chars long", "middle_chars long", "output_sha256 string", "restored_sha256 string"] + ["output string"] * keep_output
    out = rows.mapInArrow(lambda batches: assemble(batches, len(keep), plain_percent, spm_percent, keep_output), ", ".join(kinds))
    return out.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), *out.columns[len(keep) :])


def assemble(batches: Iterator[pa.RecordBatch], kept: int, plain_percent: int, spm_percent: int, keep_output: bool) -> Iterator[pa.RecordBatch]:
    """Find the cuts of one-chunk texts, take those found for longer ones, and write the parts in their order."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        out, at, size = [], 0, 0

        def pack(out, start, batch=batch):
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=False)]
            names = [*batch.schema.names[: kept + 1], "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
            return pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, len(out)) for i in range(kept + 1)), *made], names=names[: kept + 1 + len(made)])

        for i in range(batch.num_rows):
            text, n, low, high, *h = (columns[c][i].as_py() for c in ("text", "n", "low", "high", "h1", "h2", "h3", "h4"))
            if n is None:
                state, ends = scan(classes(text), BEGIN)
                n = len(ends) + int(AT_END[state])
                low, high = (place(int(k), n, ends, len(text)) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
            if not text or h[2] % 100 >= plain_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                form, output, parts = "plain", text, (None, None)
            else:
                form = "spm" if h[3] % 100 < spm_percent else "psm"
                output, parts = join_parts(form, text[:low], text[low:high], text[high:]), (low, high - low)
            out.append((n, form, *parts, sha(output), sha(restore(form, output)), *([output] if keep_output else [])))
            size += len(output) if keep_output else 0
            if size > 1 << 24:
                yield pack(out, at)
                out, at, size = [], i + 1, 0
        if out:
            yield pack(out, at)


TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]


def place(k: int, n: int, ends: np.ndarray, size: int) -> int:
    """The code points before the end of the k-th unit."""
    return 0 if k == 0 else size if k == n else int(ends[k - 1])


# ---------------------------------------------------------------- documents of many chunks
def giant_cuts(giant: DataFrame, chunk_chars: int, run: int) -> DataFrame:
    """key, n, low and high of every text of many chunks."""

    def cut():
        def step(cols):
            for key, text, h1, h2 in zip(*cols, strict=True):
                for chunk, at in enumerate(range(0, len(text), chunk_chars)):
                    yield key, chunk, text[at : at + chunk_chars], h1, h2

        return step

    def summarise():
        def step(cols):
            for key, chunk, piece, h1, h2 in zip(*cols, strict=True):
                to, counts, inner = transition(classes(piece))
                yield key, chunk, len(piece), to, counts, inner.astype("<u4").tobytes(), h1, h2

        return step

    pieces = map_rows(giant.select("key", "text", "h1", "h2"), "key string, chunk long, piece string, h1 long, h2 long", cut, rows_per_batch=64)
    found = map_rows(pieces.repartition("key", "chunk"), "key string, chunk long, size long, to array<int>, counts array<long>, ends binary, h1 long, h2 long", summarise, rows_per_batch=64)
    chunks = stored(found.dropDuplicates(["key", "chunk"]))

    # Level one: the function of each run of chunks; level two: what is entered into each run.
    function = F.struct("at", "to", "counts", "size")
    runs = chunks.withColumn("at", F.col("chunk")).groupBy("key", F.floor(F.col("chunk") / run).alias("run")).agg(F.sort_array(F.collect_list(function)).alias("parts"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))

    def fold():
        def step(cols):
            for key, no, parts, h1, h2 in zip(*cols, strict=True):
                whole = ([BEGIN, SPACE, WORD], [0, 0, 0], 0)
                for p in parts:
                    whole = compose(whole, (p["to"], p["counts"], p["size"]))
                yield key, no, *whole, h1, h2

        return step

    def enter():
        def step(cols):
            for key, parts, h1, h2 in zip(*cols, strict=True):
                state, units, size, entries = BEGIN, 0, 0, []
                for p in parts:
                    entries.append((p["at"], state, units, size))
                    state, units, size = p["to"][state], units + p["counts"][state], size + p["size"]
                n = units + int(AT_END[state])
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                for no, *entry in entries:
                    yield key, no, *entry, n, size, low, high

        return step

    folded = map_rows(runs, "key string, at long, to array<int>, counts array<long>, size long, h1 long, h2 long", fold)
    entered = map_rows(folded.groupBy("key").agg(F.sort_array(F.collect_list(function)).alias("parts"), F.first("h1").alias("h1"), F.first("h2").alias("h2")), "key string, run long, state int, units long, before long, n long, length long, low long, high long", enter)

    def select():
        def step(cols):
            for key, parts, state, units, before, n, length, low, high in zip(*cols, strict=True):
                for p in parts:
                    ended = p["counts"][state]
                    for k in {low, high}:
                        if units < k <= units + ended:
                            yield key, p["at"], state, k, k - units, before
                    state, units, before = p["to"][state], units + ended, before + p["size"]

        return step

    joined = runs.select("key", "run", "parts").join(entered, ["key", "run"]).select("key", "parts", "state", "units", "before", "n", "length", "low", "high")
    chosen = map_rows(joined, "key string, chunk long, state int, k long, rank long, before long", select)

    def locate():
        def step(cols):
            for key, state, k, rank, before, counts, ends in zip(*cols, strict=True):
                inner = np.frombuffer(ends, "<u4")
                first = counts[state] - len(inner)  # 1 where a unit ends at place 0 for this start state
                yield key, k, before + (0 if rank <= first else int(inner[rank - first - 1]))

        return step

    ends = chosen.join(chunks.select("key", "chunk", "counts", "ends"), ["key", "chunk"]).select("key", "state", "k", "rank", "before", "counts", "ends")
    places = map_rows(ends, "key string, k long, place long", locate).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("k", "place"))).alias("places"))
    totals = entered.groupBy("key").agg(F.first("n").alias("n"), F.first("length").alias("length"), F.first("low").alias("k1"), F.first("high").alias("k2")).join(places, "key", "left")
    # A cut without an end inside the text is its start, or its end.
    at = lambda k: F.coalesce(F.try_element_at("places", F.col(k)), F.when(F.col(k) > 0, F.col("length")).otherwise(0))
    return totals.select("key", "n", at("k1").alias("low"), at("k2").alias("high"))


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || doc_id::varchar) as h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as t from documents),
r as (select *, len(t)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as k1, greatest(h1 % (n + 1), h2 % (n + 1)) as k2,
 case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from r),
p as (select doc_id, n, text, form, array_to_string(t[1:k1], '') as pre, array_to_string(t[k1 + 1:k2], '') as mid, array_to_string(t[k2 + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
 sha256(text) as restored_sha256 from p
"""
