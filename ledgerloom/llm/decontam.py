"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

Texts become words (lower case, runs of letters and digits) and distinct five-word shingles. Benchmark
items are partitioned by size: class k holds items of 2**k ... 2**(k+1)-1 shingles. An item's sketch is
its bottom-m MinHash, m = u - ceil(t*u) + 1 for the class's largest size u, at most all shingles. A
document that contains at least the share t of an item's shingles misses fewer than m of them, so it must
contain a sketch value: no leak is lost, whatever the document's length. Documents with fewer shingles
than an item needs are pruned. Candidates are verified by exact shingle containment on the words.

An item under five words has one shingle, the whole of it; documents are searched for shingles of these widths
too, where such items exist. Items without words are never found. Null and empty texts contain nothing.
Repeated rows of a doc_id count by the best of them. Rows without doc_id are reported with a null id.
Rows of one item_id are one item with the shingles of all; a row without item_id is an item of its own,
reported with a null id.
Removal goes by text: rows with equal texts go or stay together, whatever their ids. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

WIDTH, THRESHOLD = 5, 0.8


def _words(col: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingles(words: Column, widths: list[int]) -> Column:
    """Distinct shingles of each width as texts, none where words are fewer."""
    none = F.array().cast("array<string>")
    of = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(none)
    return let(words, lambda w: F.array_distinct(F.concat(*[of(w, k) for k in widths])))


def _shingle_hashes(words: Column, widths: list[int]) -> Column:
    """Hashes of all shingles of each width from the words' hashes; no texts are built on the way."""
    none = F.array().cast("array<bigint>")
    of = lambda h, k: F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))).otherwise(none)
    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.concat(*[of(h, k) for k in widths]))


def _own(words: Column, width: int, of) -> Column:
    """``of`` the item's own width: the standard one, or all of a shorter item."""
    return let(F.filter(words, lambda x: x != ""), lambda w: reduce(lambda rest, k: F.when(F.size(w) == k, of(w, [k])).otherwise(rest), range(1, width), of(w, [width])))


def _item_sets(items: DataFrame, of_text: Column) -> DataFrame:
    """(key, item_id, s): the distinct elements of ``of_text`` over the rows of each item; key tells items without id apart."""
    key = F.when(F.col("item_id").isNull(), F.concat(F.lit("t"), F.sha2(F.coalesce("text", F.lit("")), 256))).otherwise(F.concat(F.lit("i"), F.col("item_id").cast("string")))
    rows = items.select(key.alias("key"), "item_id", of_text.alias("s"))
    return rows.groupBy("key", "item_id").agg(F.array_distinct(F.flatten(F.collect_set("s"))).alias("s"))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, item_id, n_item, shingle) rows, one per distinct shingle of an item."""
    sets = _item_sets(items, _own(_words(F.col("text")), width, _shingles))
    return sets.select("key", "item_id", F.size("s").cast("long").alias("n_item"), F.explode("s").alias("shingle"))


def sketches(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(h, key, need): the bottom-m MinHash values of every item, m by size class."""
    sets = _item_sets(items, _own(_words(F.col("text")), width, _shingle_hashes)).select("key", F.array_sort("s").alias("s")).filter("size(s) > 0")
    n = F.size("s")
    largest = F.pow(F.lit(2), F.floor(F.log2(n.cast("double"))) + 1) - 1
    m = F.least(n, (largest - F.ceil(largest * threshold - 1e-9) + 1).cast("int"))
    need = F.ceil(n * F.lit(threshold) - 1e-9).cast("long")
    return sets.select("key", need.alias("need"), F.explode(F.slice("s", F.lit(1), m)).alias("h"))


def item_widths(items: DataFrame, width: int = WIDTH) -> list[int]:
    """The shingle widths that occur, at most ``width`` numbers."""
    n = F.size(F.filter(_words(F.col("text")), lambda x: x != ""))
    return sorted({width} | {r["n"] for r in items.select(F.least(n, F.lit(width)).alias("n")).filter("n > 0").distinct().collect()})


def _found(docs: DataFrame, items: DataFrame, width: int, threshold: float, broadcast_rows: int) -> DataFrame:
    """(doc, key, item_id, n_shared, n_item) of (doc, text) rows that hold at least ``threshold`` of an item, the best row of each doc."""
    widths = item_widths(items, width)
    marks = cut(sketches(items, width, threshold))
    if marks.count() <= broadcast_rows:
        marks = F.broadcast(marks)
    # A struct keeps the array and its size together, so the generator reads one value computed once.
    hashed = docs.select("doc", F.explode(F.transform(F.array(_shingle_hashes(_words(F.col("text")), widths)), lambda s: F.struct(F.size(s).alias("n_doc"), s.alias("s")))).alias("d"))
    hits = hashed.select("doc", F.col("d.n_doc").alias("n_doc"), F.explode("d.s").alias("h")).join(marks, "h").filter("n_doc >= need")
    pairs = cut(hits.select("doc", "key").distinct())
    # Exact check, on the texts of candidates only.
    found = pairs.select(F.col("doc").alias("c_doc")).distinct()
    if pairs.count() <= broadcast_rows:
        found = F.broadcast(found)
    texts = docs.join(found, F.col("doc").eqNullSafe(F.col("c_doc")), "left_semi").withColumn("row", F.monotonically_increasing_id())
    words = texts.select("doc", "row", F.explode(_shingles(_words(F.col("text")), widths)).alias("shingle"))
    wanted = item_shingles(items, width)
    shared = words.join(wanted, "shingle").groupBy("doc", "row", "key", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    best = shared.groupBy("doc", "key", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    best = best.join(pairs.select(F.col("doc").alias("c_doc"), F.col("key").alias("c_key")), F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("key") == F.col("c_key")), "left_semi")
    # Whole-number comparison, so that 4 of 5 counts as 0.8.
    return best.filter(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for all pairs with containment of at least ``threshold``.

    The sketches are broadcast up to ``broadcast_rows`` rows (counted first, 24 bytes each); beyond that
    documents' shingle hashes are shuffled. Candidates are treated alike.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    best = _found(docs, items.select(F.col("item_id").cast("long").alias("item_id"), "text"), width, threshold, broadcast_rows)
    return best.select(F.col("doc").alias("doc_id"), "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` whose text contains no item; hashes of the texts to drop are broadcast up to a counted bound."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = _found(docs.select(key.alias("doc"), "text"), items.select(F.col("item_id").cast("long").alias("item_id"), "text"), width, threshold, broadcast_rows)
    drop = cut(found.select(F.col("doc").alias("__drop")).distinct())
    side = F.broadcast(drop) if drop.count() <= broadcast_rows else drop
    return docs.join(side, key == F.col("__drop"), "left_anti")


#: The same result in SQL for DuckDB, over the views documents and benchmark.
ORACLE_SQL = r"""
WITH iw AS (SELECT item_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark),
 ik AS (SELECT item_id, w, least(len(w), 5) AS k FROM iw WHERE len(w) >= 1),
 ish AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM ik)),
 n AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id),
 dw AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents),
 dsh AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k))
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM dsh JOIN ish USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(n_item * 0.8 - 1e-9)
"""
