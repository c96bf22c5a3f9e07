"""Line deduplication by levelled sorted runs of line hashes.

A line's key is the line stripped of white space at both ends, A-Z lower-cased; it is held as a 128-bit hash. The
store holds runs: tables of (hash, number of documents), sorted and bucketed by hash, in levels. Each new batch of
documents counts its keys, merge-anti-joins the keys that the store already knows to be repeated, and adds the
others as a run of its own to the lowest level. A level with ``fan`` runs is compacted into one run of the next:
counts add up, and keys that reach ``min_docs`` leave for the known keys. ``finish`` compacts all levels, after
which the known keys are exactly those of ``min_docs`` documents and more. With ``min_docs`` 1 a key is known
once any earlier batch holds it, which makes ``new_lines`` the incremental form: first occurrences stay.

Tasks count their lines before anything is shuffled, so a line that every document holds is one row of each task.
Known keys up to ``broadcast_keys`` (counted) are sent to the tasks as a sorted array; beyond that, distinct texts'
distinct hashes are joined with them, salted, and the results joined by the text's hash.

Defined cases: a null or empty text is one empty line; keys under ``min_chars`` code points are never dropped; a
text whose lines all go is the empty text; every row is a document, so repeated rows count apart; an empty table
gives none; extra columns are ignored unless named in ``keep``. Two keys share a hash once in 2**128 pairs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import let, ship, stored

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_DOCS, MIN_CHARS, BATCHES, FAN, BROADCAST_KEYS = 10, 1, 4, 2, 2_000_000
#: FAN must be two or more.
#: Distinct hashes a task holds before their counts leave it.
HELD = 200_000
SALTS = 16


def line_hashes(text: str | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """A text's lines in UTF-8, and the hash of each line's key; none for keys that are too short."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys = [line.strip(SPACE).lower() for line in lines]  # of bytes: A-Z alone
    if min_chars > 1:
        return lines, [xxhash.xxh3_128_digest(k) if len(k.decode("utf-8", "replace")) >= min_chars else None for k in keys]
    return lines, [xxhash.xxh3_128_digest(k) if len(k) >= min_chars else None for k in keys]


def count_lines(docs: DataFrame, batch: Column, min_chars: int = MIN_CHARS) -> DataFrame:
    """(batch, hash, n_docs): how many of the batch's documents hold a key; counted in the tasks, then summed by whoever reads."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def leave():
            keys = list(held)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.int32()), pa.array([k[1] for k in part], pa.binary()), pa.array([held[k] for k in part], pa.int64())], names=["batch", "hash", "n_docs"])
            held.clear()

        for rows in batches:
            for no, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                held.update((no, h) for h in set(line_hashes(text.as_py(), min_chars)[1]) - {None})
                if len(held) >= HELD:
                    yield from leave()
        yield from leave()

    return docs.select(batch.cast("int").alias("batch"), "text").mapInArrow(run, "batch int, hash binary, n_docs long")


class LineRuns:
    """The store: bucketed, sorted tables of hashes in levels, and the known keys, under one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, min_docs: int = MIN_DOCS, fan: int = FAN, buckets: int | None = None):
        self.spark, self.min_docs, self.fan = spark, min_docs, fan
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = f"{folder or checkpoint_dir(spark)}/{self.name}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.known_runs: list[str] = []
        self.written = 0

    def write(self, counts: DataFrame) -> str:
        """A sorted run. The rows lie in the buckets' partitions already, so a bucket is one file."""
        self.written += 1
        name = f"{self.name}_{self.written}"
        counts.select("hash", "n_docs").write.option("path", f"{self.folder}/{self.written}").bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(name)
        return name

    def merged(self, names: list[str]) -> DataFrame:
        """The runs' rows with counts added up: merge joins of the buckets, without a shuffle. (A union of bucketed tables isn't grouped rightly by Spark 4.1.)"""
        if not names:
            return self.spark.createDataFrame([], "hash binary, n_docs long")
        out, zero = self.spark.table(names[0]), F.lit(0).cast("long")
        for name in names[1:]:
            both = out.join(self.spark.table(name).withColumnRenamed("n_docs", "more").hint("merge"), "hash", "full_outer")
            out = both.select("hash", (F.coalesce("n_docs", zero) + F.coalesce("more", zero)).alias("n_docs"))
        return out

    def drop(self, names: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name.rpartition('_')[2]}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    @property
    def telling(self) -> list[str]:
        """The runs whose keys are known to stand in ``min_docs`` documents; for one document those are all."""
        return self.known_runs + ([n for level in self.levels for n in level] if self.min_docs <= 1 else [])

    @property
    def known(self) -> DataFrame:
        """Distinct hashes of the known keys."""
        return self.merged(self.telling).select("hash")

    def add(self, counts: DataFrame) -> None:
        """A batch: counts by hash, less the known keys, as a run of the lowest level."""
        own = counts.repartition(self.buckets, "hash").groupBy("hash").agg(F.sum("n_docs").alias("n_docs"))
        for name in self.telling:
            own = own.join(self.spark.table(name).select("hash").hint("merge"), "hash", "left_anti")
        self.levels = self.levels or [[]]
        self.levels[0].append(self.write(own))
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan:
            self.compact([level], level + 1)
            level += 1
        if len(self.known_runs) >= 2 * self.fan:
            old, self.known_runs = self.known_runs, [self.write(self.merged(self.known_runs))]
            self.drop(old)

    def compact(self, levels: list[int], into: int) -> None:
        """The runs of some levels as one run of the level ``into``; keys that have reached the bound join the known ones."""
        names = [n for k in levels for n in self.levels[k]]
        rest = self.write(self.merged(names))
        if self.min_docs > 1:
            whole = self.spark.table(rest)
            names.append(rest)
            self.known_runs.append(self.write(whole.filter(F.col("n_docs") >= self.min_docs)))
            rest = self.write(whole.filter(F.col("n_docs") < self.min_docs))
        for k in levels:
            self.levels[k] = []
        while len(self.levels) <= into:
            self.levels.append([])
        self.levels[into].append(rest)
        self.drop(names)

    def finish(self) -> DataFrame:
        """All levels compacted: the known keys are complete."""
        if any(self.levels):
            self.compact(list(range(len(self.levels))), len(self.levels))
        return self.known

    def remove(self) -> None:
        self.drop([*self.known_runs, *(n for level in self.levels for n in level)])
        self.levels, self.known_runs = [], []


def drop_lines(docs: DataFrame, known: DataFrame, keep: tuple[str, ...] = (), min_chars: int = MIN_CHARS, keep_text: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Every document without the lines whose key's hash is among ``known`` (distinct): doc_id, n_lines, n_dropped, kept_sha256, and the text on demand."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(*(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), "doc_id", "text")
    near = known.count() <= broadcast_keys
    if near:
        sent = spark.sparkContext.broadcast(np.sort(np.array([*known.toArrow().column("hash").to_pylist()], "S16")))
        base = base.withColumn("drop", F.lit(None).cast("array<binary>"))
    else:
        sent = None
        base = base.withColumn("text_key", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
        base = base.join(known_of_texts(base, known, min_chars), "text_key", "left").drop("text_key")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at, size = [], 0, 0

            def pack(rows, start, batch=batch):
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
                return pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, len(rows)) for i in range(n + 1)), *cols], names=[*batch.schema.names[: n + 1], *["n_lines", "n_dropped", "kept_sha256", "kept_text"][: len(cols)]])

            for i in range(batch.num_rows):
                lines, hashes = line_hashes(batch.column(n + 1)[i].as_py(), min_chars)
                own = {h for h in hashes if h is not None}
                gone = among(own, sent.value) if sent is not None else set(batch.column(n + 2)[i].as_py() or ())
                kept = b"\n".join(line for line, h in zip(lines, hashes, strict=True) if h not in gone) if gone else b"\n".join(lines)
                dropped = sum(h in gone for h in hashes) if gone else 0
                out.append((len(lines), dropped, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] if keep_text else [])))
                size += len(kept) if keep_text else 0
                if size > 1 << 24:
                    yield pack(out, at)
                    out, at, size = [], i + 1, 0
            if out:
                yield pack(out, at)

    kinds = [f"keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "n_lines long", "n_dropped long", "kept_sha256 string"] + ["text string"] * keep_text
    out = base.mapInArrow(run, ", ".join(kinds).replace("text string", "kept_text string"))
    return out.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "doc_id", "n_lines", "n_dropped", "kept_sha256", *([F.col("kept_text").alias("text")] if keep_text else []))


def among(own: set[bytes], known: np.ndarray) -> set[bytes]:
    """The hashes of ``own`` that a sorted array holds."""
    if not own or not len(known):
        return set()
    order = list(own)
    wanted = np.array(order, "S16")  # equal lengths, so that the type's blindness to final zero bytes can't make two hashes equal
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return {order[i] for i in np.flatnonzero(known[at] == wanted).tolist()}


def known_of_texts(base: DataFrame, known: DataFrame, min_chars: int) -> DataFrame:
    """(text_key, drop): the known hashes of every distinct text, by a salted join; a hash of many texts is dealt to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = list(set(line_hashes(text.as_py(), min_chars)[1]) - {None})
                for at in range(0, len(own), 50_000):
                    part = own[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array(part, pa.binary())], names=["text_key", "hash"])

    held = base.select("text_key", "text").mapInArrow(run, "text_key string, hash binary").dropDuplicates(["text_key", "hash"])
    held = held.withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(SALTS)))
    dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return held.join(dealt, ["hash", "salt"]).groupBy("text_key").agg(F.collect_list("hash").alias("drop"))


def drop_repeated(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fan: int = FAN, **more) -> DataFrame:
    """Drop, in every document, the lines whose key stands in ``min_docs`` documents or more.

    The documents go through the store in ``batches`` parts by a hash of the id; counts are exact whatever their number.
    """
    spark = docs.sparkSession
    part = let(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), lambda h: F.pmod(h, F.lit(batches)))
    counted = stored(count_lines(docs, part, min_chars))
    runs = LineRuns(spark, min_docs=min_docs, fan=fan)
    for k in range(batches):
        runs.add(counted.filter(F.col("batch") == k))
    known = stored(runs.finish())
    runs.remove()
    return drop_lines(docs, known, min_chars=min_chars, **more)


def new_lines(batch: DataFrame, runs: LineRuns, min_chars: int = MIN_CHARS, **more) -> DataFrame:
    """A batch without the lines that earlier batches hold; its own are then in the store, one made with ``min_docs`` 1. Lines repeated within the batch stay."""
    out = stored(drop_lines(batch, runs.known, min_chars=min_chars, **more))
    runs.add(count_lines(batch, F.lit(0), min_chars))
    return out


ORACLE_SQL = """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key from l),
f as (select line_key as gone from k where line_key <> '' group by line_key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where gone is null), '')) as kept_sha256 from k left join f on line_key = gone group by doc_id
"""
