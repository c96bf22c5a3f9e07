"""Token counts by a separator scan over flat, unindexed token files.

A flat file is a run of little-endian token ids in which every document is followed by the
end-of-document id; there is no index. It is read in blocks of bytes. Each block is searched for the
separator with one vectorised comparison; a block yields the lengths of the documents that end in it,
its number of separators, and the tokens after its last one. Boundaries are stitched across blocks by a
prefix scan over the block summaries: the separators before a block number its documents, and the tails
since the last block with a separator lengthen its first document. The scan has two levels (runs of
``run`` blocks, then the runs), so no task holds a long file's summaries.

``scan_blocks`` takes (file, block, data) rows; ``read_blocks`` makes them from real flat files and
``pack_documents`` from a table of texts, with a public tokenizer.

Defined cases: null and empty texts have 0 tokens; tokens after the last separator are a document without
end, reported with ended = false; a separator's text inside a document is encoded as plain text; repeated
rows are separate documents; empty files and tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, ship

#: The free id of the 50k vocabulary, and the files' integer type.
SEPARATOR, ID_TYPE = 50256, "<u2"
BLOCK_BYTES = 1 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoding(vocabulary: bytes):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack_documents(docs: DataFrame, tokenizer: str | None = None, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES, docs_per_file: int = 20000) -> tuple[DataFrame, DataFrame]:
    """Encode texts into flat files: (file, block, data) rows, and the (file, ordinal, doc_id) order of the documents.

    A task writes a new file after ``docs_per_file`` documents. Both results come from one pass whose
    rows are checkpointed in the shared folder. The vocabulary file is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(open(tokenizer or tokenizer_path(), "rb").read())

    def run(batches):
        from pyspark import TaskContext

        encode = load_encoding(vocabulary.value).encode_ordinary
        file, ordinal, block, held, held_bytes = TaskContext.get().partitionId() << 32, 0, 0, [], 0
        end = np.array([separator], ID_TYPE).tobytes()

        def blocks(data, file, block):
            return pa.RecordBatch.from_pydict({"file": [file], "block": [block], "data": [data], "ordinals": [None], "doc_ids": [None]}, schema=schema)

        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("ordinals", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
        for batch in batches:
            order, first = [], ordinal
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ordinal and ordinal % docs_per_file == 0:
                    yield pa.RecordBatch.from_pydict({"file": [file], "block": [None], "data": [None], "ordinals": [first], "doc_ids": [order]}, schema=schema)
                    if held:
                        yield blocks(b"".join(held), file, block)
                    file, ordinal, block, held, held_bytes, order, first = file + 1, 0, 0, [], 0, [], 0
                ids = np.array(encode(text or ""), ID_TYPE).tobytes() + end
                held.append(ids)
                held_bytes += len(ids)
                order.append(doc_id)
                ordinal += 1
                if held_bytes >= block_bytes:
                    data = b"".join(held)
                    cutoff = len(data) // block_bytes * block_bytes
                    for at in range(0, cutoff, block_bytes):
                        yield blocks(data[at : at + block_bytes], file, block)
                        block += 1
                    held, held_bytes = ([data[cutoff:]] if cutoff < len(data) else []), len(data) - cutoff
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [None], "data": [None], "ordinals": [first], "doc_ids": [order]}, schema=schema)
        if held:
            yield blocks(b"".join(held), file, block)

    packed = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file long, block long, data binary, ordinals long, doc_ids array<long>"))
    flat = packed.filter("block is not null").select("file", "block", "data")
    order = packed.filter("block is null").select("file", "ordinals", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("ordinals") + F.col("i")).alias("ordinal"), "doc_id")
    return flat, order


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, range_blocks: int = 128) -> DataFrame:
    """Blocks of real flat files of any size. Spark lists the files without their contents; a task reads a range of ``range_blocks`` blocks of one.

    Files lie where the tasks' machines or Arrow's file systems reach them.
    """
    from ..sources.headers import open_ranges

    ship(spark)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    width = range_blocks * block_bytes
    ranges = listed.select(F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(width).cast("long"))).alias("at"))
    n = listed.agg(F.sum(F.ceil(F.col("length") / width))).first()[0] or 1

    def run(batches):
        for batch in batches:
            for name, length, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read = open_ranges(name)
                for k in range(range_blocks):
                    begin = at + k * block_bytes
                    if begin >= length:
                        break
                    data = read(begin, min(block_bytes, length - begin))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([begin // block_bytes], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    return ranges.repartition(int(min(n, 100_000)), "file", "at").mapInArrow(run, "file string, block long, data binary")


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, id_type: str = ID_TYPE, run: int = 4096) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document, start in tokens from the file's first."""
    ship(blocks.sparkSession)
    size = np.dtype(id_type).itemsize
    kind = blocks.schema["file"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_buffer()
                ids = np.frombuffer(data, id_type, count=data.size // size)
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(np.concatenate(([-1], ends))) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([ids.size], pa.int64()), pa.array([ends.size], pa.int64()), pa.array([ids.size - 1 - int(ends[-1]) if ends.size else ids.size], pa.int64()), pa.array([lengths.astype(np.int64)], pa.list_(pa.int64())), pa.array([(ends - lengths).astype(np.int64)], pa.list_(pa.int64()))],
                    names=["file", "block", "size", "seps", "tail", "lengths", "begins"],
                )

    found = cut(blocks.select("file", "block", "data").mapInArrow(scan, f"file {kind}, block long, size long, seps long, tail long, lengths array<long>, begins array<long>"))
    base = found.select("file", "block", "size", "seps", "tail", F.floor(F.col("block") / run).alias("run"))
    # Segmented scan within a run: what precedes each block.
    inner = W.partitionBy("file", "run").orderBy("block")
    before = inner.rowsBetween(W.unboundedPreceding, -1)
    marked = base.withColumn("size_in", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("seps_in", F.coalesce(F.sum("seps").over(before), F.lit(0))).withColumn("tails_in", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    # Tails since the last block with a separator: a running sum, less its value before that block.
    marked = marked.withColumn("drop_in", F.last(F.when(F.col("seps") > 0, F.col("tails_in")), ignorenulls=True).over(before))
    local = marked.withColumn("carry_in", F.col("tails_in") - F.coalesce("drop_in", F.lit(0))).withColumn("cut_in", F.col("seps_in") > 0)
    runs = local.groupBy("file", "run").agg(F.sum("size").alias("r_size"), F.sum("seps").alias("r_seps"), F.max_by(F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry_in") + F.col("tail")), "block").alias("r_tail"), F.max("block").alias("r_last"))
    outer = W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("o_size", F.coalesce(F.sum("r_size").over(outer), F.lit(0))).withColumn("o_seps", F.coalesce(F.sum("r_seps").over(outer), F.lit(0))).withColumn("o_tails", F.coalesce(F.sum("r_tail").over(outer), F.lit(0)))
    runs = runs.withColumn("o_drop", F.last(F.when(F.col("r_seps") > 0, F.col("o_tails")), ignorenulls=True).over(outer)).withColumn("o_carry", F.col("o_tails") - F.coalesce("o_drop", F.lit(0)))
    last = W.partitionBy("file")
    runs = runs.withColumn("f_last", F.max("r_last").over(last)).select("file", "run", "o_size", "o_seps", "o_carry", "f_last")
    stitched = local.join(runs, ["file", "run"]).select(
        "file", "block", (F.col("o_size") + F.col("size_in")).alias("offset"), (F.col("o_seps") + F.col("seps_in")).alias("first"), (F.col("carry_in") + F.when(F.col("cut_in"), F.lit(0)).otherwise(F.col("o_carry"))).alias("carry"), "seps", "tail", "size", (F.col("block") == F.col("f_last")).alias("is_last")
    )
    whole = stitched.join(found.select("file", "block", F.arrays_zip("lengths", "begins").alias("docs")), ["file", "block"])
    docs = whole.select("file", "offset", "first", "carry", F.posexplode("docs").alias("i", "d")).select("file", "offset", "first", "carry", "i", F.col("d.lengths").alias("length"), F.col("d.begins").alias("skip"))
    ended = docs.select("file", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("offset") + F.col("skip") - F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("start"), (F.col("length") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = whole.filter("is_last").select("file", (F.col("first") + F.col("seps")).alias("ordinal"), (F.col("tail") + F.when(F.col("seps") > 0, F.lit(0)).otherwise(F.col("carry"))).alias("n_tokens"), (F.col("offset") + F.col("size")).alias("stop")).filter("n_tokens > 0")
    return ended.unionByName(rest.select("file", "ordinal", (F.col("stop") - F.col("n_tokens")).alias("start"), "n_tokens", F.lit(False).alias("ended")))


def count_tokens(docs: DataFrame, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and n_tokens of every row, through flat files and their separator scan."""
    flat, order = pack_documents(docs, tokenizer, block_bytes=block_bytes)
    return order.join(scan_blocks(flat).select("file", "ordinal", "n_tokens"), ["file", "ordinal"]).select("doc_id", "n_tokens")
