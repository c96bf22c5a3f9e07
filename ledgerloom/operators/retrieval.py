"""Chunk retrieval by cosine, and hash-ranked samples and splits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cosine, hashing_embedding
from ..session import checkpoint_dir, ship
from .tokens import chunk_lines


def build_index(docs: DataFrame, chunk_size: int) -> DataFrame:
    """(doc_id, chunk_id, chunk, text_hash, embedding); the hash of the text keys the index, so changed text is never stale."""
    return chunk_lines(docs, chunk_size).join(docs.select("doc_id", F.sha2("text", 256).alias("text_hash")), "doc_id").withColumn("embedding", hashing_embedding("chunk"))


def retrieve(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each query's document; ties go to the later chunk."""
    q = queries.select("doc_id", "query", hashing_embedding("query").alias("q"))
    scored = index.join(q, "doc_id").select("doc_id", "query", "chunk_id", "chunk", cosine(F.col("q"), F.col("embedding")).alias("score"))
    w = W.partitionBy("doc_id", "query").orderBy(F.desc("score"), F.desc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Scores are compared to so many decimals, so that equal vectors tie whatever the order of their sums.
DECIMALS = 12
NEAREST = "query_id long, vec_id long, score double, rank int"


def best_of(batches: Iterator[pa.RecordBatch], ids: np.ndarray, asked: np.ndarray, k: int, cells: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The k best (query_id, vec_id, score) of each query among a task's vectors, by matrix products of a few rows with all queries; a product has about ``cells`` scores, however many queries there are."""
    rows = min(1000, max(2 * k, cells // max(1, len(ids))))
    top_score, top_id = np.full((k, len(ids)), -(2 << 60), np.int64), np.full((k, len(ids)), -1, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            own = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            e = part.column(1)
            vectors = e.values.to_numpy(zero_copy_only=False)[e.offsets[0].as_py() : e.offsets[-1].as_py()].reshape(len(own), -1).astype(np.float64)
            order = np.argsort(own, kind="stable")
            own, vectors = own[order], vectors[order]
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            score = np.rint(np.divide(vectors, norm, out=vectors, where=norm > 0) @ asked.T * 10**DECIMALS).astype(np.int64)
            score[own[:, None] == ids[None, :]] = -(1 << 50)
            # Score and place by id in one number: the selection is exact among ties.
            both = score * 1024 + np.arange(len(own))[:, None]
            pick = np.argpartition(both, -k, axis=0)[-k:] if len(own) > k else np.tile(np.arange(len(own))[:, None], (1, len(ids)))
            score, own = np.concatenate([top_score, np.take_along_axis(score, pick, 0)]), np.concatenate([top_id, own[pick]])
            last = np.lexsort((own, score), axis=0)[-k:][::-1]
            top_score, top_id = np.take_along_axis(score, last, 0), np.take_along_axis(own, last, 0)
    keep = (top_score > -(1 << 49)).T
    which = np.repeat(ids, k).reshape(len(ids), k)[keep]
    yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(top_id.T[keep]), pa.array(top_score.T[keep] / 10.0**DECIMALS)], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 10_000) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest rows of each query vector by cosine, ties to the later one; the stated query set against all rows.

    Queries are counted and dealt into blocks of about ``block`` by a hash. A block is sent to the tasks as a matrix;
    each task keeps the k best of its vectors, and only those are shuffled. Several blocks are written one after the other
    to the checkpoint folder, so the plan doesn't grow with the queries. Null vectors are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    queries, vectors = queries.filter("embedding is not null").select("vec_id", "embedding"), vectors.filter("embedding is not null")
    n_blocks = -(-queries.count() // block)
    if not n_blocks:
        return spark.createDataFrame([], NEAREST)
    all_ = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("vec_id"))
    path = f"{checkpoint_dir(spark)}/nearest-{uuid.uuid4().hex}"
    for i in range(n_blocks):
        part = queries if n_blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i)
        got = part.toArrow()
        ids = got.column("vec_id").to_numpy().astype(np.int64)
        if not len(ids):
            continue
        asked = np.array(got.column("embedding").to_pylist(), np.float64)
        norm = np.linalg.norm(asked, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((ids, np.divide(asked, norm, out=asked, where=norm > 0)))
        found = all_.mapInArrow(lambda batches, sent=sent: best_of(batches, *sent.value, k), "query_id long, vec_id long, score double")
        best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if n_blocks == 1:
            return best
        best.write.mode("append").parquet(path)
    return spark.read.schema(NEAREST).parquet(path)


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def split(rows: DataFrame, key: str, seed: int, shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """Adds split (train, val, test) with exact sizes, by rank of a hash over the distinct keys.

    The rank is the number of rows in lower buckets of the hash, 65,536 of them at most, which are counted
    first, and the place within the own bucket: no task sees all rows.
    """
    rows = rows.withColumn("__h", F.xxhash64(key, F.lit(seed)))
    rows = rows.withColumn("__b", F.shiftright("__h", 48))
    counts = rows.groupBy("__b").agg(F.count("*").alias("n"))
    below = counts.select("__b", F.coalesce(F.sum("n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__below"))
    n = int(counts.agg(F.sum("n")).first()[0] or 0)
    rank = F.col("__below") + F.row_number().over(W.partitionBy("__b").orderBy("__h", key))
    first, second = int(n * shares[0]), int(n * shares[0]) + int(n * shares[1])
    ranked = rows.join(F.broadcast(below), "__b").withColumn("__r", rank)
    return ranked.withColumn("split", F.when(F.col("__r") <= first, "train").when(F.col("__r") <= second, "val").otherwise("test")).drop("__r", "__h", "__b", "__below")
