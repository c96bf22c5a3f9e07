"""Helpers shared by the corpus operators: inputs, id splits, checkpoints."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, ship

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_bucket(id_col: Column, modulus: int) -> Column:
    """CRC-32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def whole_text(col: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col), F.lit("")).alias(col)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; merged projections would otherwise compute it at every use."""
    return F.get(F.transform(F.array(value), body), 0)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, which lost executors cannot take away.

    Spark removes the files once nothing refers to them (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints that nothing refers to any more; loops leave them behind until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """The rows written as Parquet to the checkpoint folder and read again, so that later readers can prune columns; removed when the application ends, or earlier by whoever gave ``made``, to which the path is added."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    file_system(spark, path).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def map_rows(
    df: DataFrame,
    schema: T.StructType | str,
    make: Callable[[], Callable[[list], Iterator[tuple]]],
    rows_per_batch: int = 2000,
) -> DataFrame:
    """Run ``make()`` once in each task, then its result on the column lists of each Arrow batch.

    The function yields output tuples; they leave in batches of ``rows_per_batch``, so memory is
    bounded by one input batch and one output batch whatever the partition's size.
    """
    ship(df.sparkSession)
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, out = make(), []
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(at, rows_per_batch)
                for row in step([c.to_pylist() for c in part.columns]):
                    out.append(row)
                    if len(out) >= rows_per_batch:
                        yield pack(out)
                        out = []
        finish = getattr(step, "finish", None)
        if finish is not None:
            for row in finish():
                out.append(row)
                if len(out) >= rows_per_batch:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    return df.mapInArrow(run, schema)


def bounded_fraction(n_rows: int, bound: int) -> float:
    """The share of rows a sample of about ``bound`` rows takes."""
    return 1.0 if n_rows <= bound else bound / n_rows


def hash_share(id_col: Column, seed: int, fraction: float) -> Column:
    """True for a fixed pseudo-random ``fraction`` of the ids, the same in every run and partitioning."""
    if fraction >= 1.0:
        return F.lit(True)
    grain = 1 << 30
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(grain)) < F.lit(int(fraction * grain))
