"""Results of a running experiment as a stream into a table that can be resumed.

The table is a log of batches, a folder each. A batch is written whole, over what an earlier attempt at it left, and
counts once its folder has the committer's mark; the table's rows are, for each system and document, those of the
latest batch. So a document's rows are replaced at once, and a batch that is repeated after a failure between
its write and the stream's commit gives the same table. ``compact`` writes the table as it stands into one folder.

What a batch has left to do, and the costs it starts with, are read from the batches before it, never from its
own folder; a repeated batch thus decides as it did the first time.

Defined cases: of a document's repeated rows in one batch the first by order is run; a batch without work leaves an
empty folder; costs are those of all stored records, also of documents outside the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import enforce_cap, within_cap

MARK = "_SUCCESS"


class ResultLog:
    """The table of (system, doc_id, seq, …, cost_usd) records under a folder; ``columns`` is its schema as DDL."""

    def __init__(self, spark: SparkSession, path: str, columns: str):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), columns

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folders(self, kind: str = "batch") -> list[int]:
        """The numbers of the folders that are written whole: a batch's own rows, or as ``base`` the table as it stood after a batch."""
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        found = [int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={n}/{MARK}")))

    def rows(self, before: int | None = None) -> DataFrame:
        """The records as they stand, or as they stood before a batch."""
        base = max((n for n in self.folders("base") if before is None or n < before), default=-1)
        used = [(n, f"{self.path}/batch={n}") for n in self.folders() if n > base and (before is None or n < before)]
        used += [(base, f"{self.path}/base={base}")] if base >= 0 else []
        if not used:
            return self.spark.createDataFrame([], self.columns)
        out = None
        log = [self.spark.read.schema(self.columns).parquet(path).withColumn("__batch", F.lit(n)) for n, path in used]
        for part in log:
            out = part if out is None else out.unionByName(part)
        latest = F.max("__batch").over(W.partitionBy("system", "doc_id"))
        return out.withColumn("__latest", latest).filter("__batch = __latest").drop("__batch", "__latest")

    def write(self, rows: DataFrame, batch: int) -> None:
        names = [f.name for f in self.spark.createDataFrame([], self.columns).schema]
        rows.select(*names).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/batch={batch}")

    def cost(self, before: int | None = None) -> float:
        """The costs of all stored records."""
        return float(self.rows(before).agg(F.coalesce(F.sum(F.coalesce("cost_usd", F.lit(0.0)).cast("decimal(38,9)")), F.lit(0))).first()[0])

    def ordered(self, dataset: DataFrame) -> DataFrame:
        """The records of the dataset's documents (doc_id, seq), in its order."""
        return self.rows().drop("seq").join(dataset.select("doc_id", "seq"), "doc_id").orderBy("system", "seq")

    def compact(self) -> None:
        """The table as it stands in one folder, and what went into it gone; a failure leaves either. Not while a batch is being written."""
        used, bases = self.folders(), self.folders("base")
        if not used:
            return
        self.rows().write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/base={used[-1]}")
        jvm, _, fs = self._fs()
        for path in [f"{self.path}/batch={n}" for n in used] + [f"{self.path}/base={n}" for n in bases if n < used[-1]]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def run_batch(log: ResultLog, documents: DataFrame, batch: int, systems: dict[str, Callable[[DataFrame], DataFrame]], cap: float | None = None) -> None:
    """Run every system over the batch's (doc_id, seq, …) documents that it has no record of, and store what comes out.

    A system adds its columns, cost_usd among them, to the documents it is given. With a cap, records are kept in the order of
    systems and documents up to the one whose cost reaches it; they are stored, and then the run stops. What
    is asked of a system in vain is a batch's documents at most.
    """
    log_before = log.rows(before=batch)
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))
    documents = documents.withColumn("__n", first).filter("__n = 1").drop("__n")
    made = None
    for place, (name, system) in enumerate(systems.items()):
        done = log_before.filter(F.col("system") == name).select("doc_id")
        out = system(documents.join(done, "doc_id", "left_anti")).withColumns({"system": F.lit(name), "__place": F.lit(place)})
        made = out if made is None else made.unionByName(out, allowMissingColumns=True)
    if cap is None:
        log.write(made, batch)
        return
    # Systems one after the other: the order's first column is a number that rises over them.
    span = documents.agg(F.coalesce(F.max("seq") - F.min("seq"), F.lit(0)) + 1, F.coalesce(F.min("seq"), F.lit(0))).first()
    made = made.withColumn("__order", F.col("__place") * F.lit(span[0]) + F.col("seq") - F.lit(span[1]))
    log.write(within_cap(made, [], ["__order", "doc_id"], "cost_usd", cap, log.cost(before=batch)), batch)
    stored = log.spark.read.parquet(f"{log.path}/batch={batch}")
    total = log.cost(before=batch) + float(stored.agg(F.coalesce(F.sum(F.col("cost_usd").cast("decimal(38,9)")), F.lit(0))).first()[0])
    enforce_cap(log.spark.range(1).select(F.lit(total).alias("spent_before"), F.lit(0.0).alias("cost_usd")), "cost_usd", cap)


def run_stream(documents: DataFrame, log: ResultLog, checkpoint: str, systems: dict[str, Callable[[DataFrame], DataFrame]], cap: float | None = None, available_now: bool = True, after_write: Callable[[int], None] | None = None) -> StreamingQuery:
    """A stream of documents through ``run_batch``. Restarted with the same checkpoint it goes on where it was; ``after_write`` is called between a batch's write and its commit."""

    def each(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            run_batch(log, rows, batch, systems, cap)
        finally:
            rows.unpersist()
        if after_write is not None:
            after_write(batch)

    writer = documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
