"""Scoring: token F1 by multiset overlap, summaries, paired tests, taxonomies, cost and latency."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def f1(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """1 where both sides are empty, 0 where one is."""
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when((n_pred == 0) | (n_true == 0), 0.0).otherwise(2.0 * tp / (n_pred + n_true))


def token_overlap(keys: list[str], predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per key: tp, n_pred and n_true from token rows (keys…, token), as a multiset intersection."""
    both = predicted.select(*keys, "token", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select(*keys, "token", F.lit(0).alias("p"), F.lit(1).alias("t")))
    counts = both.groupBy(*keys, "token").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    return counts.groupBy(*keys).agg(F.sum(F.least("p", "t")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"))


def text_overlap(rows: DataFrame, shape: str = "[a-z0-9.]+", batch: int = 500) -> DataFrame:
    """(doc_id, tp, n_pred, n_true) of (doc_id, predicted, truth) texts: the tokens of both as multisets, each row for itself; a null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = re.compile(shape).findall
        for b in batches:
            for at in range(0, b.num_rows, batch):
                ids, predicted, truth = b.slice(at, batch).columns
                sides = [(Counter(tokens(p or "")), Counter(tokens(t or ""))) for p, t in zip(predicted.to_pylist(), truth.to_pylist(), strict=True)]
                counts = [[sum(min(n, t[w]) for w, n in p.items()) for p, t in sides], [p.total() for p, _ in sides], [t.total() for _, t in sides]]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in counts]], names=["doc_id", "tp", "n_pred", "n_true"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "predicted", "truth").mapInArrow(count, f"doc_id {kind}, tp long, n_pred long, n_true long")


def summarize(scores: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Count, mean and population deviation of each metric; an absent one counts as 0."""
    aggs = [F.count("*").alias("n_docs")]
    for m in metrics:
        v = F.coalesce(m, F.lit(0.0))
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_pop(v).alias(f"{m}_std")]
    return scores.groupBy(by).agg(*aggs)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """One row from (a, b) booleans: discordant counts and the continuity-corrected statistic, 0 without any."""
    n = pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"))
    gap = F.abs(F.col("a_only") - F.col("b_only")) - 1
    return n.select("a_only", "b_only", F.coalesce(F.try_divide((gap * gap).cast("double"), (F.col("a_only") + F.col("b_only")).cast("double")), F.lit(0.0)).alias("statistic"))


def mcnemar_p(statistic: float) -> float:
    return math.erfc(math.sqrt(statistic / 2)) if statistic > 0 else 1.0


def pairwise(results: DataFrame) -> DataFrame:
    """Discordant counts of every two systems (left < right) over their shared documents, from (system, doc_id, ok)."""
    l, r = results.select(F.col("system").alias("left"), "doc_id", F.col("ok").alias("a")), results.select(F.col("system").alias("right"), "doc_id", F.col("ok").alias("b"))  # noqa: E741
    n = l.join(r, "doc_id").filter("left < right").groupBy("left", "right").agg(F.count("*").alias("n_docs"), F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"))
    gap = F.abs(F.col("a_only") - F.col("b_only")) - 1
    return n.withColumn("statistic", F.coalesce(F.try_divide((gap * gap).cast("double"), (F.col("a_only") + F.col("b_only")).cast("double")), F.lit(0.0)))


def ablation_deltas(summary: DataFrame, baseline: str, metric: str) -> DataFrame:
    """Each system's metric less the baseline's; one row is the baseline."""
    base = summary.filter(F.col("system") == baseline).agg(F.max(metric).alias("base"))
    return summary.join(F.broadcast(base), F.lit(True)).filter(F.col("system") != baseline).select("system", F.col(metric), (F.col(metric) - F.col("base")).alias("delta"))


def best_by(rows: DataFrame, by: str, order: list[Column], tie: str) -> DataFrame:
    """The first row of each group in the given order, ties by ``tie``."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(*order, tie))).filter("__r = 1").drop("__r")


def cost_cap(rows: DataFrame, group: str, order: str, cost: str, cap: float) -> DataFrame:
    """Rows with the running cost, up to the first that reaches the cap."""
    w = W.partitionBy(group).orderBy(order)
    before = F.coalesce(F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("spent_before", before).filter(F.col("spent_before") < cap)


#: Costs are added up as decimals with so many digits behind the point, so sums don't depend on their order.
MONEY = "decimal(38,9)"


class CostCapExceeded(RuntimeError):
    """A run's costs have reached its cap."""


def place_of(rows: DataFrame, order: str) -> Column:
    """A number that rises with a number or time column."""
    kind = dict(rows.dtypes)[order]
    c = F.col(order).cast("timestamp") if kind in ("timestamp_ntz", "date") else F.col(order)
    return c.cast("double")


def run_bounds(rows: DataFrame, order: str, n_runs: int) -> list[float]:
    """At most ``n_runs`` - 1 values that cut the rows into runs of about equal size by their order, whatever their groups."""
    steps = [i / n_runs for i in range(1, n_runs)]
    found = rows.agg(F.percentile_approx(place_of(rows, order), steps, 10 * n_runs).alias("p")).first()["p"] if steps else None
    return sorted(set(found or []))


def running_cost(rows: DataFrame, groups: list[str], order: list[str], cost: str, base: DataFrame | float = 0.0, n_runs: int = 256) -> DataFrame:
    """Adds spent_before, the costs of a group's rows before each row on top of the group's ``base`` (a number, or a table of groups and base).

    A prefix sum in two levels: the rows are cut into runs by the first column of ``order`` (a number or a time); a window
    adds up within a run of a group, and a second one over the runs' sums gives each run its offset. So no task
    holds a group, even if it is the only one. Null costs count as 0, rows without order come first.
    """
    bounds = run_bounds(rows, order[0], n_runs)
    place = place_of(rows, order[0])
    run = F.coalesce(F.array_size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= place)) if bounds else F.lit(0), F.lit(0))
    money = F.coalesce(F.col(cost), F.lit(0)).cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    marked = rows.withColumn("__run", F.when(place.isNull(), -1).otherwise(run)).withColumn("__cost", money)
    inner = W.partitionBy(*groups, "__run").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = marked.withColumn("__inside", F.coalesce(F.sum("__cost").over(inner), zero))
    sums = marked.groupBy(*groups, "__run").agg(F.sum("__cost").alias("__sum"))
    outer = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))).orderBy("__run").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(outer), zero)).drop("__sum")
    if isinstance(base, DataFrame):
        offsets = offsets.join(base.select(*groups, F.col("base").cast(MONEY).alias("__base")), groups, "left").withColumn("__offset", F.col("__offset") + F.coalesce("__base", zero)).drop("__base")
    else:
        offsets = offsets.withColumn("__offset", F.col("__offset") + F.lit(base).cast(MONEY))
    # Null-safe, so that rows of a null group keep their offset.
    left, right = inside.alias("l"), offsets.alias("r")
    same = F.lit(True)
    for name in [*groups, "__run"]:
        same = same & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    joined = left.join(right, same)
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in rows.columns], (F.col("l.__inside") + F.col("r.__offset")).cast("double").alias("spent_before"))


def within_cap(rows: DataFrame, groups: list[str], order: list[str], cost: str, cap: float, base: DataFrame | float = 0.0, n_runs: int = 256) -> DataFrame:
    """The rows that are run before a group's costs reach the cap, with the running cost; the row that reaches it is the last."""
    return running_cost(rows, groups, order, cost, base, n_runs).filter(F.col("spent_before") < cap)


def enforce_cap(kept: DataFrame, cost: str, cap: float) -> float:
    """The highest cost that rows from ``within_cap`` come to; raises where it reaches the cap. The caller writes the rows before that."""
    spent = kept.agg(F.max(F.col("spent_before") + F.coalesce(F.col(cost), F.lit(0.0)))).first()[0] or 0.0
    if spent >= cap:
        raise CostCapExceeded(f"costs of {spent:.6f} have reached the cap of {cap:.6f}")
    return spent


def token_f1_lenient(rows: DataFrame) -> DataFrame:
    """Token counts in which a wrong label that is not O is no false negative, from (pred, gold)."""
    return rows.agg(F.count_if((F.col("pred") == F.col("gold")) & (F.col("gold") != "O")).alias("tp"), F.count_if((F.col("pred") != "O") & (F.col("pred") != F.col("gold"))).alias("fp"), F.count_if((F.col("pred") == "O") & (F.col("gold") != "O")).alias("fn"))


def with_dataset(results: DataFrame, dataset: DataFrame, missing: str = "keep", key: str = "doc_id") -> DataFrame:
    """Results with the dataset's columns. ``missing``: keep results without a document, drop them, or fill, which keeps every document and leaves results null."""
    how = {"keep": "left", "drop": "inner", "fill": "right"}[missing]
    return results.join(dataset, key, how)


def first_documents(dataset: DataFrame, order: str, n: int) -> DataFrame:
    """The first n documents of a dataset; ties go by the whole row."""
    return dataset.orderBy(order, *[c for c in dataset.columns if c != order]).limit(n)


def resume(dataset: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is left to do."""
    return dataset.join(done.select(key).distinct(), key, "left_anti")
