"""Connected components of a distributed edge list by alternating large and small stars, or in one task while the edges are few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, ship

#: Edges (counted, 16 bytes each) that one task joins into components.
FEW = 100_000


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, root) for every node of (a, b) edges, root the smallest node that can be reached.

    Each round is two aggregations to a minimum, combined on the map side, and two joins against the
    one-row-per-node result, so a hub's edges can be split over tasks. A reliable checkpoint cuts the
    lineage after each round; the rounds grow with the logarithm of the longest chain. Up to ``few`` edges
    are joined in one task instead, where rounds of small shuffles would cost far more. Null ends and
    self loops are ignored; repeated edges count once; no edges give no rows.
    """
    now = cut(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    if 0 < state[0] <= few:
        ship(edges.sparkSession)
        return now.coalesce(1).mapInArrow(_join, "node long, root long")
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        now = cut(_small_star(_large_star(now)))
        last, state = state, _state(now)
        if last == state:
            break
    else:
        raise RuntimeError("components did not settle")
    release(edges.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _join(batches):
    """(node, root) of all edges of a bounded partition: roots fall to the least of an edge's two until none changes."""
    held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
    if not held:
        return
    nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(nodes.size)
    while (root[u] != root[v]).any():
        a, b = root[u], root[v]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    for i in range(0, nodes.size, 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 10_000]), pa.array(nodes[root[i : i + 10_000]])], names=["node", "root"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours go to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
