"""Connected components of an edge table.

Every ``EDGES`` edges are contracted to a forest by union-find in one task;
what several tasks leave is joined by alternating large-star and small-star
steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

EDGES = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node) of each tree of a task's edges, roots left out."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node at its smallest neighbour (or itself).

    Large-star moves the larger neighbours, small-star the node and its smaller
    ones.  The smallest neighbour is an aggregate joined back, so a node with
    very many edges is never gathered in one task.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-low")
    moved = both.join(low, "u")
    out = moved.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node it is connected to.

    Each step is written to the shared folder, so lost executors cost one step.
    Only counts and check sums reach the driver.  An empty table gives an empty result; a
    self-link or null end links nothing.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    tasks = edges.count() // EDGES + 1
    state = written(edges.repartition(tasks).mapInArrow(_contract, "u long, v long"), "forest")
    before = None
    while tasks > 1:
        state = written(_star(_star(state, True), False), "star")
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        if mark == before:
            break
        before = mark
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
