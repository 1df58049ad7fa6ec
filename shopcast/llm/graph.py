"""Approximate nearest neighbours on robust-pruned directed graphs, one graph per shard of the vectors.

A shard's graph starts with random edges.  Batch by batch, a greedy beam search
from the entry points proposes neighbours of each point; pruning keeps a
candidate unless a kept one is nearer to it, by the factor ``ALPHA``, than the
point itself, so edges point in diverse directions; reverse edges are added and
pruned alike.  A first pass with factor 1 is refined by a second with ``ALPHA``,
and points that no entry reaches (a tight cluster can cut itself off) get an edge
from the nearest one that is reached.  Every query is searched
by beam in every shard, in blocks, and the shards' best are merged.

Equal vectors are one node, with the smallest ids of its members beside it, so
a vector that makes up a third of all rows is one point.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither do null ids; vectors are compared with those
of their own length only.  Repeated rows of an id count once per vector.  With fewer
candidates than ``k`` all are returned.  The graph compares in single precision
(scaled, where the values are very large or small); distances are those of the
vectors in double precision.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

DEGREE, BEAM, SEARCH_BEAM, ALPHA = 32, 64, 160, 1.2
ENTRIES = 16            # random entry points beside the middle one
SHARD = 8192            # vectors of a shard
BLOCK = 512             # points or queries searched together
MOST_TASKS = 100_000


class Graph:
    """A shard's vectors and their out-neighbours (-1: none)."""

    def __init__(self, vectors: np.ndarray, seed: int = 6):
        self.exact = vectors                    # in double precision, for the final distances
        largest = float(np.abs(vectors).max(initial=0))
        self.scale = largest if not 1e-9 < largest < 1e9 else 1.0      # squares stay within a float
        self.x = (vectors / self.scale).astype(np.float32)
        self.norm = np.einsum("nd,nd->n", self.x, self.x)
        n, rng = len(vectors), np.random.default_rng(seed)
        self.out = rng.integers(0, n, (n, DEGREE), dtype=np.int32)
        middle = int(np.argmin(self.norm - 2 * self.x @ self.x.mean(axis=0)))
        self.entries = np.unique(np.append(rng.integers(0, n, ENTRIES), middle))
        order = rng.permutation(n)
        for alpha in (1.0, ALPHA):
            for at in range(0, n, BLOCK):
                self._insert(order[at:at + BLOCK], alpha)
        self._reach_all()

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of points, less the query's own norm."""
        return self.norm[ids] - 2 * np.einsum("brd,bd->br", self.x[ids], q)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beam ids (-1: none) and their distances, nearest first, and all expanded ids of each query."""
        b, beam = len(q), max(beam, len(self.entries))
        rows = np.arange(b)
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)
        seen = np.zeros((b, len(self.x)), bool)
        start = self.entries
        ids[:, :len(start)], done[:, :len(start)] = start, False
        dist[:, :len(start)] = self._distances(q, ids[:, :len(start)])
        seen[:, start] = True
        expanded = []
        while True:
            open_ = np.where(done, np.inf, dist)
            pick = open_.argmin(axis=1)
            live = np.isfinite(open_[rows, pick])
            if not live.any():
                break
            r = rows[live]
            node = ids[r, pick[live]]
            done[r, pick[live]] = True
            step = np.full(b, -1, np.int64)
            step[r] = node
            expanded.append(step)
            near = self.out[node].astype(np.int64)
            fresh = (near >= 0) & ~seen[r[:, None], near]
            seen[np.repeat(r, near.shape[1])[fresh.ravel()], near[fresh]] = True
            d = np.where(fresh, self._distances(q[r], np.maximum(near, 0)), np.inf).astype(np.float32)
            all_d = np.concatenate((dist[r], d), axis=1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[r] = np.take_along_axis(all_d, keep, 1)
            ids[r] = np.take_along_axis(np.concatenate((ids[r], np.where(fresh, near, -1)), axis=1), keep, 1)
            done[r] = np.take_along_axis(np.concatenate((done[r], ~fresh), axis=1), keep, 1)
        return ids, dist, np.stack(expanded, axis=1)

    def _prune(self, points: np.ndarray, cands: np.ndarray, alpha: float) -> np.ndarray:
        """Kept neighbours of each point among its candidates (-1: none)."""
        result = np.full((len(points), DEGREE), -1, np.int32)
        for at in range(0, len(points), 64):
            p, c = points[at:at + 64], np.sort(cands[at:at + 64], axis=1)
            c = np.where((c == p[:, None]) | (np.diff(c, axis=1, prepend=-2) == 0), -1, c)
            safe = np.maximum(c, 0)
            d = np.where(c >= 0, self._distances(self.x[p], safe) + self.norm[p][:, None], np.inf)
            order = np.argsort(d, axis=1, kind="stable")
            d, c, safe = (np.take_along_axis(v, order, 1) for v in (d, c, safe))
            xs = self.x[safe]
            between = (self.norm[safe][:, :, None] + self.norm[safe][:, None, :] - 2 * xs @ xs.transpose(0, 2, 1))
            alive, rows = c >= 0, np.arange(len(p))
            for k in range(DEGREE):
                first = alive.argmax(axis=1)
                some = alive[rows, first]
                if not some.any():
                    break
                result[at + rows[some], k] = c[rows[some], first[some]]
                alive &= ~(some[:, None] & (alpha * alpha * between[rows, first] <= d))
                alive[rows, first] = False
        return result

    def _insert(self, points: np.ndarray, alpha: float) -> None:
        ids, _, expanded = self.search(self.x[points], BEAM)
        cands = np.concatenate((ids, expanded, self.out[points].astype(np.int64)), axis=1)
        self.out[points] = self._prune(points, cands, alpha)
        # reverse edges, at most DEGREE for a node at a time
        to = self.out[points].ravel().astype(np.int64)
        source = np.repeat(points, DEGREE)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        start = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1)) if len(to) else np.zeros(0, np.int64)
        rank = np.arange(len(to)) - np.repeat(start, np.diff(np.concatenate((start, [len(to)]))))
        for turn in range(int(rank.max(initial=-1)) // DEGREE + 1):
            now = rank // DEGREE == turn
            nodes, row = np.unique(to[now], return_inverse=True)
            new = np.full((len(nodes), DEGREE), -1, np.int64)
            new[row, rank[now] % DEGREE] = source[now]
            both = np.concatenate((self.out[nodes].astype(np.int64), new), axis=1)
            fits = np.array([len(set(r[r >= 0].tolist())) for r in both]) <= DEGREE
            for node, r in zip(nodes[fits], both[fits], strict=True):
                u = np.unique(r[r >= 0])
                self.out[node] = -1
                self.out[node, :len(u)] = u
            if (~fits).any():
                self.out[nodes[~fits]] = self._prune(nodes[~fits], both[~fits], alpha)

    def _reach_all(self) -> None:
        """Give every point that the entries do not lead to an edge from the nearest point they do."""
        while True:
            seen = np.zeros(len(self.x), bool)
            front = self.entries
            while len(front):
                seen[front] = True
                near = np.unique(self.out[front])
                front = near[(near >= 0) & ~seen[np.maximum(near, 0)]]
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            lost = lost[:BLOCK]
            ids, _, _ = self.search(self.x[lost], BEAM)
            for point, found in zip(lost, ids, strict=True):
                near = found[(found >= 0) & seen[np.maximum(found, 0)]]
                free = [f for f in near if (self.out[f] < 0).any()]
                if free:
                    self.out[free[0], np.argmax(self.out[free[0]] < 0)] = point
                else:       # no room near it: one more entry
                    self.entries = np.append(self.entries, point)

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest found (-1: none) and their exact double-precision distances."""
        near = np.clip(q / self.scale, -1e12, 1e12).astype(np.float32)
        ids, _, _ = self.search(near, max(SEARCH_BEAM, k))
        diff = self.exact[np.maximum(ids, 0)] - q[:, None, :]
        unit = np.maximum(np.abs(diff).max(axis=2, keepdims=True), 1e-300)     # no square overflows
        unit = np.where((unit > 1e150) | (unit < 1e-150), unit, 1.0)
        d = np.where(ids >= 0, np.sqrt(((diff / unit) ** 2).sum(axis=2)) * unit[:, :, 0], np.inf)
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def _search_shards(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, vectors before queries: build each shard's graph, then stream its queries."""
    now, graph, ids, held = None, None, np.zeros(0, np.int64), []
    for batch in batches:
        shard, query = batch.column("shard").to_numpy(), batch.column("query").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(query) != 0)) + 1).tolist(), len(shard)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if shard[lo] != now:
                now, graph, held = shard[lo], None, []
            x = np.asarray(part.column("x").flatten(), np.float64).reshape(hi - lo, -1)
            if not query[lo]:
                held.append((part.column("id").to_numpy(), x))
                continue
            if graph is None and held:
                ids = np.concatenate([h[0] for h in held])
                graph, held = Graph(np.concatenate([h[1] for h in held])), []
            for at in range(0, hi - lo if graph else 0, BLOCK):
                found, dist = graph.nearest(x[at:at + BLOCK], k)
                row, col = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column("id").to_numpy()[at:at + BLOCK][row]), pa.array(ids[found[row, col]]),
                     pa.array(dist[row, col])], names=["query_id", "node", "score"])


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every id divisible by ``every``."""
    sane = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0 AND exists(x, v -> v <> 0) "
                   "AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < CAST('Infinity' AS DOUBLE))"))
    few = Window.partitionBy("x").orderBy("id")   # only the first k + 1 members of a class can be among the k nearest
    members = written(sane.distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
                      .withColumn("node", F.min("id").over(few)).drop("n"), "ann-members")
    nodes = members.where("id = node").select("node", "x", F.size("x").alias("dim"))
    # shards are numbered, and each has a task of its own
    before = Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)     # one row a length of vectors
    dims = nodes.groupBy("dim").agg(F.count("*").alias("n")).selectExpr("dim", f"CAST(ceil(n / {SHARD}) AS INT) AS shards").withColumn(
        "first", F.coalesce(F.sum("shards").over(before), F.lit(0)))
    parts = min(MOST_TASKS, max(1, dims.agg(F.sum("shards")).first()[0] or 0))
    placed = nodes.join(dims, "dim").selectExpr("first + pmod(xxhash64(node), shards) AS shard", "0 AS query", "node AS id", "x")
    asked = (sane.where(F.pmod("id", F.lit(every)) == 0).withColumn("dim", F.size("x")).distinct().join(dims, "dim")
             .selectExpr("id", "x", "first", "explode(sequence(0, shards - 1)) AS s")
             .selectExpr("first + s AS shard", "1 AS query", "id", "x"))
    found = (placed.unionByName(asked).repartitionById(parts, (F.col("shard") % parts).cast("int"))
             .sortWithinPartitions("shard", "query")
             .mapInArrow(lambda b: _search_shards(b, k + 1), "query_id long, node long, score double"))
    best = Window.partitionBy("query_id").orderBy("score", "node")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return (found.select("query_id", "node", "score").join(members.select("node", "id"), "node").where("id <> query_id")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"))
