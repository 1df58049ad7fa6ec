"""Clustering of integer vectors around centroids by progressive search in the Walsh-Hadamard domain.

The transform of a vector and of the centroids is exact in integers and keeps
squared distances up to the factor 64, so a running sum over the coefficients'
differences, coarse (few sign changes) to fine, is a lower bound on every
centroid's distance.  The centroid that leads after the first coefficients is
measured in full; all others are dropped as soon as their running sum is more
than that, and those that stay are finished over all 64 coefficients.  Only
strictly worse centroids are dropped, so the result is the nearest centroid,
ties to the smaller number.

Rows are never shuffled: each pass over the written vectors sends one row per
partition and centroid (count, componentwise sums, summed distance), and those
sums make the next centroids.

Defined cases: vectors that are null, not of 64 components, or hold null or
non-finite components take no part.  A component of magnitude 65,536 or more
counts as that bound, so that distances fit a long; an inertia beyond a long is
the largest long.  A repeated row is a vector of its own.  Null ids are kept and
come last among the first centroids; equal ids are ordered by their vectors.
Fewer vectors than centroids give as many centroids as vectors; no vectors give
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

DIM = 64
CENTROIDS, ROUNDS, SEED, SCALE = 8, 10, 3, 1024
BOUND = 1 << 26             # largest magnitude of an integer component
NARROW = 1 << 23            # up to it, 64-bit integers hold all sums of the transform
STEPS = (0, 4, 16, 64)      # coefficients looked at between eliminations, coarse to fine
BLOCK = 4096
LONG_MAX = (1 << 63) - 1


def coarse_to_fine() -> np.ndarray:
    """Rows of the transform by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < DIM:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")


ORDER = coarse_to_fine()


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, coarse to fine; exact (int64, or Python integers for wide values)."""
    x = x.astype(np.int64 if np.abs(x).max(initial=0) <= NARROW else object)
    half = 1
    while half < DIM:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), DIM)
        half *= 2
    return x[:, ORDER]


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: smaller number) and the exact squared distance."""
    tx, tc = transform(x), transform(centroids)
    if object in (tx.dtype, tc.dtype):
        tx, tc = tx.astype(object), tc.astype(object)
    rows = np.arange(len(x))

    def gain(row: np.ndarray, centre: np.ndarray, lo: int, hi: int) -> np.ndarray:
        d = tx[row, lo:hi] - tc[centre, lo:hi]
        return (d * d).sum(axis=1)

    row, centre = np.repeat(rows, len(tc)), np.tile(np.arange(len(tc)), len(x))
    so_far = gain(row, centre, *STEPS[:2])
    leader = so_far.reshape(len(x), -1).argmin(axis=1)
    limit = so_far[rows * len(tc) + leader] + gain(rows, leader, STEPS[1], DIM)
    for lo, hi in zip(STEPS[1:], STEPS[2:], strict=False):
        stays = (so_far <= limit[row]).astype(bool)
        row, centre = row[stays], centre[stays]
        so_far = so_far[stays] + gain(row, centre, lo, hi)
    first = np.searchsorted(row, rows)                      # pairs are in order of row and centroid
    least = np.minimum.reduceat(so_far, first) if len(x) else so_far
    tied = np.flatnonzero((so_far == least[row]).astype(bool))
    best = centre[tied[np.unique(row[tied], return_index=True)[1]]]
    return best, least // DIM


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.int64).reshape(len(col), DIM)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the vectors that take part, as integers floor(1024 * component)."""
    edge = BOUND // SCALE
    return (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where(f"size(x) = {DIM} AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) "
                   "AND abs(v) < CAST('Infinity' AS DOUBLE))")
            .selectExpr("id", f"transform(x, v -> CAST(floor(greatest(least(v, {edge}D), -{edge}D) * {SCALE}) AS INT)) AS x"))


def first_centroids(data: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest hashes of ``seed:id``, in order of the hash (a bounded top-k)."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = data.select(place.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), DIM)


def _sums(data: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int], int]]:
    """(centroid, rows, componentwise sums, summed distance) of each non-empty centroid."""
    shared = data.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value)
        count, far = [0] * k, [0] * k
        total = np.zeros((k, DIM), object)
        for part in _blocks(batches):
            x = _matrix(part.column("x"))
            best, dist = assign(x, shared.value)
            for c in np.unique(best).tolist():
                mine = best == c
                count[c] += int(mine.sum())
                total[c] += x[mine].sum(axis=0)
                far[c] += sum(dist[mine].tolist())
        used = [c for c in range(k) if count[c]]
        whole = lambda values: pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))
        lists = pa.ListArray.from_arrays(pa.array(range(0, DIM * len(used) + 1, DIM), pa.int32()),
                                         whole([v for c in used for v in total[c]]))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), whole([count[c] for c in used]), lists,
                                          whole([far[c] for c in used])], names=["c", "n", "sums", "far"])

    exact = "decimal(38,0)"
    parts = data.select("x").mapInArrow(run, f"c int, n {exact}, sums array<{exact}>, far {exact}")
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("far").alias("far"),
                                  *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIM)]).collect()   # one row a centroid
    shared.unpersist()
    return [(r.c, int(r.n), [int(r[f"s{i}"]) for i in range(DIM)], int(r.far)) for r in rows]


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id",
              vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    data = written(kept(vectors, id_col, vector_col), "clusters-vectors")
    kind = data.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(data, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        for c, n, sums, _ in _sums(data, centroids):
            centroids[c] = [s // n for s in sums]
    far = {c: f for c, _, _, f in _sums(data, centroids)}
    inertia = min(sum(far.values()), LONG_MAX)
    spread = np.array([min(far.get(c, 0), LONG_MAX) for c in range(len(centroids))], np.int64)
    names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            best, dist = assign(_matrix(part.column("x")), shared.value)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(best, pa.int32()), pa.array(dist.tolist(), pa.int64()), pa.array(spread[best]),
                 pa.array(np.full(len(best), inertia, np.int64)), pa.array(names[best].tolist(), pa.string())],
                names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return data.mapInArrow(run, schema)


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same clustering by full distances: one pair of common tables a round."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
  list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM
  (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM kept) ORDER BY h NULLS LAST, x LIMIT {k})"""]
    square = "list_sum(list_transform(list_zip(x, m), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT)))"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT rid, c, d, row_number() OVER (PARTITION BY rid "
                     f"ORDER BY d, c) AS n FROM (SELECT rid, c, CAST({square} AS BIGINT) AS d FROM kept, c{i})) WHERE n = 1)")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(t, m) AS m FROM c{i} LEFT JOIN
  (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY dim) AS t FROM
    (SELECT c, dim, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS v, unnest(range({DIM})) AS dim
      FROM a{i} JOIN kept USING (rid)) GROUP BY c, dim) GROUP BY c) USING (c))""")
    return ("WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(m, lambda v: CAST(v AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} USING (c)""")


SQL = _sql()
