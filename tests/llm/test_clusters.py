"""Centroid clustering against plain distances, on wide values and on awkward rows."""

import hashlib
import math

import numpy as np
import pytest
from llm_fixtures import shared_folder  # noqa: F401

from shopcast.llm import hadamard as H


def brute(rows, k=8, rounds=10):
    """The contract in plain Python: (id, cluster, distance), centroids."""
    edge = H.BOUND // H.SCALE
    data = [(i, [math.floor(1024 * max(-edge, min(edge, float(v)))) for v in x]) for i, x in rows
            if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    place = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centre = [x for _, x in sorted(data, key=lambda r: (place(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        got = [near(x)[1] for _, x in data]
        for n in range(len(centre)):
            mine = [x for (_, x), g in zip(data, got, strict=True) if g == n]
            if mine:
                centre[n] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    return [(i, near(x)[1], near(x)[0]) for i, x in data], centre


def check(spark, rows, kind="float", extra=False):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    if extra:
        for c in ("id", "x", "c", "n", "sums", "far", "cluster", "distance", "inertia", "centroid_sha256"):
            df = df.selectExpr("*", f"'{c}' AS {c}")
    got = H.clustered(df).collect()
    want, centre = brute([(i, None if x is None else [None if v is None else float(np.float32(v)) if kind == "float" else v for v in x])
                          for i, x in rows])
    order = lambda r: (r[0] is None, r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=order) == sorted(want, key=order)
    inertia = sum(d for *_, d in want)
    for r in got:
        assert r.inertia == min(inertia, H.LONG_MAX)
        assert r.cluster_inertia == min(sum(d for _, c, d in want if c == r.cluster), H.LONG_MAX)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centre[r.cluster])).encode()).hexdigest()
    return got


def test_transform_keeps_distances_up_to_64():
    rng = np.random.default_rng(1)
    x = rng.integers(-5000, 5000, (9, 64))
    t = H.transform(x)
    assert ((t[0] - t[1]) ** 2).sum() == 64 * ((x[0] - x[1]) ** 2).sum()
    assert (t[:, 0] == x.sum(axis=1)).all() and sorted(H.ORDER) == list(range(64))
    wide = H.transform(x * 10_000)
    assert wide.dtype == object and (wide == t.astype(object) * 10_000).all()


def test_assign_equals_full_distances_with_ties():
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (3000, 64))
    c = np.concatenate((x[:4], x[:2], rng.integers(-3, 4, (2, 64))))      # repeated centroids tie everywhere
    best, dist = H.assign(x, c)
    full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()


def test_clusters_equal_plain_distances(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (5, 64))
    rows = [(int(i), [float(v) for v in middle[i % 5] + rng.normal(0, 0.4, 64)]) for i in range(300)]
    assert len(check(spark, rows, extra=True)) == 300


def test_clusters_of_awkward_rows(spark):
    rng = np.random.default_rng(4)
    v = lambda: [float(x) for x in rng.normal(0, 1, 64)]
    one, nan, hole = v(), v(), v()
    nan[3], hole[60] = float("nan"), None
    rows = ([(i, one) for i in range(40)] + [(7, one), (7, one), (None, v()), (None, one), (50, None), (51, []), (52, v()[:63]),
            (53, nan), (54, hole), (55, [0.0] * 64), (56, [float("-inf")] + v()[1:]), (57, [-0.0] * 64), (58, v() + [1.0])]
            + [(60 + i, v()) for i in range(9)])
    assert len(check(spark, rows)) == 40 + 2 + 2 + 2 + 9


@pytest.mark.parametrize("size", [30_000.0, 1e30])
def test_wide_values_stay_exact(spark, size):
    rng = np.random.default_rng(5)
    check(spark, [(i, [float(x) for x in rng.uniform(-size, size, 64)]) for i in range(40)], "double")


def test_few_and_no_vectors(spark):
    assert len(check(spark, [(3, [1.0] * 64), (9, [2.0] * 64)])) == 2
    empty = check(spark, [(1, None), (2, [1.0])])
    assert empty == []
    assert H.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>")).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
