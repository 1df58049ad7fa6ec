"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are standardised and mapped to ``FEATURES`` cosines
that approximate a Gaussian kernel.  Each partition sums its share of the
normal equations; only the sums (bounded by the number of features) reach the
driver.  The two halves of the training rows score each other, isotonic
regression over those scores (counted in ``BINS`` bins) makes probabilities, and
the final weights come from both halves.

Defined cases: a null text is the empty text, whose statistics are zeros.
Repeated label rows count once per document, the higher label wins; null labels
are no labels.  Without both classes among the training labels every score is
0.5.  Other columns are ignored: labels, language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .tables import written

FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1e-3, 2048
FOLDS, HELD_OUT = 3, 1


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


CLASSES = {
    "upper": _is(bytes(range(65, 91))), "lower": _is(bytes(range(97, 123))), "digit": _is(b"0123456789"),
    "space": T.IS_SPACE, "line": _is(b"\n"), "stop": _is(b".?!"), "shout": _is(b"!"), "comma": _is(b",;:"),
    "symbol": _is(b"#$%&*+/<=>@\\^_~"), "bar": _is(b"|"), "bracket": _is(b"()[]{}\"'"), "other": _is(bytes(range(128, 256))),
}
NAMES = [*CLASSES, "length", "words", "word_length", "word_spread", "longest", "distinct", "repeats", "distinct_pairs",
         "lines", "distinct_lines", "capitals"]


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of different values of each owner (owners ascend)."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])))
    return np.bincount(o[new], minlength=n).astype(float)


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of numbers for each text, all computed from its bytes."""
    n, size = len(off) - 1, np.maximum(np.diff(off), 1)
    out = {}
    for name, table in CLASSES.items():
        sums = np.concatenate(([0], np.cumsum(table[raw], dtype=np.int64)))
        out[name] = (sums[off[1:]] - sums[off[:-1]]) / size
    words, starts, ends, first = T.word_hashes(raw, off)
    count = np.diff(first)
    owner, some = np.repeat(np.arange(n), count), np.maximum(count, 1)
    length = (ends - starts).astype(float)
    out["length"], out["words"] = np.log1p(np.diff(off)), np.log1p(count)
    mean = np.bincount(owner, length, n) / some
    out["word_length"] = np.log1p(mean)
    out["word_spread"] = np.sqrt(np.maximum(np.bincount(owner, length ** 2, n) / some - mean ** 2, 0)) / (1 + mean)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    out["longest"] = np.log1p(longest)
    out["distinct"] = _distinct(words, owner, n) / some
    same = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1]))
    out["repeats"] = np.bincount(owner[same], minlength=n) / some
    pairs, pair_owner = T.shingle_hashes(words, first, 2)
    out["distinct_pairs"] = _distinct(pairs, pair_owner, n) / np.maximum(np.bincount(pair_owner, minlength=n), 1)
    l_starts, l_ends, l_first = T.word_bounds(raw, off, ~CLASSES["line"])
    l_count = np.diff(l_first)
    out["lines"] = l_count / some
    lines = T.mix(T.range_hashes(T.prefix_sums(raw), l_starts, l_ends))
    out["distinct_lines"] = _distinct(lines, np.repeat(np.arange(n), l_count), n) / np.maximum(l_count, 1)
    out["capitals"] = np.bincount(owner[CLASSES["upper"][raw[starts]]], minlength=n) / some
    return np.column_stack([out[name] for name in NAMES]).astype(float)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x: array of statistics) of every row; no shuffle."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                x = statistics(*T.string_bytes(part.column("text"))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(x)], names=["doc_id", "x"])

    return src.mapInArrow(run, "doc_id long, x array<float>")


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def cosines(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Random Fourier features (and a constant) of statistics; the same draw everywhere."""
    rng = np.random.default_rng(9)
    w = rng.normal(size=(x.shape[1], FEATURES)) / WIDTH
    z = np.clip((x - mean) / std, -8, 8)
    return np.column_stack((np.cos(z @ w + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2 / FEATURES), np.ones(len(x))))


def _equations(rows: DataFrame, mean: np.ndarray, std: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """X'X and X'y of each half of the training rows, summed in the partitions and then by matrix row."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = cosines(_matrix(batch.column("x")), mean, std)
            y, half = batch.column("y").to_numpy().astype(float), batch.column("half").to_numpy()
            for h in (0, 1):
                zh = z[half == h]
                sums[h] = sums.get(h, 0) + zh.T @ np.column_stack((zh, y[half == h]))
        for h, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), h)), pa.array(np.arange(len(m))), _lists(m)],
                                             names=["half", "i", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"half": pdf["half"][:1], "i": pdf["i"][:1], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    schema = "half long, i long, v array<double>"
    got = rows.mapInArrow(part, schema).groupBy("half", "i").applyInPandas(add, schema).toPandas()
    out = {}
    for h, g in got.groupby("half"):
        m = np.stack(g.sort_values("i")["v"].to_list())
        out[int(h)] = (m[:, :-1], m[:, -1])
    return out


def _ridge(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    return np.linalg.solve(xx + np.eye(len(xx)) * (RIDGE * xx[-1, -1] + 1e-9), xy)


def isotonic(x: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x: (x, non-decreasing rate) knots."""
    blocks: list[list[float]] = []
    for xi, t, g in zip(x, total, good, strict=True):
        blocks.append([xi, xi, t, g])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
    return (np.array([v for b in blocks for v in (b[0], b[1])]),
            np.array([r for b in blocks for r in [(b[3]) / (b[2])] * 2]))


def _bin(raw: Column) -> Column:
    return F.floor(F.least(F.greatest(raw, F.lit(-0.5)), F.lit(1.4999)) * (BINS // 2)) + BINS // 4


def _with_raw(rows: DataFrame, weights: dict[int, np.ndarray], mean: np.ndarray, std: np.ndarray,
              keep: list[str]) -> DataFrame:
    """``keep`` columns and ``raw``: the regression's value under the weights of the row's half (-1: of both)."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z, half = cosines(_matrix(batch.column("x")), mean, std), batch.column("half").to_numpy()
                raw = np.zeros(len(z))
                for h, w in weights.items():
                    raw = np.where(half == h, z @ w, raw)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(raw)], names=[*keep, "raw"])

    return rows.mapInArrow(run, f"{kinds}, raw double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the text is read once and never shuffled."""
    stats = written(document_statistics(docs), "quality-statistics")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).dropna()
             .where(fold != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y")))
    train = written(stats.join(known, "doc_id").select("x", "y", (fold == 2).cast("long").alias("half")), "quality-training")
    m = train.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("mean"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("std")).orderBy("i").toPandas()
    held = F.coalesce(fold == HELD_OUT, F.lit(True)).alias("held_out")
    classes = train.agg(F.min("y"), F.max("y")).first()
    if not len(m) or classes[0] == classes[1]:
        return stats.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    mean, std = m["mean"].to_numpy(), m["std"].to_numpy() + 1e-6
    eq = _equations(train, mean, std)
    both = _ridge(sum(e[0] for e in eq.values()), sum(e[1] for e in eq.values()))
    cross = {h: _ridge(*eq[1 - h]) if 1 - h in eq else both for h in eq}
    counted = _with_raw(train, cross, mean, std, ["y"]).groupBy(_bin(F.col("raw")).alias("b")).agg(
        F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("b").toPandas()
    x, rate = isotonic((counted["b"].to_numpy() - BINS // 4 + 0.5) / (BINS // 2), counted["n"].to_numpy(), counted["good"].to_numpy())

    @F.pandas_udf("double")
    def calibrated(raw: pd.Series) -> pd.Series:
        v = raw.to_numpy()   # pooled values keep the regression's order by a thousandth of the score
        return pd.Series(0.999 * np.interp(v, x, rate) + 0.001 * np.clip((v + 1) / 3, 0, 1))

    raw = _with_raw(stats.withColumn("half", F.lit(-1).cast("long")), {-1: both}, mean, std, ["doc_id"])
    out = raw.select("doc_id", held, calibrated("raw").alias("score"), "raw")
    return out.selectExpr("doc_id", "held_out", "score", "CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted", "raw")
