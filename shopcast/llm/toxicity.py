"""Toxicity by class-conditional Kneser-Ney models.

Two models of letter sequences inside words, one of toxic and one of ordinary
labelled texts.  The top order (five bytes) has counts of each class with
modified Kneser-Ney discounts; both classes back off to the same Kneser-Ney
distribution of the lower orders, made of the continuation counts of *all*
documents, so an expression that neither class has seen tells nothing.  For
every gram of the corpus the difference of the two log-likelihoods is one
number; a text is scored by that difference per letter over the whole text, per
word over its most toxic stretches of a few words, and of its most toxic words,
and a logistic regression on one fold of the labelled rows turns these into a
probability.

Bounds: at most ``TRAIN_ROWS`` labelled rows (smallest hashes of their ids)
are used for fitting.  The table of scores holds every corpus gram whose context
(the bytes before the last) occurs in those rows, each with its own score; the
score of any other gram is 0, as both classes leave it to the shared back-off.
Counts behind the back-off cover every document.

Defined cases: a null or empty text, and one without letters, has differences
of zero.  Repeated label rows count once per document, the higher label wins;
null labels are no labels.  Without both classes among the labels every score
is 0.0.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .tables import written

ORDER = 5
STRETCHES, RANKS = (1, 2, 3, 5), (2, 3, 5)
FEATURES = 2 + len(STRETCHES) + len(RANKS)
TRAIN_ROWS = 50_000
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4


def fold_of(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo the number of folds; a null id is held out."""
    return HELD_OUT if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def grams(raw: np.ndarray, off: np.ndarray, order: int = ORDER
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last ``order`` bytes (packed) at each letter, the word of each letter, first word of each text."""
    starts, ends, first = T.word_bounds(raw, off, T.IS_LETTER)
    at = np.flatnonzero(T.IS_LETTER[raw])
    word = np.repeat(np.arange(len(starts)), ends - starts)
    since = at - starts[word]
    low = T.LOWER[raw].astype(np.int64)
    key = np.zeros(len(at), np.int64)
    for back in range(order - 1, -1, -1):
        key = key << 8 | np.where(since >= back, low[np.maximum(at - back, 0)], 0x20)
    return key, word, first


def _count(batches: Iterator[pa.RecordBatch], label: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Gram counts of a task's texts: of all, of toxic and of ordinary labelled ones."""
    kept = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)

    def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(keys, return_inverse=True)
        out = np.zeros((len(keys), 3), np.int64)
        np.add.at(out, inverse, counts)
        return keys, out

    for batch in batches:
        for part in T.slices(batch, "text"):
            key, word, first = grams(*T.string_bytes(part.column("text")))
            cls = np.array([label.get(i, -1) for i in part.column("doc_id").to_pylist()])
            of = cls[np.repeat(np.arange(len(cls)), np.diff(first))[word]] if len(key) else np.zeros(0, np.int64)
            u, inverse = np.unique(key, return_inverse=True)
            counts = np.stack([np.bincount(inverse, of == c if c >= 0 else None, len(u)) for c in (-1, 1, 0)], axis=1)
            kept = merge(np.concatenate((kept[0], u)), np.concatenate((kept[1], counts.astype(np.int64))))
            if len(kept[0]) > 1 << 20:
                yield _rows(*kept)
                kept = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    yield _rows(*kept)


def _rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys)] + [pa.array(counts[:, i].copy()) for i in range(3)],
                                      names=["g", "n", "toxic", "ordinary"])


def _discounts(row: dict, name: str) -> list[float]:
    """Modified Kneser-Ney discounts of counts one, two and more, from the counts of counts."""
    c = [max(1, row[f"{name}{i}"] or 0) for i in (1, 2, 3, 4)]
    y = c[0] / (c[0] + 2 * c[1])
    return [min(max(i - (i + 1) * y * c[i] / c[i - 1], 0.1), i - 0.01) for i in (1, 2, 3)]


def gram_scores(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, n, score) of every gram: log P(last byte | the others) under the toxic model less the ordinary one."""
    low = None    # (g, p) of the next lower order
    for size in range(1, order):
        # continuation counts: how many different bytes stand before the gram
        above = counts.select(F.col("g").bitwiseAND((1 << 8 * (size + 1)) - 1).alias("x")).distinct()
        cont = above.groupBy(F.col("x").bitwiseAND((1 << 8 * size) - 1).alias("g")).agg(F.count("*").alias("c"))
        ctx = cont.groupBy(F.shiftright("g", 8).alias("ctx")).agg(F.sum("c").alias("t"), F.count("*").alias("k"))
        cont = cont.withColumn("ctx", F.shiftright("g", 8)).join(ctx, "ctx")
        if low is None:
            cont = cont.withColumn("p", F.lit(1 / 256))
        else:
            cont = cont.withColumn("lower", F.col("g").bitwiseAND((1 << 8 * (size - 1)) - 1)).join(
                low.select(F.col("g").alias("lower"), "p"), "lower")
        low = written(cont.selectExpr("g", "greatest(c - 0.75D, 0D) / t + 0.75D * k / t * p AS p"), "toxicity-lower")
    row = counts.agg(*(F.count(F.when(F.col(c) == i, 1)).alias(f"{c}{i}")
                       for c in ("toxic", "ordinary") for i in (1, 2, 3, 4))).first().asDict()
    top = counts.withColumn("ctx", F.shiftright("g", 8))
    for c in ("toxic", "ordinary"):
        d = _discounts(row, c)
        top = top.withColumn(f"d_{c}", F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d[0])
                             .when(F.col(c) == 2, d[1]).otherwise(d[2]))
    ctx = top.groupBy("ctx").agg(*(F.sum(x).alias(f"sum_{x}") for x in ("toxic", "ordinary", "d_toxic", "d_ordinary")))
    top = (top.join(ctx, "ctx").withColumn("lower", F.col("g").bitwiseAND((1 << 8 * (order - 1)) - 1))
           .join(low.select(F.col("g").alias("lower"), "p"), "lower"))
    logs = {c: F.log(F.when(F.col(f"sum_{c}") > 0, (F.col(c) - F.col(f"d_{c}") + F.col(f"sum_d_{c}") * F.col("p"))
                            / F.col(f"sum_{c}")).otherwise(F.col("p"))) for c in ("toxic", "ordinary")}
    return top.select("g", "n", (logs["toxic"] - logs["ordinary"]).alias("score"))


def score_table(scores: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams and their scores, those of 0 left out; contexts that no fitted row has do not reach the driver."""
    rows = scores.where("score <> 0").select("g", F.col("score").cast("float").alias("score")).toArrow()
    g, score = rows["g"].to_numpy(), rows["score"].to_numpy()
    order = np.argsort(g)
    return g[order], score[order]


def scores_of(key: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The score of each gram, looked up exactly; 0 of grams that are not in the table."""
    g, score = table
    if not len(g):
        return np.zeros(len(key), np.float32)
    at = np.minimum(np.searchsorted(g, key), len(g) - 1)
    return np.where(g[at] == key, score[at], np.float32(0))


def features(raw: np.ndarray, off: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per text: difference per letter; per word of the most toxic stretch of each length; of the
    second, third ... most toxic words; logarithm of the number of words."""
    key, word, first = grams(raw, off)
    n = len(off) - 1
    out = np.zeros((n, FEATURES))
    if not len(key):
        return out
    letters = np.bincount(word, minlength=first[-1])
    by_word = np.bincount(word, scores_of(key, table), minlength=first[-1])
    owner = np.repeat(np.arange(n), np.diff(first))
    out[:, 0] = np.bincount(owner, by_word, n) / np.maximum(np.bincount(owner, letters, n), 1)
    sums = np.concatenate(([0.0], np.cumsum(by_word)))
    for i, words in enumerate(STRETCHES, 1):
        end = np.minimum(np.arange(len(owner)) + words, first[owner + 1])
        begin = np.maximum(end - words, first[owner])
        best = np.full(n, -np.inf)
        np.maximum.at(best, owner, (sums[end] - sums[begin]) / (end - begin))
        out[:, i] = np.where(np.isfinite(best), best, 0.0)
    ranked = by_word[np.lexsort((by_word, owner))]
    for i, rank in enumerate(RANKS, 1 + len(STRETCHES)):
        some = np.diff(first) >= rank
        out[some, i] = ranked[first[1:][some] - rank]
    out[:, -1] = np.log1p(np.diff(first))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (last one: intercept) of a logistic regression on standardised columns, by Newton steps."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mean) / std, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    keep = np.diag([ridge * len(x)] * (z.shape[1] - 1) + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w += np.clip(step, -2, 2)
    w[:-1] /= std
    w[-1] -= w[:-1] @ mean
    return w


def training_rows(labels: DataFrame, most: int = TRAIN_ROWS) -> dict[int, int]:
    """Label by id of at most ``most`` labelled rows outside the held-out fold."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
            .dropna().where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT)
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)).toArrow()
    return dict(zip(rows["doc_id"].to_pylist(), rows["toxic"].to_pylist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[Broadcast, np.ndarray]:
    """The score table (broadcast, bounded by the contexts of the fitted rows) and the logistic weights (zeros if a class is missing)."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    label = training_rows(labels, train_rows)
    known = spark.sparkContext.broadcast({i: y for i, y in label.items() if fold_of(i) != CALIBRATE})
    counts = written(src.mapInArrow(lambda b: _count(b, known.value), "g long, n long, toxic long, ordinary long")
                     .groupBy("g").agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "ordinary"))), "toxicity-counts")
    table = spark.sparkContext.broadcast(score_table(gram_scores(counts)))
    for fold in (True, False):   # the calibration fold, or all labelled rows if it lacks a class
        use = {i: y for i, y in label.items() if fold_of(i) == CALIBRATE or not fold}
        if len(set(use.values())) < 2:
            continue
        ids = spark.createDataFrame(pd.DataFrame({"doc_id": list(use), "toxic": list(use.values())}))
        rows = _measured(src.join(F.broadcast(ids.select("doc_id")), "doc_id"), table).groupBy("doc_id").agg(
            F.max("x").alias("x")).toArrow()
        y = np.array([use[i] for i in rows["doc_id"].to_pylist()])
        if len(set(y.tolist())) == 2:
            return table, logistic(np.array(rows["x"].to_pylist()), y)
    return table, np.zeros(FEATURES + 1)


def _measured(src: DataFrame, table: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                x = features(*T.string_bytes(part.column("text")), table.value)
                cuts = pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(cuts, pa.array(x.ravel()))],
                                                 names=["doc_id", "x"])

    return src.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -700, 700))) if w.any() else np.zeros(len(x))


def scored(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the text is never shuffled."""
    table, w = fit(docs, labels, train_rows)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))
    z = sum((F.col("x")[i] * float(v) for i, v in enumerate(w[:-1])), F.lit(float(w[-1])))
    score = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-700.0)), F.lit(700.0)))) if w.any() else F.lit(0.0)
    return _measured(src, table).select("doc_id", held.alias("held_out"), score.alias("score")).selectExpr(
        "doc_id", "held_out", "score", "CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted")


def clean(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns; the text is never shuffled."""
    table, w = fit(docs, labels)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text_col):
                x = features(*T.string_bytes(part.column(where)), table.value)
                yield part.filter(pa.array(probability(x, w) < 0.5))

    return docs.mapInArrow(run, docs.schema)
