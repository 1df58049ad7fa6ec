"""Model steps on Spark ML (M4–M8).

The source trains gradient-boosted trees with a single-machine library; here
the same steps are Spark ML tree fits on the feature DataFrames (distributed
tree building, no rows collected to the driver): M5 with ``GBTClassifier``,
M6–M8 with the second-order rounds of ``boosting``.

Spark ML rejects NaN / NULL in feature vectors.  ``boosting`` lets a split send
them to either side; for M5 they are filled first (``impute_mean``, ``prepare``).
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.operators.boosting import Boosted, binned, fit_all, fit_binned, fit_boosted, predict_all, remove_binned
from shopcast.operators.sampling import split_bucket
from shopcast.sources.files import staged

SENTINEL = -1.0
BIG = 1e12


def prepare(df: DataFrame, cols, sentinel: float = SENTINEL) -> DataFrame:
    """NULL/NaN -> sentinel, ±inf -> ±BIG, all features as double."""
    out = []
    for c in df.columns:
        if c in cols:
            x = F.col(f"`{c}`").cast("double")
            x = (F.when(x.isNull() | F.isnan(x), F.lit(sentinel))
                  .when(x == float("inf"), F.lit(BIG)).when(x == float("-inf"), F.lit(-BIG)).otherwise(x))
            out.append(x.alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def impute_mean(df: DataFrame, cols) -> DataFrame:
    """M4: NULL -> column mean.  The means are one aggregate row (bounded by
    the number of columns)."""
    cols = list(cols)
    row = df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols]).first()
    fills = {c: float(row[c]) for c in cols if row[c] is not None}
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fills[c])).alias(c)
                       if c in fills else F.col(f"`{c}`") for c in df.columns])


VECTOR_BYTES = 4 << 20      # values that a task should at least have


def _vectors(df: DataFrame, cols, label: str) -> DataFrame:
    """(features, label), dealt evenly to as many tasks as there are cores or parts (a part of a file may hold no
    rows), as long as each has ``VECTOR_BYTES``; a smaller table stays as it is."""
    df = _assemble(df, cols).select("features", F.col(label).cast("double").alias(label))
    one = df.select(label)      # cheap to plan, and in as many parts
    parts = one.rdd.getNumPartitions()
    wanted = min(max(df.sparkSession.sparkContext.defaultParallelism, parts), one.count() * 8 * len(cols) // VECTOR_BYTES)
    return df.repartition(wanted) if 1 < wanted >= parts else df


def _assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    # backticks: feature names may start with digits
    safe = {c: f"f_{i}" for i, c in enumerate(cols)}
    renamed = df.select("*", *[F.col(f"`{c}`").alias(safe[c]) for c in cols])
    return VectorAssembler(inputCols=[safe[c] for c in cols], outputCol=out).transform(renamed) \
        .drop(*safe.values())


def fit_gbt(train: DataFrame, cols, label: str = "label", max_depth: int = 6, max_iter: int = 100, step: float = 1.0,
            seed: int = 0):
    """M5: one Spark ML boosted-tree classifier on filled features.

    The vectors are written once: every level of every tree ships its plan to
    the tasks, and that of a scan of two columns is small whatever the number of
    features."""
    df = staged(_vectors(prepare(train, cols), cols, label), "gbt-vectors")
    return GBTClassifier(featuresCol="features", labelCol=label, maxDepth=max_depth, maxIter=max_iter, stepSize=step,
                         seed=seed, maxBins=32).fit(df)


def importances(model, cols) -> list[tuple[str, float]]:
    imp = model.featureImportances.toArray()
    return [(c, float(v)) for c, v in zip(cols, imp)]


def importance_table(spark, model, cols) -> DataFrame:
    """M5 helper: (feature, importance) — one row per feature (bounded by
    the schema, not the data)."""
    return spark.createDataFrame(importances(model, cols), "feature string, importance double")


def fit_user_model(train: DataFrame, cols, label: str = "label", rounds: int = 100) -> Boosted:
    """M6: depth 3, hessian sum of a node at least 4, positive weight = negatives/16/positives."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    return fit_boosted(train, cols, label, rounds=rounds, depth=3, rate=0.1, min_child_weight=4,
                       pos_weight=(neg / 16.0 / pos) if pos else 1.0)


def fit_predict_boosted(train: DataFrame, test: DataFrame, cols, label: str = "label", max_iter: int = 100) -> DataFrame:
    """M6: the user model's probability of class 1 for the rows of ``test``."""
    return fit_user_model(train, cols, label, max_iter).predict(test)


def fit_stopped(train: DataFrame, cols, label: str = "label", max_iter: int = 1000, max_depth: int = 5, step: float = 0.05,
                columns: float = 0.8, patience: int = 50, seed: int = 0, keys=("user_id", "sku_id")) -> Boosted:
    """M7 / M8: trees that each see ``columns`` of the features, until the AUC
    on a stable 20 % of the rows (M3) has not risen for ``patience`` rounds."""
    cols = list(cols)
    return fit_all_stopped(train, cols, [cols], label, max_iter, max_depth, step, columns, patience, seed, keys)[0]


def fit_all_stopped(train: DataFrame, cols, subsets, label: str = "label", max_iter: int = 1000, max_depth: int = 5,
                    step: float = 0.05, columns: float = 0.8, patience: int = 50, seed: int = 0,
                    keys=("user_id", "sku_id")) -> list[Boosted]:
    """``fit_stopped`` for each of ``subsets`` of the features ``cols``."""
    return fit_all(train, cols, subsets, label, validation=_held(seed, keys),
                   **_stopped(max_iter, max_depth, step, columns, patience, seed))


def _held(seed: int, keys) -> Column:
    """M3: the stable 20 % of the rows."""
    return split_bucket(seed, list(keys)) == 0


def _stopped(max_iter: int, max_depth: int, step: float, columns: float, patience: int, seed: int) -> dict:
    """M7 / M8 as options of ``boosting``."""
    return dict(rounds=max_iter, depth=max_depth, rate=step, min_child_weight=1, columns=columns, patience=patience, seed=seed)


def importance_partition(model: Boosted, spark) -> tuple[list[str], list[str]]:
    """M7: features that the model's trees split on, and the rest."""
    splits = {r.feature: r.splits for r in model.split_counts(spark).collect()}     # one row a feature
    return [c for c in model.features.names if splits[c]], [c for c in model.features.names if not splits[c]]


@dataclass(frozen=True)
class Member:
    """One model of the ensemble: its weight and its fit."""
    weight: float
    model: Boosted


def fit_ensemble(train: DataFrame, cols, label: str = "label", weights=(0.3,) + (0.07,) * 10, frac: float = 0.4, seed: int = 0,
                 max_iter: int = 1000, max_depth: int = 5, step: float = 0.05, columns: float = 0.8, patience: int = 50,
                 keys=("user_id", "sku_id"), parallelism: int = 4) -> list[Member]:
    """M8: model 0 on the important features (weight 0.3) and 10 models on
    seeded random 40 % subsets of the other features (0.07 each).  The
    independent fits grow side by side, ``parallelism`` at a time: one pass
    serves a level of all of them, or a task each.  All fits, also that
    of M7, read the same blocks."""
    cols, spark = list(cols), train.sparkSession
    options = _stopped(max_iter, max_depth, step, columns, patience, seed)
    data = binned(train, cols, label, 1.0, _held(seed, keys), 256)
    important, trivial = importance_partition(fit_binned(spark, data, [cols], **options)[0], spark)
    rng = random.Random(seed)
    subsets = []
    for i in range(len(weights)):
        if i == 0:
            subsets.append(important or cols)
        else:
            k = max(1, int(len(trivial) * frac))
            subsets.append(sorted(rng.sample(trivial, k)) if len(trivial) >= k else (trivial or cols))
    at_once = max(1, parallelism)
    models = [m for i in range(0, len(subsets), at_once) for m in fit_binned(spark, data, subsets[i:i + at_once], **options)]
    remove_binned(spark, data)
    return [Member(float(w), m) for w, m in zip(weights, models, strict=True)]


def score_ensemble(members: list[Member], test: DataFrame) -> DataFrame:
    """``test`` with ``label``: the weighted sum of the members' probabilities."""
    scored = predict_all([m.model for m in members], test, [f"_p{i}" for i in range(len(members))])
    total = sum((F.lit(m.weight) * F.col(f"_p{i}") for i, m in enumerate(members)), F.lit(0.0))
    return scored.withColumn("label", total).drop(*[f"_p{i}" for i in range(len(members))])


def subspace_ensemble(train: DataFrame, test: DataFrame, cols, **options) -> DataFrame:
    """M8: ``fit_ensemble`` on ``train``, ``score_ensemble`` on ``test``."""
    return score_ensemble(fit_ensemble(train, cols, **options), test)
