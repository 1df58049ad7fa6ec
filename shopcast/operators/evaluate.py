"""Metrics (E1–E4) and ranking helpers.

Every metric is an aggregate over a tagged union of predictions and truth
grouped by key — no join, no driver loop, no cross join — so it scales with
both inputs and a hot key is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUC_RANGES = 200


def _metric_frame(pred: DataFrame, truth: DataFrame, keys, pred_dedup: bool) -> DataFrame:
    keys = list(keys)
    p = pred.select(*keys, F.lit(1).alias("_p"), F.lit(0).alias("_t"))
    t = truth.select(*keys, F.lit(0).alias("_p"), F.lit(1).alias("_t"))
    g = p.unionByName(t).groupBy(*keys).agg(
        (F.max("_p") if pred_dedup else F.sum("_p")).alias("np"), F.max("_t").alias("t"))
    return g.agg(F.sum("np").cast("long").alias("predicted"),
                 F.sum("t").cast("long").alias("actual"),
                 F.sum(F.col("np") * F.col("t")).cast("long").alias("hits"))


def _pr(hits, predicted, actual):
    p = F.try_divide(hits.cast("double"), predicted.cast("double"))
    r = F.try_divide(hits.cast("double"), actual.cast("double"))
    return p, r


def f11(pred_users: DataFrame, truth_users: DataFrame) -> DataFrame:
    """Precision / recall over distinct users; F11 = 6PR / (5R + P);
    0.0 when there is no hit."""
    m = _metric_frame(pred_users, truth_users, ["user_id"], True)
    p, r = _pr(F.col("hits"), F.col("predicted"), F.col("actual"))
    f = F.when(F.col("hits") > 0, F.lit(6.0) * p * r / (F.lit(5.0) * r + p)).otherwise(F.lit(0.0))
    return m.select("hits", "predicted", "actual", F.coalesce(p, F.lit(0.0)).alias("precision"),
                    F.coalesce(r, F.lit(0.0)).alias("recall"), f.alias("f11"))


def f12_score(pred_pairs: DataFrame, truth_pairs: DataFrame) -> DataFrame:
    """F11 on users plus F12 = 5PR / (2R + 3P) on (user, sku) pairs
    (prediction pairs counted with multiplicity); score = 0.4 F11 + 0.6 F12."""
    u = f11(pred_pairs.select("user_id"), truth_pairs.select("user_id"))
    m = _metric_frame(pred_pairs, truth_pairs.select("user_id", "sku_id").distinct(), ["user_id", "sku_id"], False)
    p, r = _pr(F.col("hits"), F.col("predicted"), F.col("actual"))
    f12 = F.when(F.col("hits") > 0, F.lit(5.0) * p * r / (F.lit(2.0) * r + F.lit(3.0) * p)).otherwise(F.lit(0.0))
    pairs = m.select(F.col("hits").alias("pair_hits"), f12.alias("f12"))
    # two single-row results side by side: union with NULL padding, then one
    # aggregate (no join)
    cols = u.columns + pairs.columns
    both = u.unionByName(pairs, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in cols])
    return both.withColumn("score", F.lit(0.4) * F.col("f11") + F.lit(0.6) * F.col("f12"))


def auc_by(df: DataFrame, by, score: Column, positive: Column) -> DataFrame:
    """Area under the ROC curve per group of ``by`` (at least one column
    without NULLs; few groups: rounds, models): the share of (positive, negative) pairs with the positive above,
    ties counting half; with the class counts.  NULL without both classes.
    Rows without a score take no part.

    On the histogram of distinct scores (a map-side-combined aggregate).  The
    scores of a group are cut into ``AUC_RANGES`` ranges at approximate
    quantiles: negatives below are counted inside each range, and the ranges'
    totals are added over at most that many rows a group."""
    by = list(by)
    hist = (df.select(*by, score.alias("_s"), positive.cast("int").alias("_y")).where("_s IS NOT NULL")
            .groupBy(*by, "_s").agg(F.sum(F.coalesce("_y", F.lit(0))).alias("_p"), F.count(F.lit(1)).alias("_n"))
            .withColumn("_n", F.col("_n") - F.col("_p")))
    cuts = hist.groupBy(*by).agg(F.percentile_approx("_s", [i / AUC_RANGES for i in range(1, AUC_RANGES)], 10_000).alias("_cuts"))
    # one row a group, with AUC_RANGES - 1 numbers
    hist = hist.join(F.broadcast(cuts), by).withColumn(
        "_range", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col("_s")))).drop("_cuts")
    inside = Window.partitionBy(*by, "_range").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    parts = (hist.withColumn("_below", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
             .groupBy(*by, "_range").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"),
                                         F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_won")))
    lower = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_won", F.col("_won") + F.col("_p") * F.coalesce(F.sum("_n").over(lower), F.lit(0)))
    return parts.groupBy(*by).agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), F.sum("_won").alias("_won")).select(
        *by, "positives", "negatives", F.try_divide("_won", F.col("positives") * F.col("negatives")).alias("auc"))


def ranked_top(df: DataFrame, k: int, order, rank_col: str = "rank") -> DataFrame:
    """L1: the first ``k`` rows by ``order`` (a bounded TakeOrdered), with
    their 1-based rank (a window over at most ``k`` rows)."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def cutoff_sweep(pred: DataFrame, truth: DataFrame, cutoffs, order, keys=("user_id",)) -> DataFrame:
    """Metrics for every prefix length in ``cutoffs`` from one ranked
    top-``max(cutoffs)`` list — one aggregate per key of the tagged union,
    then one conditional aggregate per cutoff."""
    keys = list(keys)
    top = ranked_top(pred, max(cutoffs), order).select(*keys, "rank", F.lit(0).alias("_t"))
    t = truth.select(*keys, F.lit(None).cast("int").alias("rank"), F.lit(1).alias("_t"))
    per_key = top.unionByName(t).groupBy(*keys).agg(F.min("rank").alias("rank"), F.max("_t").alias("_t"))
    aggs = [F.sum("_t").cast("long").alias("actual")]
    for c in cutoffs:
        aggs.append(F.count(F.when(F.col("rank") <= c, 1)).alias(f"pred_{c}"))
        aggs.append(F.count(F.when((F.col("rank") <= c) & (F.col("_t") == 1), 1)).alias(f"hits_{c}"))
    m = per_key.agg(*aggs)
    rows = []
    for c in cutoffs:
        h, pn, a = F.col(f"hits_{c}").cast("double"), F.col(f"pred_{c}").cast("double"), F.col("actual").cast("double")
        p, r = F.try_divide(h, pn), F.try_divide(h, a)
        f = F.when(h > 0, F.lit(6.0) * p * r / (F.lit(5.0) * r + p)).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(c).alias("cutoff"), F.col(f"hits_{c}").alias("hits"),
                             F.col(f"pred_{c}").alias("predicted"), F.col("actual"), f.alias("f11")))
    return m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pair_cutoff_sweep(pred: DataFrame, truth: DataFrame, cutoffs, order) -> DataFrame:
    """E3 on pairs: F11 over the users and F12 over the (user, sku) pairs of
    every prefix of the ranked predictions, and score = 0.4 F11 + 0.6 F12.

    One ranked top-``max(cutoffs)`` list; per user and per pair one aggregate
    of the tagged union with the truth, then one conditional aggregate each."""
    top = ranked_top(pred, max(cutoffs), order).select("user_id", "sku_id", "rank", F.lit(0).alias("_t"))
    t = truth.select("user_id", "sku_id").distinct().select("user_id", "sku_id", F.lit(None).cast("int").alias("rank"),
                                                            F.lit(1).alias("_t"))
    both = top.unionByName(t)
    sides = []
    for side, keys in (("user", ["user_id"]), ("pair", ["user_id", "sku_id"])):
        per_key = both.groupBy(*keys).agg(F.min("rank").alias("rank"), F.max("_t").alias("_t"))
        aggs = [F.sum("_t").cast("long").alias(f"{side}_actual")]
        for c in cutoffs:
            seen = F.col("rank") <= c
            aggs += [F.count(F.when(seen, 1)).alias(f"{side}_pred_{c}"),
                     F.count(F.when(seen & (F.col("_t") == 1), 1)).alias(f"{side}_hits_{c}")]
        sides.append(per_key.agg(*aggs))
    cols = sides[0].columns + sides[1].columns
    m = sides[0].unionByName(sides[1], allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in cols])

    def measure(side: str, c: int, a: float, b: float, d: float):
        h = F.col(f"{side}_hits_{c}")
        p, r = _pr(h, F.col(f"{side}_pred_{c}"), F.col(f"{side}_actual"))
        return F.when(h > 0, F.lit(a) * p * r / (F.lit(b) * r + F.lit(d) * p)).otherwise(F.lit(0.0))

    rows = [F.struct(F.lit(c).alias("cutoff"), F.col(f"user_hits_{c}").alias("user_hits"),
                     F.col(f"user_pred_{c}").alias("users_predicted"), F.col("user_actual").alias("users_actual"),
                     F.col(f"pair_hits_{c}").alias("pair_hits"), F.col(f"pair_pred_{c}").alias("pairs_predicted"),
                     F.col("pair_actual").alias("pairs_actual"), measure("user", c, 6.0, 5.0, 1.0).alias("f11"),
                     measure("pair", c, 5.0, 2.0, 3.0).alias("f12")) for c in cutoffs]
    out = m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("score", F.lit(0.4) * F.col("f11") + F.lit(0.6) * F.col("f12"))


def importance_topn(importance: DataFrame, dim: int) -> DataFrame:
    """L3: features with importance > 0, best first, the first ``dim``."""
    return (importance.filter(F.col("importance") > 0)
                      .orderBy(F.col("importance").desc(), F.col("feature")).limit(dim))
