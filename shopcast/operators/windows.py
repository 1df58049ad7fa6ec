"""Per-key first/last, relative order and best-per-user.

First/last and best-per-key are aggregates (``max_by`` / ``min_by`` over a
(value, tie-break) struct) rather than ``row_number`` windows: they combine
map-side, so a key holding a third of the rows is reduced in every task
before the shuffle instead of being sorted inside one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopcast.operators.pieces import running_order

RANGES = 200


def keep_latest(df: DataFrame, keys, order_col: str = "time", tiebreak=(), keep: str = "last") -> DataFrame:
    """One row per key — the latest (``keep='last'``) or earliest row by
    ``order_col``; remaining ties broken by ``tiebreak`` columns."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(order_col), *[F.col(t) for t in tiebreak])
    pick = F.max_by if keep == "last" else F.min_by
    best = pick(F.struct(*[F.col(c) for c in rest]), order).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def relative_order(df: DataFrame, value: str, out: str = "order", partition_by=()) -> DataFrame:
    """Descending 0-based position where ties take the LAST position
    (= number of rows with a value >= this one, minus 1), per partition.

    Computed on the histogram of distinct values (a map-side-combined
    aggregate), whose running total is joined back — rows are never sorted,
    only distinct values are.  With partition keys the histogram is cut into
    range pieces by key and value, so a hot key's values lie in several tasks
    (``running_order``).  Without, the values are cut into ``RANGES`` ranges at
    approximate quantiles: a running total inside each range plus the totals of
    the ranges above it, so no task sees them all.  NULL comes after every
    value."""
    keys = list(partition_by)
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        ranks = running_order(hist, keys, value, "_n", out).withColumnRenamed(value, "_v")
    else:
        cuts = hist.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("c")).first().c
        cuts = sorted(set(cuts or []))
        below = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(value) < c) if cuts else F.array()
        hist = hist.withColumn("_range", F.when(F.col(value).isNull(), len(cuts) + 1).otherwise(F.size(below)))
        # at most RANGES + 1 rows
        sums = hist.groupBy("_range").agg(F.sum("_n").alias("_s"))
        order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.select("_range", (F.sum("_s").over(order) - F.col("_s")).alias("_above"))
        hist = hist.join(F.broadcast(sums), "_range")
        w = (Window.partitionBy("_range").orderBy(F.col(value).desc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranks = hist.select(F.col(value).alias("_v"), (F.sum("_n").over(w) + F.col("_above") - 1).alias(out))
    same = F.col(value).eqNullSafe(F.col("_v"))
    for k in keys:
        ranks = ranks.withColumnRenamed(k, f"_k_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(ranks, same, "left").drop("_v", *[f"_k_{k}" for k in keys])


def top1_per_key(df: DataFrame, key: str = "user_id", item: str = "sku_id", score: str = "label") -> DataFrame:
    """The best-scored item per key; equal scores -> the smaller item."""
    best = F.max_by(F.struct(F.col(item), F.col(score)),
                    F.struct(F.col(score), -F.col(item))).alias("_b")
    return df.groupBy(key).agg(best).select(key, F.col(f"_b.{item}").alias(item), F.col(f"_b.{score}").alias(score))
