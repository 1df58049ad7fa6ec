"""Deterministic sampling and splitting (M1–M3).

Randomness comes from ``md5(seed:key)`` so results are independent of
partitioning, executor loss and re-execution (``rand()`` and
``randomSplit`` are not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_hash(seed: int, keys) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def split_bucket(seed: int, keys, buckets: int = 5) -> Column:
    """M3: stable bucket ``conv(first 8 hex of md5, 16, 10) % buckets``."""
    return (F.conv(F.substring(key_hash(seed, keys), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def train_eval_split(df: DataFrame, keys, seed: int = 0, eval_bucket: int = 0, buckets: int = 5):
    """M3: 80/20 split (bucket ``eval_bucket`` of 5 is the evaluation part)."""
    b = split_bucket(seed, keys, buckets)
    return df.filter(b != eval_bucket), df.filter(b == eval_bucket)


def shuffle_rows(df: DataFrame, keys, seed: int = 0) -> DataFrame:
    """M2: seeded shuffle = a range-partitioned sort by the key hash."""
    return df.orderBy(key_hash(seed, keys), *keys)


def first_n_by_hash(df: DataFrame, keys, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest ``md5(seed:key)`` — exact, without a
    single-task global sort or limit.

    Hashes are bucketed by their first 4 hex digits (65,536 buckets, a fixed
    bound).  A running total over the bucket histogram (at most 65,536 rows)
    finds the buckets entirely inside the first ``n`` rows; only the one
    boundary bucket (~n/65,536 rows of uniformly spread hashes) is ranked."""
    h = key_hash(seed, keys)
    x = df.withColumn("_h", h).withColumn("_bk", F.substring("_h", 1, 4))
    hist = x.groupBy("_bk").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.select("_bk", "_cnt", (F.sum("_cnt").over(w) - F.col("_cnt")).alias("_before"))
    hist = hist.filter(F.col("_before") < n)
    y = x.join(F.broadcast(hist), "_bk", "inner")
    full = y.filter(F.col("_before") + F.col("_cnt") <= n)
    edge = y.filter(F.col("_before") + F.col("_cnt") > n)
    rk = F.row_number().over(Window.partitionBy("_bk").orderBy("_h", *keys))
    edge = edge.withColumn("_rk", rk).filter(F.col("_before") + F.col("_rk") <= n).drop("_rk")
    return full.unionByName(edge).drop("_h", "_bk", "_cnt", "_before")


def downsample_negatives(df: DataFrame, keys, label: str = "label", ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """M1: all positives plus exactly ``round(ratio * positives)`` negatives
    chosen by key hash (the count is one scalar action).  The input is written
    once, so the count, both parts and the histogram read a table, not its plan."""
    from shopcast.sources.files import staged
    df = staged(df, "downsample")
    pos = df.filter(F.col(label) == 1)
    neg = df.filter(F.col(label) != 1)
    n = int(round(ratio * pos.count()))
    return pos.unionByName(first_n_by_hash(neg, keys, n, seed))
