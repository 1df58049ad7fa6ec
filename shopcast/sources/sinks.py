"""Sinks (S7–S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast import schemas


def top_users(scores: DataFrame, k: int, prob_col: str = "prob") -> DataFrame:
    """L1 + P10: the ``k`` best users by probability (ties by user id), with
    ``sku_id = -1``.  ``orderBy().limit(k)`` plans as a bounded TakeOrdered."""
    return (scores.orderBy(F.col(prob_col).desc(), F.col("user_id").asc()).limit(k)
                  .select(F.col("user_id").cast("long").alias("user_id"),
                          F.lit(-1).cast("long").alias("sku_id")))


def write_user_submission(scores: DataFrame, k: int, path: str, prob_col: str = "prob") -> DataFrame:
    """Top-k users CSV with a header, one file in rank order, the rank as
    a column (1 = best)."""
    from shopcast.operators.evaluate import ranked_top
    top = ranked_top(scores, k, [F.col(prob_col).desc(), F.col("user_id").asc()])
    out = top.select(F.col("user_id").cast("long").alias("user_id"), F.lit(-1).cast("long").alias("sku_id"),
                     F.col("rank").cast("int").alias("rank")).orderBy("rank")
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return out


def write_scores(scores: DataFrame, path: str) -> None:
    """(user_id, sku_id, label=score) CSV."""
    (scores.select(F.col("user_id").cast("long"), F.col("sku_id").cast("long"),
                   F.col("label").cast("double"))
           .write.mode("overwrite").option("header", True).csv(path))


def final_submission(spark: SparkSession, scores_path: str, out_path: str | None = None) -> DataFrame:
    """Read the score CSV, keep (user_id, sku_id) as integers, write."""
    df = (spark.read.schema(schemas.SCORES).option("header", True).csv(scores_path)
               .select(F.col("user_id").cast("long"), F.col("sku_id").cast("long")))
    if out_path:
        df.write.mode("overwrite").option("header", True).csv(out_path)
    return df
