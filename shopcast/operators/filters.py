"""Filters and predicates (F1–F8).  Plain column predicates, so Catalyst
pushes them into the Parquet scan (``PushedFilters``) and, for a log stored
``partitionBy('cate')``, prunes partitions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.timebins import ts_lit
from shopcast.schemas import MODEL_IDS, PURCHASE


def time_range(df: DataFrame, start, end, col: str = "time") -> DataFrame:
    """half-open ``[start, end)``."""
    return df.filter((F.col(col) >= ts_lit(start)) & (F.col(col) < ts_lit(end)))


def category_eq(df: DataFrame, cate: int) -> DataFrame:
    """F2."""
    return df.filter(F.col("cate") == cate)


def type_eq(df: DataFrame, k: int) -> DataFrame:
    """F3."""
    return df.filter(F.col("type") == k)


def exclude_period(df: DataFrame, lo, hi, mode: str = "range", col: str = "time") -> DataFrame:
    """holiday exclusion.  ``range`` drops the calendar days lo..hi
    (inclusive); ``after`` keeps only events before ``lo`` (the source as
    written)."""
    if mode == "range":
        # on the time itself, so that the predicate reaches the scan
        after = ts_lit(hi + timedelta(days=1))
        return df.filter((F.col(col) < ts_lit(lo)) | (F.col(col) >= after))
    if mode == "after":
        return df.filter(F.col(col) < ts_lit(lo))
    raise ValueError(mode)


def model_in(df: DataFrame, ids=MODEL_IDS) -> DataFrame:
    """F5."""
    return df.filter(F.col("model_id").isin(list(ids)))


def focus_users(df: DataFrame, cate: int, types=(2, PURCHASE, 5)) -> DataFrame:
    """distinct users with an event of one of ``types`` in ``cate``."""
    return df.filter((F.col("cate") == cate) & F.col("type").isin(list(types))).select("user_id").distinct()


def drop_null_rows(df: DataFrame) -> DataFrame:
    """F7."""
    return df.na.drop("any")


def purchases_only(df: DataFrame) -> DataFrame:
    """F8."""
    return df.filter(F.col("type") == PURCHASE)
