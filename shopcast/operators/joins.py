"""Joins (J1–J6).

Broadcast is used only where the small side has a proven bound (a top-k
list, a category vocabulary).  Everything else is a plain equi-join: AQE
measures the real shuffle sizes at run time, turns a small side into a
broadcast when it is below the threshold, and splits skewed partitions of a
sort-merge join (a user with a third of all rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.operators.windows import keep_latest

SALTS = 32


def left_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Left join on one or more keys."""
    return left.join(right, list(on) if not isinstance(on, str) else [on], "left")


def semi_restrict(rows: DataFrame, keep: DataFrame, on="user_id", bound: int | None = None) -> DataFrame:
    """Keep rows whose key is in ``keep`` (LEFT SEMI — duplicates in
    ``keep`` never fan rows out).  ``bound`` says that the caller has limited
    ``keep`` to so many rows (a top-k list): it is then broadcast, whole."""
    k = keep.select(*([on] if isinstance(on, str) else on))
    if bound is not None:
        k = F.broadcast(k)
    return rows.join(k, on, "left_semi")


def key_sizes(df: DataFrame, key: str, total: int, share: float = 0.05) -> tuple[int, list]:
    """Number of distinct keys, and those that hold more than ``share`` of the
    ``total`` rows — at most 1 / share of them, so the list is small whatever
    the data.  ``df`` is read again: give a written table."""
    hot = F.collect_list(F.when((F.col("_n") > total * share) & F.col(key).isNotNull(), F.col(key)))
    row = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("keys"), hot.alias("hot")).first()
    return row["keys"], row["hot"]


def hot_keys(df: DataFrame, key: str, share: float = 0.05) -> list:
    """Keys that hold more than ``share`` of the rows."""
    return key_sizes(df, key, df.count(), share)[1]


def salted(df: DataFrame, key: str, hot: list, spread, salts: int = SALTS) -> DataFrame:
    """``df`` with ``_salt``: rows of a hot key are spread over ``salts``
    values by the ``spread`` columns, all others have 0."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    return df.withColumn("_salt", F.when(F.col(key).isin(hot), salt).otherwise(0) if hot else F.lit(0))


def salted_left_join(left: DataFrame, right: DataFrame, keys, key: str, hot: list, salts: int = SALTS) -> DataFrame:
    """Left join of a ``salted`` table: the rows that ``right`` has for a hot
    key (few: it is an aggregate by the join keys) are copied to every salt, so
    the hot key's rows meet them in ``salts`` tasks instead of one."""
    if not hot:
        return left.join(right, list(keys), "left")
    copies = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(right.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], "left")


def latest_per_user_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str,
                         left_ties=(), right_ties=()) -> DataFrame:
    """Join two per-user event lists, each reduced to its latest event per
    user first (one row per user out)."""
    return keep_latest(left, ["user_id"], left_time, left_ties).join(
        keep_latest(right, ["user_id"], right_time, right_ties), "user_id", "left")


def fan_out_counts(left: DataFrame, right: DataFrame, key: str = "user_id", name: str = "rows") -> DataFrame:
    """J4 as written joins every left event with every right event of a user.
    Rows per user of that join, from one aggregate of each side: the pairs
    themselves, quadratic for a hot user, are never made."""
    n_left = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l"))
    n_right = right.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    return n_left.join(n_right, key, "left").select(
        key, (F.col("_l") * F.greatest(F.coalesce("_r", F.lit(0)), F.lit(1))).alias(name))


def topk_overlap(a: DataFrame, b: DataFrame, na: int, nb: int, order_a, order_b, on=("user_id",)) -> DataFrame:
    """The first ``na`` rows of ``a`` and ``nb`` of ``b`` (each a bounded
    TakeOrdered), joined on ``on``."""
    ta = a.orderBy(*order_a).limit(na)
    tb = b.orderBy(*order_b).limit(nb)
    return ta.join(tb, list(on), "inner")


def product_join(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Product attributes on (sku, cate, brand); a brand mismatch leaves
    the attributes NULL."""
    return rows.join(products, ["sku_id", "cate", "brand"], "left")
