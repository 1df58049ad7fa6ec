"""User profile, product and comment features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.exprs import one_hot, recode
from shopcast.functions.timebins import date_lit, days_registered, interval_bucket, parse_reg_date
from shopcast.operators.cube import Win, in_win, is_type
from shopcast.schemas import AGE_BUCKETS, ATTR_CODES, COMMENT_NUM_CODES, PURCHASE, SEX_CODES, USER_LEVELS

# Age text -> code.  Two codings exist in the source, both over the same
# texts; anything else is -1 in the first and 0 in the second.
AGE_CODES_0_6 = {txt: i for i, txt in enumerate(AGE_BUCKETS)}            # '-1' -> 0 … '56岁以上' -> 6
AGE_CODES_1_7 = {txt: i + 1 for i, txt in enumerate(AGE_BUCKETS)}        # '-1' -> 1 … '56岁以上' -> 7


def age_code(users: DataFrame, mapping: dict = AGE_CODES_0_6, default=-1) -> DataFrame:
    """Recode the age bucket text."""
    return users.withColumn("age", recode("age", mapping, default))


def basic_user_features(users: DataFrame, mapping: dict = AGE_CODES_0_6, drop_sex: bool = False) -> DataFrame:
    """P2 + P3: one-hot of age code, sex and user level (fixed vocabularies)."""
    age = recode("age", mapping, -1)
    ages = sorted(set(mapping.values()))
    cols = [F.col("user_id")] + one_hot(age, ages, "age")
    if not drop_sex:
        cols += one_hot("sex", SEX_CODES, "sex")
    cols += one_hot("user_lv_cd", USER_LEVELS, "user_lv_cd")
    return users.select(*cols)


def basic_product_features(products: DataFrame) -> DataFrame:
    """Product attributes one-hot, keyed by (sku, cate, brand)."""
    return products.select("sku_id", "cate", "brand", *one_hot("a1", ATTR_CODES, "a1"),
                           *one_hot("a2", ATTR_CODES, "a2"), *one_hot("a3", ATTR_CODES, "a3"))


def static_user_features(users: DataFrame, end, mapping: dict = AGE_CODES_0_6, default: int = -1,
                         drop_sex: bool = True) -> DataFrame:
    """P2 + T6 in one projection of the user table (one scan, one join): the
    profile one-hot plus days registered, NULL for users with a missing
    attribute (the users ``registration_days`` drops)."""
    complete = None
    for c in users.columns:
        complete = F.col(c).isNotNull() if complete is None else complete & F.col(c).isNotNull()
    age = recode("age", mapping, default)
    codes = sorted({*mapping.values(), *([default] if default >= 0 else [])})
    cols = [F.col("user_id")] + one_hot(age, codes, "age")
    if not drop_sex:
        cols += one_hot("sex", SEX_CODES, "sex")
    cols += one_hot("user_lv_cd", USER_LEVELS, "user_lv_cd")
    cols.append(F.when(complete, days_registered(end, "user_reg_tm")).alias("user_reg_tm"))
    # hidden: the raw distance, -1 where it is unknown, of the same users (see ``first_buy_bucket``)
    raw = F.coalesce(F.datediff(date_lit(end), parse_reg_date("user_reg_tm")), F.lit(-1))
    cols += [F.when(complete, raw).alias("_reg"), F.lit(True).alias("_known")]
    return users.select(*cols)


def first_buy_bucket(first_buy: str, name: str = "inter_reg_first_buy"):
    """A8c on a row that has ``static_user_features`` and the elapsed days of
    the user's first purchase; NULL for users with a missing attribute."""
    x = F.col("_reg") - F.coalesce(F.col(f"`{first_buy}`"), F.lit(-1))
    return interval_bucket(x).alias(name)


def registration_days(users: DataFrame, end, name: str = "user_reg_tm") -> DataFrame:
    """Days registered at ``end`` (future registrations -> -1); users with
    any NULL attribute are dropped (F7), as in the source."""
    return users.na.drop("any").select("user_id", days_registered(end, "user_reg_tm").alias(name))


def reg_to_first_buy(cube: DataFrame, users: DataFrame, end, w: Win,
                     name: str = "inter_reg_first_buy") -> DataFrame:
    """(days registered − elapsed days of the first purchase) bucketed by
    floor((x+1)/5); a missing side counts as -1."""
    first = (cube.filter(in_win(w) & is_type(PURCHASE)).groupBy("user_id")
                 .agg(F.max("b").alias("first_buy")))
    # raw day difference here (no clipping of future registrations)
    reg = users.na.drop("any").select("user_id", F.datediff(date_lit(end), parse_reg_date("user_reg_tm")).alias("reg"))
    j = reg.join(first, "user_id", "left")
    x = F.coalesce(F.col("reg"), F.lit(-1)) - F.coalesce(F.col("first_buy"), F.lit(-1))
    return j.select("user_id", interval_bucket(x).alias(name))


def asof_snapshot(comments: DataFrame, end) -> DataFrame:
    """The latest snapshot date strictly before ``end`` (the earliest one
    when none is earlier), as a one-row DataFrame.  The distinct-date table is
    bounded by the number of snapshot dates, not by the data."""
    dates = comments.select("dt").distinct()
    return dates.agg(F.coalesce(F.max(F.when(F.col("dt") < date_lit(end), F.col("dt"))),
                                F.min("dt")).alias("snap"))


def comment_features(comments: DataFrame, end) -> DataFrame:
    """Per sku, the as-of snapshot's bad-comment flag and rate and the
    one-hot comment-count bucket (1..4; 0 dropped)."""
    # rows with begin <= dt < end; when no snapshot precedes ``end`` the
    # default (earliest) date is not before ``end`` and nothing is kept.
    snap = asof_snapshot(comments, end).first().snap       # one date
    c = comments.filter((F.col("dt") == F.lit(snap)) & (F.col("dt") < date_lit(end)))
    return c.select("sku_id", "has_bad_comment", "bad_comment_rate",
                    *one_hot("comment_num", COMMENT_NUM_CODES, "comment_num"))
