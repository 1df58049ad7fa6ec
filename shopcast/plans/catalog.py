"""Registered queries: one per operator of the inventory, each reading the
driver's whole tables through an adapter.  ``__spark_entry__`` exposes them.

Every query returns doubles rounded to 6 places (stable comparison).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.functions.exprs import rounded
from shopcast.functions.timebins import window_start
from shopcast.operators import families as fam
from shopcast.operators import pivots, shares, stats
from shopcast.operators.cube import Win, activity_cube, is_type
from shopcast.schemas import PURCHASE
from shopcast.sources.adapters import load_a, load_b

REGISTRY: dict = {}


def register(key: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))
        run.__name__ = key
        run.__doc__ = fn.__doc__
        REGISTRY[key] = run
        return fn
    return deco


def _cube(d, days: int | None = None, cate: int | None = None, actions=None):
    """Cube of adapter ``d`` from the accumulate start (or ``end - days``)."""
    D = d["dates"]
    start = D.acc_start if days is None else window_start(D.end, days=days)
    a = d["actions"] if actions is None else actions
    if cate is not None:
        a = a.filter(F.col("cate") == cate)
    return activity_cube(a, D.end, start)


def _acc(d) -> Win:
    return Win(0, d["dates"].acc_days)


W5 = Win.of(5)


# ---- A1 / A12: type counts ---------------------------------------------------

@register("a1u_user_type_counts")
def a1u(spark, sf):
    """A1u: per-user type counts, last 5 days, adapter A."""
    d = load_a(spark, sf)
    return fam.type_counts_df(_cube(d, 5), "U", W5, "{i}_user_action_{k}")


@register("a1u_user_type_counts_lineitem")
def a1u_b(spark, sf):
    """A1u on adapter B (midnight timestamps, closed window start), accumulate window."""
    d = load_b(spark, sf)
    return fam.type_counts_df(_cube(d), "U", _acc(d), "{i}_user_action_{k}")


@register("a1i_sku_type_counts")
def a1i(spark, sf):
    d = load_a(spark, sf)
    return fam.type_counts_df(_cube(d, 5), "I", W5, "{i}_sku_action_{k}")


@register("a1ui_user_sku_type_counts")
def a1ui(spark, sf):
    d = load_a(spark, sf)
    return fam.type_counts_df(_cube(d, 5), "UI", W5, "{i}_action_{k}")


@register("a1uc_user_cate_type_counts")
def a1uc(spark, sf):
    """A1uc + A12: per (user, cate) counts and purchase rows (NULL when none)."""
    d = load_a(spark, sf)
    ms = fam.type_counts(W5, "{i}_uc_action_{k}") + [fam.purchase_rows(W5, "5_sku_buy_num_in_cate")]
    return fam.aggregate(_cube(d, 5), "UC", ms, W5)


@register("a1uic_user_sku_cate_type_counts")
def a1uic(spark, sf):
    d = load_a(spark, sf)
    return fam.type_counts_df(_cube(d, 5), "UIC", W5, "{i}_syn_action_{k}")


@register("a1c8_user_category_type_counts")
def a1c8(spark, sf):
    d = load_a(spark, sf)
    return fam.type_counts_df(_cube(d, 5, cate=d["dates"].target_cate), "U", W5, "{i}_user_cate8_action_{k}")


# ---- R1: conversion ratios -----------------------------------------------------

@register("r1u_user_conv_ratio")
def r1u(spark, sf):
    d = load_a(spark, sf)
    return fam.conv_ratio_df(_cube(d, 5), "U", W5, "{i}_user_conv_ratio_{k}")


@register("r1i_sku_conv_ratio")
def r1i(spark, sf):
    d = load_a(spark, sf)
    return fam.conv_ratio_df(_cube(d), "I", _acc(d), "{i}_sku_conv_ratio_{k}")


@register("r1ui_user_sku_conv_ratio")
def r1ui(spark, sf):
    d = load_a(spark, sf)
    return fam.conv_ratio_df(_cube(d), "UI", _acc(d), "{i}_ui_conv_ratio_{k}")


@register("r1uc_user_cate_conv_ratio")
def r1uc(spark, sf):
    d = load_a(spark, sf)
    return fam.conv_ratio_df(_cube(d), "UC", _acc(d), "{i}_uc_conv_ratio_{k}")


@register("r1uic_user_sku_cate_conv_ratio")
def r1uic(spark, sf):
    d = load_a(spark, sf)
    return fam.conv_ratio_df(_cube(d), "UIC", _acc(d), "{i}_syn_conv_ratio_{k}")


@register("r1u_user_conv_ratio_inf")
def r1u_inf(spark, sf):
    """User-model form: k = 1,2,5,6, x/0 kept as +inf, 0/0 NULL."""
    d = load_a(spark, sf)
    D = d["dates"]
    w = _acc(d)
    return fam.conv_ratio_df(_cube(d, cate=D.target_cate), "U", w, "user_action_{k}_ratio",
                             ks=(1, 2, 5, 6), on_zero="inf")


# ---- A3 decay ------------------------------------------------------------------

@register("a3_decayed_counts")
def a3(spark, sf):
    d = load_a(spark, sf)
    return fam.decayed_df(_cube(d), "UICB", _acc(d), "action_{k}")


@register("a3_decayed_counts_lineitem")
def a3_b(spark, sf):
    d = load_b(spark, sf)
    return fam.decayed_df(_cube(d), "UICB", _acc(d), "action_{k}")


# ---- A4 active days -------------------------------------------------------------

def _days_pair(cube, grain, w, any_name, buy_name, by):
    a = fam.active_days_df(cube, grain, w, any_name, False, by)
    b = fam.active_days_df(cube, grain, w, buy_name, True, by)
    keys = [c for c in a.columns if c != any_name]
    return a.join(b, keys, "left")


@register("a4a_user_active_days_cal")
def a4a(spark, sf):
    """Calendar days with any event / with a purchase, target category, accumulate."""
    d = load_a(spark, sf)
    cube = _cube(d, cate=d["dates"].target_cate)
    return _days_pair(cube, "U", _acc(d), "user_active_days", "user_buy_days", "c")


@register("a4b_user_active_days")
def a4b(spark, sf):
    d = load_a(spark, sf)
    return _days_pair(_cube(d, 5), "U", W5, "5_user_action_tm", "5_user_action_buy_tm", "b")


@register("a4c_user_sku_active_days")
def a4c(spark, sf):
    d = load_a(spark, sf)
    return _days_pair(_cube(d), "UI", _acc(d), "0_ui_tm", "0_ui_buy_tm", "b")


@register("a4d_user_cate_active_days")
def a4d(spark, sf):
    d = load_a(spark, sf)
    return _days_pair(_cube(d, 5), "UC", W5, "5_uc_tm", "5_uc_buy_tm", "b")


@register("a4a_user_active_days_cal_lineitem")
def a4a_b(spark, sf):
    d = load_b(spark, sf)
    return _days_pair(_cube(d, 30), "U", Win.of(30), "30_day_user_active_days", "30_day_user_buy_days", "c")


# ---- A5 / A6 / D8 -------------------------------------------------------------------

@register("a5_active_hours")
def a5(spark, sf):
    """A5 + D8: hour windows 4/8/16 h — type counts and distinct hours of day."""
    d = load_a(spark, sf)
    return fam.hour_window_counts(d["actions"], d["dates"].end)


@register("a6_distinct_skus")
def a6(spark, sf):
    d = load_a(spark, sf)
    return fam.distinct_skus_df(_cube(d, 1), Win.of(1), "1_day_user_product_nums")


# ---- A7 recency -------------------------------------------------------------------

@register("a7a_recency_hours")
def a7a(spark, sf):
    """Hours since the last event / last purchase in the category (accumulate)."""
    d = load_a(spark, sf)
    D = d["dates"]
    w = _acc(d)
    cube = _cube(d, cate=D.target_cate)
    return fam.aggregate(cube, "U", [fam.recency_hours(w, D.end, "user_active_last"),
                                     fam.recency_hours(w, D.end, "user_buy_last", is_type(PURCHASE))], w)


@register("a7b_user_recency_days")
def a7b(spark, sf):
    d = load_a(spark, sf)
    return fam.recency_df(_cube(d), "U", _acc(d), "user_last_buy", PURCHASE)


@register("a7b_user_last_cart")
def a7b_cart(spark, sf):
    d = load_a(spark, sf)
    return fam.recency_df(_cube(d), "U", _acc(d), "user_last_cart", 3)


@register("a7c_user_sku_recency_days")
def a7c(spark, sf):
    """Per (user, sku) in the category: days since last type 3 / 2 / 4."""
    d = load_a(spark, sf)
    w = _acc(d)
    cube = _cube(d, cate=d["dates"].target_cate)
    ms = [fam.recency_days(w, "ui_last_cart", 3), fam.recency_days(w, "ui_last_del_cart", 2),
          fam.recency_days(w, "ui_last_buy", PURCHASE)]
    return fam.aggregate(cube, "UI", ms, w, F.col("type").isin(2, 3, 4))


# ---- A8 first / last ----------------------------------------------------------------

@register("a8a_first_last_interval_user")
def a8a(spark, sf):
    d = load_a(spark, sf)
    return fam.first_last_df(_cube(d), "U", _acc(d), "0_user_first_buy", "0_user_interval")


@register("a8b_first_last_interval_uic")
def a8b(spark, sf):
    d = load_a(spark, sf)
    return fam.first_last_df(_cube(d), "UIC", _acc(d), "0_first_buy", "0_interval")


# ---- A9 / A10 / A11 ---------------------------------------------------------------------

@register("a9_type_share")
def a9(spark, sf):
    d = load_a(spark, sf)
    cube = _cube(d, 5, cate=d["dates"].target_cate)
    return fam.aggregate(cube, "U", fam.type_shares(W5, "{i}_user_cate8_ratio_{k}"), W5)


@register("a10_action_period")
def a10(spark, sf):
    d = load_a(spark, sf)
    w = _acc(d)
    return fam.action_period(_cube(d), d["users"], w, d["dates"].acc_days)


@register("a10_action_period_as_written")
def a10_w(spark, sf):
    d = load_a(spark, sf)
    w = _acc(d)
    return fam.action_period(_cube(d), d["users"], w, d["dates"].acc_days, mode="as_written")


@register("a11_model_id_counts")
def a11(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    return fam.model_id_counts(d["actions"], D.acc_start, D.end, ("user_id", "sku_id"), "ui_model_id")


@register("a11_model_id_counts_as_written")
def a11_w(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    return fam.model_id_counts(d["actions"], D.acc_start, D.end, ("user_id",), "user_cate8_model_id",
                               cate=D.target_cate, mode="as_written")


# ---- A14 / A15 ----------------------------------------------------------------------------

@register("a14_distinct_users")
def a14(spark, sf):
    d = load_a(spark, sf)
    return fam.distinct_users(_cube(d, 30, cate=d["dates"].target_cate), Win.of(30))


@register("a15u_user_labels")
def a15u(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    return fam.labels(d["actions"], D.label_start, D.label_end, cate=D.target_cate)


@register("a15ui_pair_labels")
def a15ui(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    return fam.labels(d["actions"], D.label_start, D.label_end, ("user_id", "sku_id"), cate=D.target_cate)


@register("a15t_truth_rows")
def a15t(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    return fam.truth_rows(d["actions"], D.label_start, D.label_end, cate=D.target_cate)


# ---- A2 statistics ----------------------------------------------------------------------------

@register("a2u_user_sku_stats")
def a2u(spark, sf):
    d = load_a(spark, sf)
    cube = _cube(d, 30, cate=d["dates"].target_cate)
    return stats.user_sku_stats(cube, [Win.of(5), Win.of(30)])


@register("a2c_user_category_sku_stats")
def a2c(spark, sf):
    d = load_a(spark, sf)
    return stats.user_category_sku_stats(_cube(d), [_acc(d), Win.of(5), Win.of(30)], d["dates"].target_cate)


@register("a2p_sku_daily_stats")
def a2p(spark, sf):
    d = load_a(spark, sf)
    return stats.sku_daily_stats(_cube(d), [_acc(d), Win.of(5), Win.of(30)], d["dates"].target_cate)


@register("a2p_sku_daily_stats_lineitem")
def a2p_b(spark, sf):
    d = load_b(spark, sf)
    return stats.sku_daily_stats(_cube(d), [_acc(d), Win.of(5), Win.of(30)], d["dates"].target_cate)


# ---- W1 shares ------------------------------------------------------------------------------

@register("w1a_sku_share_in_user")
def w1a(spark, sf):
    d = load_a(spark, sf)
    return shares.sku_share_in_user(_cube(d), _acc(d))


@register("w1b_sku_share_in_user_cate")
def w1b(spark, sf):
    d = load_a(spark, sf)
    return shares.sku_share_in_user_cate(_cube(d), _acc(d))


@register("w1c_cate_share_in_user")
def w1c(spark, sf):
    d = load_a(spark, sf)
    return shares.cate_share_in_user(_cube(d), _acc(d))


@register("w1d_sku_share_in_cate")
def w1d(spark, sf):
    d = load_a(spark, sf)
    return shares.sku_share_in_cate(_cube(d), _acc(d))


@register("w1e_brand_share_in_cate")
def w1e(spark, sf):
    d = load_a(spark, sf)
    return shares.brand_share_in_cate(_cube(d), _acc(d))


@register("w1d_sku_share_in_cate_lineitem")
def w1d_b(spark, sf):
    d = load_b(spark, sf)
    return shares.sku_share_in_cate(_cube(d), _acc(d))


# ---- A13 pivots ---------------------------------------------------------------------------------

@register("a13a_cate_pivot_counts")
def a13a(spark, sf):
    d = load_a(spark, sf)
    return pivots.cate_pivot_counts(_cube(d, 5), W5)


@register("a13b_cate_pivot_conv")
def a13b(spark, sf):
    d = load_a(spark, sf)
    return pivots.cate_pivot_conv(_cube(d), _acc(d))


@register("a13c_cate_pivot_days")
def a13c(spark, sf):
    d = load_a(spark, sf)
    return pivots.cate_pivot_days(_cube(d, 10), Win.of(10))


@register("a13d_cate_pivot_recency")
def a13d(spark, sf):
    d = load_a(spark, sf)
    return pivots.cate_pivot_recency(_cube(d), _acc(d))


@register("a13e_cate_purchase_basket")
def a13e(spark, sf):
    d = load_a(spark, sf)
    return pivots.cate_purchase_basket(_cube(d), d["users"], _acc(d))


@register("a13f_cate_rank_pivot")
def a13f(spark, sf):
    d = load_a(spark, sf)
    return pivots.cate_rank_pivot(shares.cate_share_in_user(_cube(d), _acc(d)))


# ---- D3 / D4: (user, sku) dataset ---------------------------------------------------------

@register("d3_user_sku_dataset")
def d3(spark, sf):
    """D3 train form on adapter A (base = last 30 days, target category, labelled)."""
    from shopcast.plans.ui_dataset import user_sku_dataset
    return user_sku_dataset(load_a(spark, sf), with_label=True)


@register("d3_user_sku_dataset_test")
def d3_test(spark, sf):
    """D3 scoring form: end shifted to the scoring end, no label."""
    from shopcast.plans.ui_dataset import user_sku_dataset
    d = load_a(spark, sf)
    return user_sku_dataset(d, with_label=False, end=d["dates"].score_end)


@register("d3_user_sku_dataset_from_daily")
def d3_daily(spark, sf):
    """D3 with its cube derived from the daily table (the path used when
    train and scoring sets share one pass over the log)."""
    from shopcast.operators.cube import materialized_daily
    from shopcast.plans.ui_dataset import user_sku_dataset
    d = load_a(spark, sf)
    return user_sku_dataset(dict(d, daily=materialized_daily(d["actions"])), with_label=True)


@register("d3_user_sku_dataset_lineitem")
def d3_b(spark, sf):
    from shopcast.plans.ui_dataset import user_sku_dataset
    return user_sku_dataset(load_b(spark, sf), with_label=True)


# ---- D1 / D5–D8: user dataset -----------------------------------------------------------------

@register("d1_user_dataset")
def d1(spark, sf):
    """D1 train form: users active in the category in the last 30 days, all user-model features, label."""
    from shopcast.plans.user_dataset import user_dataset
    return user_dataset(load_a(spark, sf), with_label=True)


@register("d1_user_dataset_test")
def d1_test(spark, sf):
    from shopcast.plans.user_dataset import user_dataset_test
    return user_dataset_test(load_a(spark, sf))


@register("d1_user_dataset_lineitem")
def d1_b(spark, sf):
    from shopcast.plans.user_dataset import user_dataset
    return user_dataset(load_b(spark, sf), with_label=True)


@register("d1_user_dataset_lineitem_all")
def d1_b_all(spark, sf):
    """Adapter B accumulated from before its first event: the look-back covers the whole log."""
    import dataclasses
    import datetime as dt
    from shopcast.plans.user_dataset import user_dataset
    d = load_b(spark, sf)
    return user_dataset(dict(d, dates=dataclasses.replace(d["dates"], acc_start=dt.datetime(1995, 1, 1))), with_label=True)


@register("d5_user_accumulate")
def d5(spark, sf):
    from shopcast.plans.user_dataset import user_accumulate
    d = load_a(spark, sf)
    D = d["dates"]
    cube8 = _cube(d, cate=D.target_cate)
    w = _acc(d)
    return user_accumulate(cube8, D.end, w).join(stats.user_sku_stats(cube8, [w], "user_action_{k}_{stat}"),
                                                 "user_id", "left")


@register("d6_user_accumulate_all")
def d6(spark, sf):
    from shopcast.plans.user_dataset import user_accumulate_all
    d = load_a(spark, sf)
    return user_accumulate_all(_cube(d), d["dates"].end, _acc(d))


@register("d7_user_window")
def d7(spark, sf):
    from shopcast.plans.user_dataset import user_windows
    d = load_a(spark, sf)
    return user_windows(_cube(d, 30, cate=d["dates"].target_cate))


# ---- profile / product / comments (P2, P3, T6, T8, A8c, A16, J6) -------------------------------

from shopcast.operators import profile as prof  # noqa: E402


@register("p2_user_one_hot")
def p2u(spark, sf):
    d = load_a(spark, sf)
    return prof.basic_user_features(d["users"], prof.AGE_CODES_0_6)


@register("p2_product_one_hot")
def p2p(spark, sf):
    return prof.basic_product_features(load_a(spark, sf)["products"])


@register("p3_recode_age")
def p3(spark, sf):
    """Age text coded 1..7 in bucket order, anything else 0."""
    d = load_a(spark, sf)
    return prof.age_code(d["users"], prof.AGE_CODES_1_7, 0).select("user_id", "age")


@register("t6_days_registered")
def t6(spark, sf):
    d = load_a(spark, sf)
    return prof.registration_days(d["users"], d["dates"].end)


@register("a8c_reg_to_first_buy")
def a8c(spark, sf):
    d = load_a(spark, sf)
    return prof.reg_to_first_buy(_cube(d), d["users"], d["dates"].end, _acc(d))


@register("t8_asof_rows")
def t8r(spark, sf):
    """Each action with its sku's latest comment snapshot before it."""
    from shopcast.operators.pieces import asof_join
    d = load_a(spark, sf)
    rows = d["actions"].select("user_id", "sku_id", "time", "type")
    out = asof_join(rows, d["comments"], ["sku_id"], "time", "dt", ["comment_num", "has_bad_comment", "bad_comment_rate"])
    return out.withColumn("time", _ts("time")).withColumn("dt", F.col("dt").cast("string"))


@register("t8_asof_snapshot_date")
def t8(spark, sf):
    d = load_a(spark, sf)
    return prof.asof_snapshot(d["comments"], d["dates"].end).select(F.col("snap").cast("string").alias("snap"))


@register("a16_comment_features")
def a16(spark, sf):
    d = load_a(spark, sf)
    return prof.comment_features(d["comments"], d["dates"].end)


@register("j6_product_join")
def j6(spark, sf):
    from shopcast.operators.joins import product_join
    d = load_a(spark, sf)
    base = fam.decayed_df(_cube(d), "UICB", _acc(d), "action_{k}").select("user_id", "sku_id", "cate", "brand")
    return product_join(base, prof.basic_product_features(d["products"]))


# ---- scalar time functions (T1–T5, T7, T9, T10) ------------------------------------------------

@register("t1_t7_time_bins")
def t17(spark, sf):
    from shopcast.functions import timebins as tb
    d = load_a(spark, sf)
    D = d["dates"]
    a = d["actions"].filter((F.col("time") >= tb.ts_lit(D.acc_start)) & (F.col("time") < tb.ts_lit(D.end)))
    return a.select("user_id", "sku_id", "type",
                    tb.calendar_day().cast("string").alias("day"),
                    tb.hour_of_day().alias("hour"),
                    tb.calendar_distance(D.end).alias("c"),
                    tb.elapsed_days(D.end).alias("b"),
                    tb.elapsed_hours(D.end).alias("h"),
                    tb.exp_decay(tb.elapsed_days(D.end)).alias("decay"),
                    tb.interval_bucket(tb.elapsed_days(D.end) - F.lit(20)).alias("bucket"),
                    tb.cast_int(F.col("brand")).alias("brand"))


@register("t3_elapsed_days_lineitem")
def t3_b(spark, sf):
    """Midnight timestamps: elapsed days equal calendar distance."""
    from shopcast.functions import timebins as tb
    d = load_b(spark, sf)
    D = d["dates"]
    a = d["actions"].filter((F.col("time") >= tb.ts_lit(D.acc_start)) & (F.col("time") < tb.ts_lit(D.end)))
    return (a.select(tb.calendar_distance(D.end).alias("c"), tb.elapsed_days(D.end).alias("b"))
             .groupBy("c", "b").agg(F.count(F.lit(1)).alias("n")))


# ---- filters (F1–F8, S5) ------------------------------------------------------------------------

from shopcast.operators import filters as flt  # noqa: E402


def _ts(c):
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _rows(df):
    return df.select("user_id", "sku_id", "type", "cate", _ts("time").alias("time"))


@register("f1_time_range")
def f1(spark, sf):
    d = load_a(spark, sf)
    return _rows(flt.time_range(d["actions"], window_start(d["dates"].end, days=5), d["dates"].end))


@register("f2_f3_category_type")
def f23(spark, sf):
    d = load_a(spark, sf)
    return _rows(flt.type_eq(flt.category_eq(d["actions"], 8), 4))


@register("f4_exclude_period")
def f4(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    return _rows(flt.exclude_period(d["actions"], D.excl_lo, D.excl_hi, "range"))


@register("f4_exclude_period_as_written")
def f4w(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    return _rows(flt.exclude_period(d["actions"], D.excl_lo, D.excl_hi, "after"))


@register("f5_model_in")
def f5(spark, sf):
    d = load_a(spark, sf)
    return flt.model_in(d["actions"]).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))


@register("f6_focus_users")
def f6(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    return flt.focus_users(flt.time_range(d["actions"], D.acc_start, D.end), 8)


@register("f7_drop_null_rows")
def f7(spark, sf):
    return flt.drop_null_rows(load_a(spark, sf)["users"])


@register("f8_purchases_only")
def f8(spark, sf):
    d = load_b(spark, sf)
    return _rows(flt.purchases_only(d["actions"]))


@register("s5_category_slice")
def s5(spark, sf):
    from shopcast.sources.files import category_slice
    d = load_a(spark, sf)
    return category_slice(d["actions"], 8).select("user_id", "sku_id", "type", "brand", "model_id",
                                                  _ts("time").alias("time"))


# ---- joins / top-k / sets / metrics (J3–J5, L1–L2, U1–U2, W2–W4, E1–E3) ------------------------

from shopcast.operators import evaluate as ev  # noqa: E402
from shopcast.operators import joins as jn  # noqa: E402
from shopcast.operators import windows as wn  # noqa: E402


def _user_scores_plain(d):
    """Score = purchases in the accumulate window (integer-valued, so ties
    are exact and broken by key)."""
    from shopcast.operators.cube import cnt0
    w = _acc(d)
    return fam.aggregate(_cube(d), "U", [cnt0(w, is_type(PURCHASE)).cast("double").alias("prob")], w)


def _pair_scores(d):
    from shopcast.operators.cube import cnt0
    w = _acc(d)
    return fam.aggregate(_cube(d), "UI", [(cnt0(w, is_type(PURCHASE)) * 10 + cnt0(w, is_type(1)))
                                          .cast("double").alias("label")], w)


@register("l1_topk_by_score")
def l1(spark, sf):
    from shopcast.sources.sinks import top_users
    return top_users(_user_scores_plain(load_a(spark, sf)), 1000)


@register("l2_e3_cutoff_sweep")
def l2(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    truth = fam.labels(d["actions"], D.label_start, D.label_end, cate=D.target_cate)
    return ev.cutoff_sweep(_user_scores_plain(d), truth, (900, 950, 1000),
                           [F.col("prob").desc(), F.col("user_id")])


@register("e3_pair_cutoff_sweep")
def e3(spark, sf):
    """User and pair metrics of the best 600 / 800 / 900 / 1000 (user, sku) pairs."""
    d = load_a(spark, sf)
    D = d["dates"]
    truth = fam.labels(d["actions"], D.label_start, D.label_end, ("user_id", "sku_id"), cate=D.target_cate)
    return ev.pair_cutoff_sweep(_pair_scores(d), truth, (600, 800, 900, 1000),
                                [F.col("label").desc(), F.col("user_id"), F.col("sku_id")])


@register("e1_f11")
def e1(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    pred = _user_scores_plain(d).orderBy(F.col("prob").desc(), "user_id").limit(1000)
    return ev.f11(pred, fam.labels(d["actions"], D.label_start, D.label_end, cate=D.target_cate))


@register("e2_f12_score")
def e2(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    pred = _pair_scores(d).orderBy(F.col("label").desc(), "user_id", "sku_id").limit(1000)
    truth = fam.labels(d["actions"], D.label_start, D.label_end, ("user_id", "sku_id"), cate=D.target_cate)
    return ev.f12_score(pred.select("user_id", "sku_id"), truth)


@register("e4_auc")
def e4(spark, sf):
    """AUC of the user scores against the true buyers and of the pair scores against the true pairs."""
    d = load_a(spark, sf)
    D = d["dates"]
    sides = []
    for kind, scores, score, keys in (("user", _user_scores_plain(d), "prob", ["user_id"]),
                                      ("pair", _pair_scores(d), "label", ["user_id", "sku_id"])):
        true = fam.labels(d["actions"], D.label_start, D.label_end, keys, cate=D.target_cate).withColumnRenamed("label", "_true")
        sides.append(scores.join(true, keys, "left").select(F.lit(kind).alias("kind"), F.col(score).alias("score"),
                                                            F.col("_true").isNotNull().alias("true")))
    out = ev.auc_by(sides[0].unionByName(sides[1]), ["kind"], F.col("score"), F.col("true"))
    return rounded(out)


@register("j3_semi_restrict")
def j3(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    base = fam.decayed_df(_cube(d), "UICB", _acc(d), "action_{k}")
    return jn.semi_restrict(base, fam.labels(d["actions"], D.label_start, D.label_end, cate=D.target_cate))


@register("j3_semi_restrict_topk")
def j3k(spark, sf):
    """Scoring rows restricted to the first 1000 candidate users (bounded -> broadcast)."""
    d = load_a(spark, sf)
    base = fam.decayed_df(_cube(d), "UICB", _acc(d), "action_{k}")
    cands = _user_scores_plain(d).orderBy(F.col("prob").desc(), "user_id").limit(1000)
    return jn.semi_restrict(base, cands, bound=1000)


def _cart_sides(d):
    D = d["dates"]
    a = flt.time_range(d["actions"], D.acc_start, D.end)
    cart = a.filter(F.col("type") == 2).select("user_id", F.col("time").alias("cart_time"), F.col("sku_id").alias("cart_sku"))
    uncart = a.filter(F.col("type") == 3).select("user_id", F.col("time").alias("uncart_time"),
                                                  F.col("sku_id").alias("uncart_sku"))
    return cart, uncart


@register("j4_cart_uncart_latest")
def j4(spark, sf):
    from shopcast.functions.exprs import flag
    cart, uncart = _cart_sides(load_a(spark, sf))
    j = jn.latest_per_user_join(cart, uncart, "cart_time", "uncart_time", ("cart_sku",), ("uncart_sku",))
    return j.select("user_id", _ts("cart_time").alias("cart_time"), _ts("uncart_time").alias("uncart_time"),
                    flag(F.col("uncart_time") >= F.col("cart_time")).alias("buy_possible"))


@register("j4_cart_uncart_as_written")
def j4w(spark, sf):
    """Rows per user of the many-to-many join, counted without making them."""
    cart, uncart = _cart_sides(load_a(spark, sf))
    return jn.fan_out_counts(cart, uncart)


@register("j5_topk_overlap")
def j5(spark, sf):
    d = load_a(spark, sf)
    us = _user_scores_plain(d)
    ps = _pair_scores(d)
    return jn.topk_overlap(us, ps, 1000, 1000, [F.col("prob").desc(), F.col("user_id")],
                           [F.col("label").desc(), F.col("user_id"), F.col("sku_id")])


@register("j5_topk_overlap_pairs")
def j5p(spark, sf):
    """The best 1000 pairs of two scorings that name the same user and sku."""
    from shopcast.operators.cube import cnt0
    d = load_a(spark, sf)
    w = _acc(d)
    views = fam.aggregate(_cube(d), "UI", [cnt0(w, is_type(1)).cast("double").alias("views")], w)
    return jn.topk_overlap(_pair_scores(d), views, 1000, 1000,
                           [F.col("label").desc(), F.col("user_id"), F.col("sku_id")],
                           [F.col("views").desc(), F.col("user_id"), F.col("sku_id")], on=("user_id", "sku_id"))


@register("u2_intersect")
def u2(spark, sf):
    d = load_a(spark, sf)
    from shopcast.operators.cube import cnt0
    w = _acc(d)
    views = fam.aggregate(_cube(d), "U", [cnt0(w, is_type(1)).cast("double").alias("prob")], w)
    a = _user_scores_plain(d).orderBy(F.col("prob").desc(), "user_id").limit(1000).select("user_id")
    b = views.orderBy(F.col("prob").desc(), "user_id").limit(1000).select("user_id")
    return a.intersect(b)


@register("u1_union_all")
def u1(spark, sf):
    """Positives and negatives of the pair table concatenated by name."""
    d = load_a(spark, sf)
    D = d["dates"]
    from shopcast.sources.files import staged
    base = staged(fam.decayed_df(_cube(d), "UICB", _acc(d), "action_{k}").select("user_id", "sku_id"), "pairs")
    lab = fam.labels(d["actions"], D.label_start, D.label_end, ("user_id", "sku_id"), cate=D.target_cate)
    pos = base.join(lab, ["user_id", "sku_id"], "left_semi").withColumn("label", F.lit(1))
    neg = base.join(lab, ["user_id", "sku_id"], "left_anti").withColumn("label", F.lit(0))
    return pos.unionByName(neg)


@register("w2_dedupe_keep_last")
def w2(spark, sf):
    d = load_a(spark, sf)
    a = flt.category_eq(d["actions"], 8)
    out = wn.keep_latest(a.select("user_id", "sku_id", "time", "type", "model_id"), ["user_id", "sku_id"], "time",
                         ("type", "model_id"))
    return out.withColumn("time", _ts("time"))


@register("w2_dedupe_keep_first")
def w2f(spark, sf):
    d = load_a(spark, sf)
    a = flt.category_eq(d["actions"], 8)
    out = wn.keep_latest(a.select("user_id", "sku_id", "time", "type"), ["user_id", "sku_id"], "time",
                         ("type",), keep="first")
    return out.withColumn("time", _ts("time"))


@register("w3_relative_order")
def w3(spark, sf):
    d = load_a(spark, sf)
    skus = fam.type_counts_df(_cube(d), "IC", _acc(d), "n_{k}").select("sku_id", "cate", F.col("n_1").alias("views"))
    return wn.relative_order(skus, "views", "view_order", ["cate"])


@register("w3_relative_order_global")
def w3g(spark, sf):
    """The same order over all skus, without a partition key."""
    d = load_a(spark, sf)
    skus = fam.type_counts_df(_cube(d), "I", _acc(d), "n_{k}").select("sku_id", F.col("n_1").alias("views"))
    return wn.relative_order(skus, "views", "view_order")


@register("w4_top1_per_user")
def w4(spark, sf):
    return wn.top1_per_key(_pair_scores(load_a(spark, sf)))


@register("m8w_weighted_score")
def m8w(spark, sf):
    """Weighted sum of several score columns, then the best sku per user."""
    from shopcast.operators.cube import cnt0
    d = load_a(spark, sf)
    w = _acc(d)
    sc = fam.aggregate(_cube(d), "UI", [cnt0(w, is_type(k)).cast("double").alias(f"p{k}") for k in (1, 2, 4)], w)
    s = sc.select("user_id", "sku_id", (0.3 * F.col("p4") + 0.07 * F.col("p1") + 0.07 * F.col("p2")).alias("label"))
    return wn.top1_per_key(s)


# ---- sampling (M1–M4) --------------------------------------------------------------------------------

from shopcast.operators import sampling as smp  # noqa: E402


def _pairs_labelled(d):
    D = d["dates"]
    base = fam.decayed_df(_cube(d), "UICB", _acc(d), "action_{k}").select("user_id", "sku_id")
    lab = fam.labels(d["actions"], D.label_start, D.label_end, ("user_id", "sku_id"), cate=D.target_cate)
    return base.join(lab, ["user_id", "sku_id"], "left").na.fill({"label": 0})


@register("m1_downsample_negatives")
def m1(spark, sf):
    return smp.downsample_negatives(_pairs_labelled(load_a(spark, sf)), ["user_id", "sku_id"], ratio=3.0, seed=7)


@register("m2_shuffle_rows")
def m2(spark, sf):
    df = _pairs_labelled(load_a(spark, sf))
    return smp.shuffle_rows(df, ["user_id", "sku_id"], 7).withColumn(
        "shuffle_key", smp.key_hash(7, ["user_id", "sku_id"]))


@register("m3_train_eval_split")
def m3(spark, sf):
    from shopcast.sources.files import staged
    train, held = smp.train_eval_split(staged(_pairs_labelled(load_a(spark, sf)), "labelled"), ["user_id", "sku_id"])
    both = train.withColumn("is_eval", F.lit(0)).unionByName(held.withColumn("is_eval", F.lit(1)))
    return both.withColumn("bucket", smp.split_bucket(0, ["user_id", "sku_id"]))


@register("m4_impute_mean")
def m4(spark, sf):
    from shopcast.operators.model import impute_mean
    d = load_a(spark, sf)
    D = d["dates"]
    cube8 = _cube(d, 30, cate=D.target_cate)
    base = fam.distinct_users(cube8, Win.of(30))
    w5 = fam.type_counts(Win.of(5), "{i}_day_user_action_{k}")
    feats = base.join(cube8.groupBy("user_id").agg(*w5), "user_id", "left")
    return impute_mean(feats, [c for c in feats.columns if c != "user_id"])


# ---- file sources / sinks (S1–S4, S6–S10): round trips through the shared folder ------------------

def _scratch(spark, name: str) -> str:
    import uuid

    from shopcast.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


@register("s1_scan_actions")
def s1(spark, sf):
    """Write the log as three monthly CSV files, read them back as one table."""
    from shopcast.sources.files import scan_actions
    d = load_a(spark, sf)
    a = d["actions"].select("user_id", "sku_id", "time", "model_id", "type", "cate", "brand")
    base = _scratch(spark, "actions")
    from shopcast.functions.timebins import ts_lit
    t, lo, hi = F.col("time"), ts_lit("2024-01-11"), ts_lit("2024-01-21")
    paths = []
    # the outer files are open-ended and the first takes rows without a time, so no row is left out
    for j, rows in enumerate((t.isNull() | (t < lo), (t >= lo) & (t < hi), t >= hi)):
        p = f"{base}/part{j}"
        a.filter(rows).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(p)
        paths.append(p)
    return _rows(scan_actions(spark, paths))


@register("s2_scan_users_gbk")
def s2(spark, sf):
    """User table written and read back in the GBK charset."""
    from shopcast.sources.files import scan_users
    users = load_a(spark, sf)["users"]
    p = _scratch(spark, "users")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    users.write.option("header", True).option("encoding", "GBK").csv(p)
    return scan_users(spark, p, "GBK")


@register("s3_scan_products")
def s3(spark, sf):
    from shopcast.sources.files import scan_products
    p = _scratch(spark, "products")
    load_a(spark, sf)["products"].write.option("header", True).csv(p)
    return scan_products(spark, p)


@register("s4_scan_comments")
def s4(spark, sf):
    from shopcast.sources.files import scan_comments
    p = _scratch(spark, "comments")
    load_a(spark, sf)["comments"].write.option("header", True).csv(p)
    return scan_comments(spark, p).withColumn("dt", F.col("dt").cast("string"))


@register("s6_materialize")
def s6(spark, sf):
    """Decayed counts written once as a feature set keyed by its parameters and the log's files; later calls read it."""
    from shopcast.sources.files import materialize
    d = load_a(spark, sf)
    return materialize(lambda: fam.decayed_df(_cube(d), "UICB", _acc(d), "action_{k}"), "decayed_counts", [d["actions"]], spark,
                       end=str(d["dates"].end), start=str(d["dates"].acc_start))


@register("s7_write_user_submission")
def s7(spark, sf):
    from shopcast.sources.sinks import write_user_submission
    p = _scratch(spark, "pred_user")
    write_user_submission(_user_scores_plain(load_a(spark, sf)), 1000, p)
    return spark.read.option("header", True).schema("user_id long, sku_id long, rank int").csv(p)


@register("s10_read_candidates")
def s10(spark, sf):
    """The candidates of the ranked file written by S7, at most the first 1000."""
    from shopcast.sources.files import read_candidates
    from shopcast.sources.sinks import write_user_submission
    p = _scratch(spark, "pred_user")
    write_user_submission(_user_scores_plain(load_a(spark, sf)), 1000, p)
    return read_candidates(spark, p)


@register("s8_s9_scores_submission")
def s89(spark, sf):
    """Scores CSV written (S8), then read, cast and written as the final submission."""
    from shopcast.sources.sinks import final_submission, write_scores
    p, out = _scratch(spark, "scores"), _scratch(spark, "sub")
    write_scores(_pair_scores(load_a(spark, sf)), p)
    final_submission(spark, p, out)
    return spark.read.option("header", True).schema("user_id long, sku_id long").csv(out)


# ---- models (M5–M8): rows-only checks ---------------------------------------------------------------

def _with_daily(d: dict) -> dict:
    """One pass over the log serves both end dates (train and scoring cubes)."""
    from shopcast.operators.cube import materialized_daily
    return dict(d, daily=materialized_daily(d["actions"]))


def _train_ui(d: dict):
    """The (user, sku) training table of the true buyers (J3), written once so
    every boosting round reads the table, not its plan; and its features."""
    from shopcast.plans.ui_dataset import feature_columns, user_sku_dataset
    from shopcast.sources.files import staged
    D = d["dates"]
    buyers = fam.labels(d["actions"], D.label_start, D.label_end, cate=D.target_cate)
    train = staged(jn.semi_restrict(user_sku_dataset(d, with_label=True), buyers), "ui-train")
    return train, feature_columns(train)


def _user_model_scores(d: dict) -> DataFrame:
    """M6: the user model on D1, scored on D1 at the scoring end."""
    from shopcast.operators.model import fit_predict_boosted
    from shopcast.plans.user_dataset import user_dataset, user_dataset_test
    from shopcast.sources.files import staged
    train = staged(user_dataset(d, with_label=True), "user-train")
    cols = sorted(c for c in train.columns if c not in ("user_id", "label"))
    return fit_predict_boosted(train, user_dataset_test(d), cols).select("user_id", "prob")


def _ensemble_scores(d: dict, candidates: DataFrame) -> DataFrame:
    """M8 on the (user, sku) rows of the (limited) candidate users."""
    from shopcast.operators.model import subspace_ensemble
    from shopcast.plans.ui_dataset import user_sku_dataset
    train, cols = _train_ui(d)
    test = user_sku_dataset(d, with_label=False, end=d["dates"].score_end)
    test = jn.semi_restrict(test, candidates, bound=1000)
    return subspace_ensemble(train, test, cols, parallelism=11).select("user_id", "sku_id", "label")


@register("m6_fit_predict_boosted")
def m6(spark, sf):
    """Entry 1: user model on D1, scored on the shifted D1, top 1000 users (L1 / S7 shape)."""
    from shopcast.sources.sinks import top_users
    return top_users(_user_model_scores(_with_daily(load_a(spark, sf))), 1000)


@register("m5_importance_topn")
def m5(spark, sf):
    """100 boosted trees of depth 6, learning rate 1, on the mean-imputed (user, sku) table; importance > 0, best 50 (L3)."""
    from shopcast.operators.model import fit_gbt, importance_table, impute_mean
    train, cols = _train_ui(load_a(spark, sf))
    m = fit_gbt(impute_mean(train, cols), cols, max_depth=6, max_iter=100, step=1.0)
    return ev.importance_topn(importance_table(spark, m, cols), 50)


@register("m7_importance_partition")
def m7(spark, sf):
    """Up to 1000 rounds until 50 bring no better AUC; how often the model splits on each feature."""
    from shopcast.operators.model import fit_stopped
    train, cols = _train_ui(load_a(spark, sf))
    splits = fit_stopped(train, cols).split_counts(spark)
    return splits.select("feature", "splits", (F.col("splits") > 0).cast("int").alias("used"))


@register("m8_subspace_ensemble")
def m8(spark, sf):
    """Entries 1 to 3: the user model's best 1000 users to the ranked candidate
    file (S7), read back (S10) to restrict the scoring rows of the 11-model
    ensemble, the best sku per user (W4) to the score file (S8) and from it the
    submission (S9)."""
    from shopcast.sources.files import read_candidates
    from shopcast.sources.sinks import final_submission, write_scores, write_user_submission
    d = _with_daily(load_a(spark, sf))
    users, scores, out = (_scratch(spark, x) for x in ("pred_user", "scores", "submission"))
    write_user_submission(_user_model_scores(d), 1000, users)
    best = wn.top1_per_key(_ensemble_scores(d, read_candidates(spark, users)))
    write_scores(best, scores)
    return final_submission(spark, scores, out)


# ---- streaming: daily table maintained by a file stream, cube derived for the end date ----------

@register("st1_streamed_daily_cube")
def st1(spark, sf):
    """The adapter-A log lands as two file drops; a file stream keeps the
    daily table (two micro-batches); the cube for ``end`` is derived from it."""
    from shopcast.streaming import cube_from_daily, read_daily, start_daily_cube
    d = load_a(spark, sf)
    D = d["dates"]
    src, sink, ck = _scratch(spark, "src"), _scratch(spark, "daily"), _scratch(spark, "ck")
    a = d["actions"]
    from shopcast.functions.timebins import ts_lit
    a.filter(F.col("time") < ts_lit("2024-01-15")).write.parquet(f"{src}/drop=1")
    a.filter(F.col("time") >= ts_lit("2024-01-15")).write.parquet(f"{src}/drop=2")
    q = start_daily_cube(spark, f"{src}/*", sink, ck, max_files_per_trigger=1)
    q.awaitTermination()
    cube = cube_from_daily(read_daily(spark, sink), D.end, D.acc_start)
    return cube.select("user_id", "sku_id", "cate", "brand", "type", "c", "b", "n",
                       _ts("t_min").alias("t_min"), _ts("t_max").alias("t_max"))


# ---- D2: wide user dataset --------------------------------------------------------------------------

@register("d2_user_dataset_wide")
def d2(spark, sf):
    from shopcast.plans.wide_user import user_dataset_wide
    return user_dataset_wide(load_a(spark, sf), with_label=True)


@register("d2_user_dataset_wide_test")
def d2_test(spark, sf):
    from shopcast.plans.wide_user import user_dataset_wide_test
    return user_dataset_wide_test(load_a(spark, sf))


@register("d2_user_dataset_wide_lineitem")
def d2_b(spark, sf):
    from shopcast.plans.wide_user import user_dataset_wide
    return user_dataset_wide(load_b(spark, sf), with_label=True)


# ---- projections exercised on their own (P1, P4, P6, P8, J1/J2, D4) ----------------------------------

@register("p1_project_rename")
def p1(spark, sf):
    """Select / drop / rename on the decayed-count table."""
    d = load_a(spark, sf)
    df = fam.decayed_df(_cube(d), "UICB", _acc(d), "action_{k}")
    return df.drop("brand", "action_6").withColumnsRenamed({"action_4": "buy_decay", "action_1": "view_decay"})


@register("p4_row_sum")
def p4(spark, sf):
    from shopcast.functions.exprs import row_sum
    d = load_a(spark, sf)
    df = fam.type_counts_df(_cube(d, 5), "U", W5, "{i}_user_action_{k}")
    return df.select("user_id", row_sum([f"5_user_action_{k}" for k in range(1, 7)]).alias("5_user_action_sum"))


@register("p6_fill_replace")
def p6(spark, sf):
    """inf -> NULL, NULL -> 0 for ratios; NULL or <= 0 -> -1 for recency hours."""
    from shopcast.functions.exprs import nonpositive_to
    d = load_a(spark, sf)
    D = d["dates"]
    cube8 = _cube(d, cate=D.target_cate)
    w = _acc(d)
    ms = fam.conv_ratios(w, "user_action_{k}_ratio", ks=(1, 2, 5, 6), on_zero="inf")
    ms += [fam.recency_hours(w, D.end, "user_buy_last", is_type(PURCHASE))]
    df = fam.aggregate(cube8, "U", ms, w)
    ratios = [f"user_action_{k}_ratio" for k in (1, 2, 5, 6)]
    df = df.select("user_id", *[F.when(F.col(c) == float("inf"), None).otherwise(F.col(c)).alias(c) for c in ratios],
                   nonpositive_to("user_buy_last").alias("user_buy_last"))
    return df.na.fill(0, ratios)


@register("p8_pair_key")
def p8(spark, sf):
    d = load_a(spark, sf)
    D = d["dates"]
    lab = fam.labels(d["actions"], D.label_start, D.label_end, ("user_id", "sku_id"), cate=D.target_cate)
    return lab.select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("sku_id").cast("string")).alias("pair"))


@register("j1_j2_left_joins")
def j12(spark, sf):
    """One-key (user) and two-key (user, sku) left joins onto the pair base."""
    from shopcast.operators.cube import cnt0
    d = load_a(spark, sf)
    w = _acc(d)
    cube = _cube(d)
    base = fam.decayed_df(cube, "UICB", w, "action_{k}").select("user_id", "sku_id")
    u = fam.type_counts_df(_cube(d, 5), "U", W5, "{i}_user_action_{k}").select("user_id", "5_user_action_4")
    ui = fam.recency_df(cube, "UI", w, "ui_last_buy", PURCHASE)
    return jn.left_join(jn.left_join(base, u, "user_id"), ui, ["user_id", "sku_id"])


@register("d4_drop_columns")
def d4(spark, sf):
    """D4 on the user table: keys and label out, sex one-hot removed."""
    from shopcast.plans.user_dataset import user_dataset
    df = user_dataset(load_a(spark, sf), with_label=True)
    feats = sorted(c for c in df.columns if c not in ("user_id", "label") and not c.startswith("sex_"))
    return df.select(*[F.col(f"`{c}`") for c in feats])
