"""The wide user dataset (second user feature set).

Base rows: users with an event in the target category in the last ``days``
days.  Families (accumulate window plus every day window unless noted):
conversion ratios, type counts (no purchases), action period, per-category
conversion pivot, target-category active / purchase days, active / purchase
days, type shares inside the target category; accumulate-only: profile,
registration days and registration-to-first-purchase bucket, last cart /
purchase, category share pivot, purchase basket, last purchase per category,
cart-vs-uncart recency (aggregated per user first); statistics at 0 / 5 / 30.
All NULLs are filled with 0; the label is a purchase in the category in the
label window.

Physical plan: one materialized cube; everything that is a sum, minimum or
maximum per user, in windows or categories, and the distinct-day families
(day bitmasks) are ONE user-grain aggregate; the rank pivot and the two-level
statistics are one more each; with the profile and the label that makes five
joins on ``user_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.timebins import window_start
from shopcast.operators import families as fam
from shopcast.operators import pivots, shares, stats
from shopcast.operators.cube import (
    Win, cnt0_sql, cnt_sql, day_mask_aggs, days_from_masks, mask_columns, materialized_cube, ratio_sql, sql_col,
    type_sql, win_sql,
)
from shopcast.operators.profile import AGE_CODES_0_6, first_buy_bucket, static_user_features
from shopcast.schemas import CATES, CONV_TYPES, PURCHASE, TYPES, UI_DAY_WINDOWS
from shopcast.sources.adapters import Dates


def period_measures(w: Win, window_days: int, fmt: str) -> list:
    """A10 (intended) as measures: window days / type-k events, -1 when none."""
    return [sql_col(f"CASE WHEN {cnt0_sql(w, type_sql(k))} > 0 THEN {float(window_days)}D / {cnt0_sql(w, type_sql(k))} "
                    f"ELSE -1.0D END", fmt.format(i=w.label, k=k)) for k in TYPES]


def basket_measures(w: Win, fmt: str, cates=CATES) -> list:
    """A13e as measures: purchases per category, 0 where there are none."""
    return [sql_col(cnt0_sql(w, f"cate = {c} AND {type_sql(PURCHASE)}"), fmt.format(c=c)) for c in cates]


def recency_in_cate_measures(w: Win, fmt: str, cates=CATES) -> list:
    """A13d as measures: elapsed days since the last purchase per category, 0 if never."""
    return [sql_col(f"coalesce(min(CASE WHEN {win_sql(w)} AND cate = {c} AND {type_sql(PURCHASE)} THEN b END), 0)",
                    fmt.format(c=c)) for c in cates]


def of_known_users(df: DataFrame, columns, first_buy: str) -> DataFrame:
    """Families over the full user list, on rows that have the user aggregate
    and ``static_user_features``: NULL for users the list does not have (a user
    without events has the measures' values for none), and A8c."""
    kept = {c: F.when(F.col("_known"), F.col(f"`{c}`")).alias(c) for c in columns}
    return df.select(*[kept.get(c, F.col(f"`{c}`")) for c in df.columns], first_buy_bucket(first_buy))


def cate_share_measures(w: Win, cate: int, fmt: str) -> list:
    """A9 as measures: type share among the user's events in ``cate``."""
    tot = cnt_sql(w, f"cate = {cate}")
    return [sql_col(f"CASE WHEN {tot} IS NOT NULL THEN "
                    f"{ratio_sql(cnt0_sql(w, f'cate = {cate} AND type = {k}'), tot, 'zero')} END",
                    fmt.format(i=w.label, k=k)) for k in TYPES]


def cate_conv_measures(w: Win, fmt: str, cates=CATES) -> list:
    """A13b as measures."""
    out = []
    for c in cates:
        buys = cnt0_sql(w, f"cate = {c} AND type = {PURCHASE}")
        seen = f"{cnt_sql(w, f'cate = {c}')} IS NOT NULL"
        for k in CONV_TYPES:
            r = ratio_sql(buys, cnt0_sql(w, f"cate = {c} AND type = {k}"), "zero")
            out.append(sql_col(f"CASE WHEN {seen} THEN {r} END", fmt.format(i=w.label, c=c, k=k)))
    return out


def user_dataset_wide(src: dict, with_label: bool = True, end=None, days: int = 5,
                      windows=UI_DAY_WINDOWS) -> DataFrame:
    D: Dates = src["dates"]
    end = end or D.end
    cate = D.target_cate
    acc_days = (end - D.acc_start).days
    acc = Win(0, acc_days)
    racc = Win(0, (end - D.rank_start).days)    # conversions, registration to first purchase
    wins = [Win.of(i) for i in windows]
    allw = [acc] + wins
    start = min(D.acc_start, D.rank_start, window_start(end, days=max(windows)))
    cube = materialized_cube(src["actions"], end, start, src.get("daily"))
    users = src["users"]

    base = fam.distinct_users(cube.filter(F.col("cate") == cate), Win.of(days))

    m = []
    for w in allw:
        wd = acc_days if w is acc else w.days
        m += fam.conv_ratios(racc if w is acc else w, "{i}_user_conv_ratio_{k}")
        m += fam.type_counts(w, "{i}_user_action_{k}", CONV_TYPES)
        m += period_measures(w, wd, "{i}_action_period_{k}")
        m += cate_share_measures(w, cate, "{i}_user_cate8_ratio_{k}")
    m += [fam.first_last_buy(racc, "_first_buy", "_interval")[0]]
    m += basket_measures(acc, "cate_{c}") + recency_in_cate_measures(acc, "cate_{c}_last_buy")
    # J4 default: latest cart / uncart per user in the category, then the flag
    in8 = f"{win_sql(acc)} AND cate = {cate}"
    last_cart = f"min(CASE WHEN {in8} AND type = 2 THEN b END)"
    last_del = f"coalesce(min(CASE WHEN {in8} AND type = 3 THEN b END), 0)"
    m += [sql_col(last_cart, "uc8_last_cart"),
          sql_col(f"CASE WHEN {last_cart} IS NOT NULL THEN {last_del} END", "uc8_last_del_cart"),
          sql_col(f"CAST({last_del} - {last_cart} >= 0 AS INT)", "buy_possible")]
    m += [fam.recency_days(acc, "user_last_cart", 3), fam.recency_days(acc, "user_last_buy", PURCHASE)]
    # per-category conversions since rank_start; in the day windows of the target category only
    m += cate_conv_measures(racc, "{i}_cate_{c}_conv_ratio_{k}")
    m += [c for w in wins for c in cate_conv_measures(w, "{i}_cate_{c}_conv_ratio_{k}", (cate,))]
    # distinct active / purchase days (all categories and the target one) from day bitmasks
    max_day = max(acc_days, max(windows))
    masks = [("ux", None), ("up", "type = 4"), ("cx", f"cate = {cate}"), ("cp", f"cate = {cate} AND type = 4")]
    for tag, cond in masks:
        m += day_mask_aggs(tag, max_day, cond)
    g = cube.groupBy("user_id").agg(*m)
    day_cols = []
    for w in allw:
        day_cols += [F.expr(days_from_masks("ux", w, max_day)).alias(f"{w.label}_user_action_tm"),
                 F.expr(days_from_masks("up", w, max_day)).alias(f"{w.label}_user_action_buy_tm"),
                 F.expr(f"coalesce({days_from_masks('cx', w, max_day)}, 0)").alias(f"{w.label}_cate_{cate}_action_days"),
                 F.expr(f"coalesce({days_from_masks('cp', w, max_day)}, 0)").alias(f"{w.label}_cate_{cate}_buy_days")]
    hidden = [c for tag, _ in masks for c in mask_columns(g, tag)]
    u = g.select(*[F.col(f"`{c}`") for c in g.columns if c not in hidden], *day_cols)

    parts = [
        u,
        static_user_features(users, end, AGE_CODES_0_6, drop_sex=True),
        pivots.cate_rank_pivot(shares.cate_share_in_user(cube, acc)),
        stats.user_category_sku_stats(cube, [acc, Win.of(5), Win.of(30)], cate),
    ]
    df = base
    for p in parts:
        df = df.join(p, "user_id", "left")
    df = of_known_users(df, [f"cate_{c}" for c in CATES], "_first_buy").drop("_reg", "_known", "_first_buy")
    if with_label:
        lab = fam.labels(src["actions"], D.label_start, D.label_end, cate=cate)
        df = df.join(lab, "user_id", "left")
    return df.na.fill(0)


def user_dataset_wide_test(src: dict, days: int = 5) -> DataFrame:
    return user_dataset_wide(src, with_label=False, end=src["dates"].score_end, days=days)
