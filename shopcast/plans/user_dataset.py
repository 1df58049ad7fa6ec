"""D1 and its parts D5–D8: the user-level dataset of the user model.

Base rows: users with an event in the target category in the last 30 days.
Features (all on the category slice unless noted):

* D5 accumulated: type counts, conversion ratios (x/0 kept as +inf),
  calendar active / purchase days, hours since last event / purchase, and
  avg / max / min / var of the user's per-sku type counts (+ their sum);
* D6 accumulated over all categories: calendar active / purchase days and
  hours since the last event;
* D7 per day window: type counts; windows 5 and 30 add the per-sku
  statistics, window 1 adds distinct hours and skus, the others calendar
  active / purchase days;
* D8 hour windows 4 / 8 / 16: type counts and distinct hours;
* profile one-hot (age code 0..6, level; sex removed — D4).

Label (purchase in the category in the label window) is filled with 0; all
other missing values stay NULL.  Every per-window family of one grain is one
conditional aggregate over the shared cube.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.timebins import window_start
from shopcast.operators import families as fam
from shopcast.operators import stats
from shopcast.operators.cube import (
    Win, day_mask_aggs, days_from_masks, is_type, mask_columns, materialized_cube,
)
from shopcast.operators.profile import AGE_CODES_0_6, basic_user_features
from shopcast.schemas import PURCHASE, TYPES, USER_MODEL_DAY_WINDOWS, USER_MODEL_HOUR_WINDOWS
from shopcast.sources.adapters import Dates

SAMPLE_DAYS = 30


def _with_cal_days(cube, measures, wins, any_fmt, buy_fmt, max_day):
    """User aggregate plus calendar active / purchase days per window from
    calendar-day bitmasks in the same aggregate."""
    g = cube.groupBy("user_id").agg(*measures, *day_mask_aggs("da", max_day, by="c"),
                                    *day_mask_aggs("dp", max_day, "type = 4", by="c"))
    days = []
    for w, lab in wins:
        days.append(F.expr(days_from_masks("da", w, max_day, by="c")).alias(any_fmt.format(i=lab)))
        days.append(F.expr(days_from_masks("dp", w, max_day, by="c")).alias(buy_fmt.format(i=lab)))
    hidden = mask_columns(g, "da") + mask_columns(g, "dp")
    return g.select(*[F.col(f"`{c}`") for c in g.columns if c not in hidden], *days)


def _max_day(cube_days: int) -> int:
    return cube_days + 1


def user_accumulate(cube8: DataFrame, end, acc: Win) -> DataFrame:
    """D5 (without the statistics part, see ``user_dataset``)."""
    ms = fam.type_counts(acc, "user_action_{k}")
    ms += fam.conv_ratios(acc, "user_action_{k}_ratio", ks=(1, 2, 5, 6), on_zero="inf")
    ms += [fam.recency_hours(acc, end, "user_active_last"),
           fam.recency_hours(acc, end, "user_buy_last", is_type(PURCHASE))]
    md = _max_day(acc.days)
    u = _with_cal_days(cube8.filter(F.col("c") <= acc.days), ms, [(acc, "")], "user_active_days{i}",
                       "user_buy_days{i}", md)
    return u


def user_accumulate_all(cube: DataFrame, end, acc: Win) -> DataFrame:
    """All categories."""
    md = _max_day(acc.days)
    return _with_cal_days(cube.filter(F.col("c") <= acc.days), [fam.recency_hours(acc, end, "user_all_cate_active_last")],
                          [(acc, "")], "user_all_cate_active_days{i}", "user_all_cate_buy_days{i}", md)


def user_windows(cube8: DataFrame, windows=USER_MODEL_DAY_WINDOWS) -> DataFrame:
    """D7 counts and calendar days for every day window in one aggregate."""
    ms = []
    for i in windows:
        ms += fam.type_counts(Win.of(i), "{i}_day_user_action_{k}")
    day_wins = [(Win.of(i), i) for i in windows if i != 1]
    u = _with_cal_days(cube8, ms, day_wins, "{i}_day_user_active_days", "{i}_day_user_buy_days", _max_day(max(windows)))
    # rows only for users with an event in the widest window (as the per-window tables)
    return u.filter(F.col(f"{max(windows)}_day_user_action_1").isNotNull())


def user_windows_and_accumulate(cube8: DataFrame, end, acc: Win, windows=USER_MODEL_DAY_WINDOWS) -> DataFrame:
    """D5 and D7 in one aggregate (the base's users all have events in the
    widest window, so D7's restriction to such users takes nothing away)."""
    ms = [m for i in windows for m in fam.type_counts(Win.of(i), "{i}_day_user_action_{k}")]
    ms += fam.type_counts(acc, "user_action_{k}")
    ms += fam.conv_ratios(acc, "user_action_{k}_ratio", ks=(1, 2, 5, 6), on_zero="inf")
    ms += [fam.recency_hours(acc, end, "user_active_last"),
           fam.recency_hours(acc, end, "user_buy_last", is_type(PURCHASE))]
    md = _max_day(max(acc.days, max(windows)))
    wins = [(Win.of(i), f"{i}_day_user") for i in windows if i != 1] + [(acc, "user")]
    return _with_cal_days(cube8, ms, wins, "{i}_active_days", "{i}_buy_days", md)


def user_dataset(src: dict, with_label: bool = True, end=None,
                 windows=USER_MODEL_DAY_WINDOWS, hours=USER_MODEL_HOUR_WINDOWS) -> DataFrame:
    D: Dates = src["dates"]
    end = end or D.end
    cate = D.target_cate
    acc = Win(0, (end - D.acc_start).days)
    start = min(D.acc_start, window_start(end, days=max(max(windows), SAMPLE_DAYS)))
    cube = materialized_cube(src["actions"], end, start, src.get("daily"))
    cube8 = cube.filter(F.col("cate") == cate)
    actions8 = src["actions"].filter(F.col("cate") == cate)

    base = fam.distinct_users(cube8, Win.of(SAMPLE_DAYS))
    hour = fam.hour_window_counts(actions8, end, (*hours, 24), fmt="{h}_h_user_action_{k}", active_fmt="{h}_h_user_active_hours")
    hour = hour.withColumnRenamed("24_h_user_active_hours", "1_day_user_active_hours").drop(
        *[f"24_h_user_action_{k}" for k in TYPES])
    per_sku = stats.user_sku_stats(cube8, [acc, Win.of(5), Win.of(30)], "{i}_day_user_action_{k}_{stat}")
    per_sku = per_sku.withColumnsRenamed({c: c.replace("0_day_user", "user", 1) for c in per_sku.columns if c.startswith("0_day_")})
    parts = [
        user_windows_and_accumulate(cube8, end, acc, windows),
        hour,
        fam.distinct_skus_df(cube8, Win.of(1), "1_day_user_product_nums"),
        per_sku,
        basic_user_features(src["users"], AGE_CODES_0_6, drop_sex=True),
        user_accumulate_all(cube, end, acc),
    ]
    df = base
    for p in parts:
        df = df.join(p, "user_id", "left")
    if with_label:
        lab = fam.labels(actions8, D.label_start, D.label_end)
        df = df.join(lab, "user_id", "left").na.fill({"label": 0})
    return df


def user_dataset_test(src: dict) -> DataFrame:
    """Scoring form: end shifted to the scoring end, no label."""
    return user_dataset(src, with_label=False, end=src["dates"].score_end)
