"""User × category pivots (A13a–A13f) with a fixed category vocabulary.

Every pivot is a conditional aggregate ``agg(f(when(cate == c, …)))`` over
the cube — one pass, schema independent of which categories occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.operators.cube import (
    Win, cnt0_sql, cnt_sql, day_level, day_mask_aggs, days_from_masks, in_win, is_type, ratio_sql, sql_col,
)
from shopcast.schemas import CATES, CONV_TYPES, PURCHASE, TYPES


def _is_cate(c):
    return F.col("cate") == F.lit(c)


def cate_pivot_counts(cube: DataFrame, w: Win, cates=CATES,
                      fmt: str = "{i}_cate_{c}_action_{k}") -> DataFrame:
    """The six type counts per category (0 when none)."""
    aggs = [sql_col(cnt0_sql(w, f"cate = {c} AND type = {k}"), fmt.format(i=w.label, c=c, k=k))
            for c in cates for k in TYPES]
    return cube.filter(in_win(w)).groupBy("user_id").agg(*aggs)


def cate_pivot_conv(cube: DataFrame, w: Win, cates=CATES,
                    fmt: str = "{i}_cate_{c}_conv_ratio_{k}") -> DataFrame:
    """Conversion ratios per category; 0 for x/0, NULL where the user
    has no event in that category."""
    aggs = []
    for c in cates:
        buys = cnt0_sql(w, f"cate = {c} AND type = {PURCHASE}")
        seen = f"{cnt_sql(w, f'cate = {c}')} IS NOT NULL"
        for k in CONV_TYPES:
            r = ratio_sql(buys, cnt0_sql(w, f"cate = {c} AND type = {k}"), "zero")
            aggs.append(sql_col(f"CASE WHEN {seen} THEN {r} END", fmt.format(i=w.label, c=c, k=k)))
    return cube.filter(in_win(w)).groupBy("user_id").agg(*aggs)


def cate_pivot_days(cube: DataFrame, w: Win, cates=CATES,
                    fmt: str = "{i}_cate_{c}_{what}_days") -> DataFrame:
    """Distinct elapsed days per category, any event / purchases (day
    bitmasks per category in one aggregate; 0 when none)."""
    if w.days is None:
        lvl = day_level(cube, ["user_id", "cate"], "b")
        aggs = [F.count(F.when(_is_cate(c) & F.col(col).isNotNull(), 1)).alias(fmt.format(i=w.label, c=c, what=what))
                for c in cates for what, col in (("action", "mc"), ("buy", "mc4"))]
        return lvl.groupBy("user_id").agg(*aggs)
    masks = []
    for c in cates:
        masks += day_mask_aggs(f"a{c}_", w.days, f"cate = {c}") + day_mask_aggs(f"p{c}_", w.days, f"cate = {c} AND type = 4")
    g = cube.filter(in_win(w)).groupBy("user_id").agg(*masks)
    out = [F.col("user_id")]
    for c in cates:
        for what, tag in (("action", f"a{c}_"), ("buy", f"p{c}_")):
            out.append(F.expr(f"coalesce({days_from_masks(tag, w, w.days)}, 0)").cast("long")
                       .alias(fmt.format(i=w.label, c=c, what=what)))
    return g.select(*out)


def cate_pivot_recency(cube: DataFrame, w: Win, cates=CATES,
                       fmt: str = "cate_{c}_last_buy") -> DataFrame:
    """A13d: elapsed days since the last purchase per category, 0 if never."""
    aggs = [F.coalesce(F.min(F.when(in_win(w) & _is_cate(c) & is_type(PURCHASE), F.col("b"))),
                       F.lit(0).cast("long")).alias(fmt.format(c=c)) for c in cates]
    return cube.filter(in_win(w)).groupBy("user_id").agg(*aggs)


def cate_purchase_basket(cube: DataFrame, users: DataFrame, w: Win, cates=CATES,
                         fmt: str = "cate_{c}") -> DataFrame:
    """A13e: purchases per category on the full user list (NULL for users
    without purchases, 0 for categories a buyer did not buy in)."""
    buys = cube.filter(in_win(w) & is_type(PURCHASE))
    per = buys.groupBy("user_id").agg(*[F.coalesce(F.sum(F.when(_is_cate(c), F.col("n"))),
                                                   F.lit(0).cast("long")).alias(fmt.format(c=c))
                                        for c in cates])
    return users.select("user_id").join(per, "user_id", "left")


def cate_rank_pivot(cate_shares: DataFrame, cates=CATES,
                    fmt: str = "cate_{c}_{what}") -> DataFrame:
    """A13f: pivot of W1c (rank and purchase share) by category."""
    aggs = []
    for c in cates:
        aggs.append(F.max(F.when(_is_cate(c), F.col("cate_user_rank"))).alias(fmt.format(c=c, what="rank")))
        aggs.append(F.max(F.when(_is_cate(c), F.col("cate_user_ratio_4"))).alias(fmt.format(c=c, what="ratio_4")))
    return cate_shares.groupBy("user_id").agg(*aggs)
