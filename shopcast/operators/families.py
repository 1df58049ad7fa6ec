"""Feature families over the activity cube.

Each family has two faces:

* a *measure* function returning aggregate Columns for one window — the
  dataset builders (``plans/``) fuse the measures of many families and
  windows into ONE ``groupBy(grain).agg(...)`` per grain;
* a DataFrame operator (``*_df``) that runs one family for one window, with
  exactly the rows the family's own table has (groups with an event in the
  window and the family's filter).

Zero-division follows an explicit policy per family (``safe_ratio``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.functions.timebins import ts_lit, window_start
from shopcast.operators.cube import (
    ALL, GRAINS, Win, cnt, cnt0_sql, cnt_sql, day_level, day_mask_aggs, days_from_masks, days_in, in_win,
    is_type, present_sql, ratio_sql, sql_col, type_sql, win_sql,
)
from shopcast.schemas import CONV_TYPES, MODEL_IDS, PURCHASE, TYPES


def _keys(grain):
    return list(GRAINS[grain]) if isinstance(grain, str) else list(grain)


# ---- measures ---------------------------------------------------------------

def type_counts(w: Win, fmt: str, types=TYPES) -> list[Column]:
    """A1: events per type in the window; NULL for groups absent from it."""
    return [sql_col(present_sql(w, cnt0_sql(w, type_sql(k))), fmt.format(i=w.label, k=k)) for k in types]


def conv_ratios(w: Win, fmt: str, ks=CONV_TYPES, on_zero: str = "zero") -> list[Column]:
    """Purchases / type-k events."""
    buys = cnt0_sql(w, type_sql(PURCHASE))
    return [sql_col(present_sql(w, ratio_sql(buys, cnt0_sql(w, type_sql(k)), on_zero)), fmt.format(i=w.label, k=k))
            for k in ks]


def decayed_counts(w: Win, fmt: str, types=TYPES) -> list[Column]:
    """A3: sum of exp(-elapsed days) per type."""
    out = []
    for k in types:
        s = f"sum(CASE WHEN {win_sql(w)} AND type = {k} THEN n * exp(-CAST(b AS DOUBLE)) END)"
        out.append(sql_col(present_sql(w, f"coalesce({s}, 0D)"), fmt.format(i=w.label, k=k)))
    return out


def recency_days(w: Win, name: str, k: int) -> Column:
    """Elapsed days since the latest type-k event (NULL if none)."""
    return sql_col(f"min(CASE WHEN {win_sql(w)} AND type = {k} THEN b END)", name)


def recency_hours(w: Win, end, name: str, cond: Column | None = None) -> Column:
    """Whole hours from the latest (matching) event to ``end``."""
    m = in_win(w) if cond is None else (in_win(w) & cond)
    return F.timestamp_diff("HOUR", F.max(F.when(m, F.col("t_max"))), ts_lit(end)).alias(name)


def first_last_buy(w: Win, first_name: str, interval_name: str) -> list[Column]:
    """Elapsed days of the first purchase and first − last."""
    m = f"{win_sql(w)} AND type = {PURCHASE}"
    first, last = f"max(CASE WHEN {m} THEN b END)", f"min(CASE WHEN {m} THEN b END)"
    return [sql_col(first, first_name), sql_col(f"{first} - {last}", interval_name)]


def purchase_rows(w: Win, name: str) -> Column:
    """Purchase rows (not distinct skus); NULL when none."""
    return sql_col(cnt_sql(w, type_sql(PURCHASE)), name)


def type_shares(w: Win, fmt: str, types=TYPES, on_zero: str = "null") -> list[Column]:
    """Type count / all events in the window."""
    tot = cnt0_sql(w)
    return [sql_col(present_sql(w, ratio_sql(cnt0_sql(w, type_sql(k)), tot, on_zero)), fmt.format(i=w.label, k=k))
            for k in types]


# ---- one-family operators -----------------------------------------------------

def aggregate(cube: DataFrame, grain, measures, w: Win = ALL, cond: Column | None = None) -> DataFrame:
    """Run measures at a grain, keeping groups with an event in the window
    (and condition) — the rows the family's own table would have."""
    keys = _keys(grain)
    pres = F.max(F.when(in_win(w) & (F.lit(True) if cond is None else cond), F.lit(1)))
    return (cube.groupBy(*keys).agg(*measures, pres.alias("_present"))
                .filter(F.col("_present") == 1).drop("_present"))


def type_counts_df(cube, grain, w: Win, fmt: str, types=TYPES) -> DataFrame:
    return aggregate(cube, grain, type_counts(w, fmt, types), w)


def conv_ratio_df(cube, grain, w: Win, fmt: str, ks=CONV_TYPES, on_zero="zero") -> DataFrame:
    return aggregate(cube, grain, conv_ratios(w, fmt, ks, on_zero), w)


def decayed_df(cube, grain="UICB", w: Win = ALL, fmt: str = "action_{k}") -> DataFrame:
    return aggregate(cube, grain, decayed_counts(w, fmt), w)


def recency_df(cube, grain, w: Win, name: str, k: int) -> DataFrame:
    return aggregate(cube, grain, [recency_days(w, name, k)], w, is_type(k))


def first_last_df(cube, grain, w: Win, first_name: str, interval_name: str) -> DataFrame:
    return aggregate(cube, grain, first_last_buy(w, first_name, interval_name), w, is_type(PURCHASE))


def active_days_df(cube, grain, w: Win, name: str, purchase: bool = False, by: str = "b") -> DataFrame:
    """A4a (``by='c'``, calendar days) / A4b–d (``by='b'``, elapsed days):
    day bitmasks in one aggregate; an unbounded window falls back to a
    day-level table."""
    keys = _keys(grain)
    if w.days is None:
        days = day_level(cube, keys, by)
        return (days.groupBy(*keys).agg(days_in(w, purchase).alias(name))
                    .filter(F.col(name).isNotNull()))
    g = cube.groupBy(*keys).agg(*day_mask_aggs("d", w.days, "type = 4" if purchase else None, by=by))
    return (g.select(*keys, F.expr(days_from_masks("d", w, w.days, by=by)).alias(name))
             .filter(F.col(name).isNotNull()))


def distinct_skus_df(cube, w: Win, name: str) -> DataFrame:
    """Distinct skus per user in the window."""
    lvl = cube.groupBy("user_id", "sku_id").agg(F.min("c").alias("mc"))
    m = F.col("mc").isNotNull() if w.days is None else (F.col("mc") <= w.days)
    return (lvl.groupBy("user_id").agg(F.nullif(F.count(F.when(m, 1)), F.lit(0)).alias(name))
               .filter(F.col(name).isNotNull()))


def distinct_users(cube: DataFrame, w: Win = ALL, cond: Column | None = None) -> DataFrame:
    """Users with an event (matching ``cond``) in the window."""
    m = in_win(w) if cond is None else (in_win(w) & cond)
    return cube.filter(m).select("user_id").distinct()


def labels(actions: DataFrame, start, end, keys=("user_id",), cate: int | None = None) -> DataFrame:
    """A15u / A15ui: distinct purchasers (or purchased pairs) in
    ``[start, end)`` with ``label = 1``."""
    m = (F.col("time") >= ts_lit(start)) & (F.col("time") < ts_lit(end)) & is_type(PURCHASE)
    if cate is not None:
        m = m & (F.col("cate") == cate)
    return actions.filter(m).select(*keys).distinct().withColumn("label", F.lit(1))


def truth_rows(actions: DataFrame, start, end, cate: int | None = None) -> DataFrame:
    """A15t: purchase rows (of one category), not de-duplicated."""
    m = (F.col("time") >= ts_lit(start)) & (F.col("time") < ts_lit(end)) & is_type(PURCHASE)
    if cate is not None:
        m = m & (F.col("cate") == cate)
    return actions.filter(m).select("user_id")


def action_period(cube: DataFrame, users: DataFrame, w: Win, window_days: int,
                  fmt: str = "{i}_action_period_{k}", mode: str = "intended") -> DataFrame:
    """A10: window days / events per type, over the full user list; -1 when
    the user has none.  ``mode='as_written'`` divides by the user's total row
    count for every type (the source's count-of-dummies behaviour)."""
    aggs = []
    for k in TYPES:
        c = cnt(w) if mode == "as_written" else cnt(w, is_type(k))
        aggs.append(c.alias(f"_n{k}"))
    per = cube.groupBy("user_id").agg(*aggs)
    j = users.select("user_id").join(per, "user_id", "left")
    out = [F.col("user_id")]
    for k in TYPES:
        n = F.col(f"_n{k}")
        out.append(F.when(n > 0, F.lit(float(window_days)) / n).otherwise(F.lit(-1.0))
                   .alias(fmt.format(i=w.label, k=k)))
    return j.select(*out)


def model_id_counts(actions: DataFrame, start, end, keys=("user_id",), prefix: str = "user_model_id",
                    cate: int | None = None, mode: str = "intended", ids=MODEL_IDS) -> DataFrame:
    """Events with a listed model id.  ``intended`` counts per id value;
    ``as_written`` gives every id column the group's total count."""
    m = (F.col("time") >= ts_lit(start)) & (F.col("time") < ts_lit(end)) & F.col("model_id").isin(list(ids))
    if cate is not None:
        m = m & (F.col("cate") == cate)
    src = actions.filter(m)
    if mode == "as_written":
        aggs = [F.count(F.lit(1)).alias(f"{prefix}_{v}") for v in ids]
    else:
        aggs = [F.count(F.when(F.col("model_id") == v, 1)).alias(f"{prefix}_{v}") for v in ids]
    return src.groupBy(*keys).agg(*aggs)


def hour_window_counts(actions: DataFrame, end, hours=(4, 8, 16), fmt: str = "{h}_h_user_action_{k}",
                       active_fmt: str = "{h}_h_user_active_hours", cate: int | None = None) -> DataFrame:
    """Per-user type counts and distinct hours-of-day in the last
    ``h`` hours, for several ``h``, in ONE aggregate over the last ``max(h)``
    hours.  Distinct hours are a 24-bit mask (``bit_or(1 << hour)``), so no
    level table and no ``collect_set``."""
    lo = window_start(end, hours=max(hours))
    m = (F.col("time") >= ts_lit(lo)) & (F.col("time") < ts_lit(end))
    if cate is not None:
        m = m & (F.col("cate") == cate)
    src = actions.filter(m).select("user_id", "type", "time")
    aggs = []
    for h in hours:
        st = window_start(end, hours=h).strftime("%Y-%m-%d %H:%M:%S")
        inh = f"time >= TIMESTAMP_NTZ'{st}'"
        pres = f"count(CASE WHEN {inh} THEN 1 END) > 0"
        for k in TYPES:
            aggs.append(sql_col(f"CASE WHEN {pres} THEN count(CASE WHEN {inh} AND type = {k} THEN 1 END) END",
                                fmt.format(h=h, k=k)))
        aggs.append(sql_col(f"CASE WHEN {pres} THEN CAST(bit_count(bit_or(CASE WHEN {inh} THEN "
                            f"shiftleft(1L, hour(time)) END)) AS BIGINT) END", active_fmt.format(h=h)))
    return src.groupBy("user_id").agg(*aggs)
