"""Oracle SQL per registered query key (DuckDB dialect)."""

from __future__ import annotations

from sqloracle import A, B, Ctx, dt, in_range, minus_days, ts

TYPES = (1, 2, 3, 4, 5, 6)
CONV = (1, 2, 3, 5, 6)
CATES = (4, 5, 6, 7, 8, 9, 10, 11)

SQL: dict[str, str] = {}


def r(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6)"


def start_of(ctx: Ctx, i: int):
    return ctx.acc_start if i == 0 else minus_days(ctx.end, i)


def where(ctx: Ctx, i: int, extra: str | None = None) -> str:
    w = in_range(start_of(ctx, i), ctx.end)
    return w + (f" AND {extra}" if extra else "")


def n(cond: str | None = None) -> str:
    return "CAST(count(*) AS BIGINT)" if cond is None else f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def b(ctx: Ctx) -> str:
    return f"date_sub('day', time, {ts(ctx.end)})"


def q(s: str) -> str:
    return f'"{s}"'


# ---- A1 / A12 --------------------------------------------------------------------

def counts(ctx, keys, i, fmt, extra=None, more=()):
    cols = [f"{n(f'type = {k}')} AS {q(fmt.format(i=i, k=k))}" for k in TYPES] + list(more)
    return ctx.sql(f"SELECT {keys}, {', '.join(cols)} FROM actions WHERE {where(ctx, i, extra)} GROUP BY {keys}")


SQL["a1u_user_type_counts"] = counts(A, "user_id", 5, "{i}_user_action_{k}")
SQL["a1u_user_type_counts_lineitem"] = counts(B, "user_id", 0, "{i}_user_action_{k}")
SQL["a1i_sku_type_counts"] = counts(A, "sku_id", 5, "{i}_sku_action_{k}")
SQL["a1ui_user_sku_type_counts"] = counts(A, "user_id, sku_id", 5, "{i}_action_{k}")
SQL["a1uc_user_cate_type_counts"] = counts(
    A, "user_id, cate", 5, "{i}_uc_action_{k}",
    more=["CAST(NULLIF(count(*) FILTER (WHERE type = 4), 0) AS BIGINT) AS \"5_sku_buy_num_in_cate\""])
SQL["a1uic_user_sku_cate_type_counts"] = counts(A, "user_id, sku_id, cate", 5, "{i}_syn_action_{k}")
SQL["a1c8_user_category_type_counts"] = counts(A, "user_id", 5, "{i}_user_cate8_action_{k}", "cate = 8")


# ---- R1 ----------------------------------------------------------------------------

def conv(ctx, keys, i, fmt, ks=CONV, policy="zero", extra=None):
    cols = []
    for k in ks:
        num, den = f"count(*) FILTER (WHERE type = 4)", f"count(*) FILTER (WHERE type = {k})"
        if policy == "zero":
            e = f"CASE WHEN {den} = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / {den} END"
        else:
            e = (f"CASE WHEN {den} = 0 THEN (CASE WHEN {num} > 0 THEN CAST('inf' AS DOUBLE) END) "
                 f"ELSE CAST({num} AS DOUBLE) / {den} END")
        cols.append(f"{r(e)} AS {q(fmt.format(i=i, k=k))}")
    return ctx.sql(f"SELECT {keys}, {', '.join(cols)} FROM actions WHERE {where(ctx, i, extra)} GROUP BY {keys}")


SQL["r1u_user_conv_ratio"] = conv(A, "user_id", 5, "{i}_user_conv_ratio_{k}")
SQL["r1i_sku_conv_ratio"] = conv(A, "sku_id", 0, "{i}_sku_conv_ratio_{k}")
SQL["r1ui_user_sku_conv_ratio"] = conv(A, "user_id, sku_id", 0, "{i}_ui_conv_ratio_{k}")
SQL["r1uc_user_cate_conv_ratio"] = conv(A, "user_id, cate", 0, "{i}_uc_conv_ratio_{k}")
SQL["r1uic_user_sku_cate_conv_ratio"] = conv(A, "user_id, sku_id, cate", 0, "{i}_syn_conv_ratio_{k}")
SQL["r1u_user_conv_ratio_inf"] = conv(A, "user_id", 0, "user_action_{k}_ratio", (1, 2, 5, 6), "inf", "cate = 8")


# ---- A3 ------------------------------------------------------------------------------

def decay(ctx):
    cols = [f"{r(f'coalesce(sum(exp(-{b(ctx)})) FILTER (WHERE type = {k}), 0)')} AS action_{k}" for k in TYPES]
    keys = "user_id, sku_id, cate, brand"
    return ctx.sql(f"SELECT {keys}, {', '.join(cols)} FROM actions WHERE {where(ctx, 0)} GROUP BY {keys}")


SQL["a3_decayed_counts"] = decay(A)
SQL["a3_decayed_counts_lineitem"] = decay(B)


# ---- A4 -------------------------------------------------------------------------------

def days_pair(ctx, keys, i, any_name, buy_name, calendar=False, extra=None):
    d = "CAST(time AS DATE)" if calendar else b(ctx)
    return ctx.sql(
        f"SELECT {keys}, CAST(count(DISTINCT {d}) AS BIGINT) AS {q(any_name)}, "
        f"CAST(NULLIF(count(DISTINCT {d}) FILTER (WHERE type = 4), 0) AS BIGINT) AS {q(buy_name)} "
        f"FROM actions WHERE {where(ctx, i, extra)} GROUP BY {keys}")


SQL["a4a_user_active_days_cal"] = days_pair(A, "user_id", 0, "user_active_days", "user_buy_days", True, "cate = 8")
SQL["a4b_user_active_days"] = days_pair(A, "user_id", 5, "5_user_action_tm", "5_user_action_buy_tm")
SQL["a4c_user_sku_active_days"] = days_pair(A, "user_id, sku_id", 0, "0_ui_tm", "0_ui_buy_tm")
SQL["a4d_user_cate_active_days"] = days_pair(A, "user_id, cate", 5, "5_uc_tm", "5_uc_buy_tm")
SQL["a4a_user_active_days_cal_lineitem"] = days_pair(
    B, "user_id", 30, "30_day_user_active_days", "30_day_user_buy_days", True)


# ---- A5 / A6 ---------------------------------------------------------------------------

def hours_sql(ctx, hours=(4, 8, 16), extra=None, raw=False):
    import datetime as _dt
    cols = []
    for h in hours:
        st = ts(ctx.end - _dt.timedelta(hours=h))
        pres = f"count(*) FILTER (WHERE time >= {st}) > 0"
        for k in TYPES:
            cols.append(f"CASE WHEN {pres} THEN {n(f'time >= {st} AND type = {k}')} END AS {q(f'{h}_h_user_action_{k}')}")
        cols.append(f"CASE WHEN {pres} THEN CAST(count(DISTINCT hour(time)) FILTER (WHERE time >= {st}) AS BIGINT) END "
                    f"AS {q(f'{h}_h_user_active_hours')}")
    st = ts(ctx.end - _dt.timedelta(hours=max(hours)))
    body = (f"SELECT user_id, {', '.join(cols)} FROM actions WHERE time >= {st} AND time < {ts(ctx.end)} "
            + (f"AND {extra} " if extra else "") + "GROUP BY user_id")
    return body if raw else ctx.sql(body)


SQL["a5_active_hours"] = hours_sql(A)
SQL["a6_distinct_skus"] = A.sql(
    f"SELECT user_id, CAST(count(DISTINCT sku_id) AS BIGINT) AS \"1_day_user_product_nums\" "
    f"FROM actions WHERE {where(A, 1)} GROUP BY user_id")


# ---- A7 / A8 -----------------------------------------------------------------------------

SQL["a7a_recency_hours"] = A.sql(
    f"SELECT user_id, date_sub('hour', max(time), {ts(A.end)}) AS user_active_last, "
    f"date_sub('hour', max(time) FILTER (WHERE type = 4), {ts(A.end)}) AS user_buy_last "
    f"FROM actions WHERE {where(A, 0, 'cate = 8')} GROUP BY user_id")
SQL["a7b_user_recency_days"] = A.sql(
    f"SELECT user_id, min({b(A)}) AS user_last_buy FROM actions WHERE {where(A, 0, 'type = 4')} GROUP BY user_id")
SQL["a7b_user_last_cart"] = A.sql(
    f"SELECT user_id, min({b(A)}) AS user_last_cart FROM actions WHERE {where(A, 0, 'type = 3')} GROUP BY user_id")
SQL["a7c_user_sku_recency_days"] = A.sql(
    f"SELECT user_id, sku_id, min({b(A)}) FILTER (WHERE type = 3) AS ui_last_cart, "
    f"min({b(A)}) FILTER (WHERE type = 2) AS ui_last_del_cart, min({b(A)}) FILTER (WHERE type = 4) AS ui_last_buy "
    f"FROM actions WHERE {where(A, 0, 'cate = 8 AND type IN (2, 3, 4)')} GROUP BY user_id, sku_id")


def first_last(ctx, keys, first, interval):
    return ctx.sql(f"SELECT {keys}, max({b(ctx)}) AS {q(first)}, max({b(ctx)}) - min({b(ctx)}) AS {q(interval)} "
                   f"FROM actions WHERE {where(ctx, 0, 'type = 4')} GROUP BY {keys}")


SQL["a8a_first_last_interval_user"] = first_last(A, "user_id", "0_user_first_buy", "0_user_interval")
SQL["a8b_first_last_interval_uic"] = first_last(A, "user_id, sku_id, cate", "0_first_buy", "0_interval")


# ---- A9 / A10 / A11 ------------------------------------------------------------------------

SQL["a9_type_share"] = A.sql(
    "SELECT user_id, " + ", ".join(
        f"{r(f'CAST(count(*) FILTER (WHERE type = {k}) AS DOUBLE) / count(*)')} AS {q(f'5_user_cate8_ratio_{k}')}"
        for k in TYPES) + f" FROM actions WHERE {where(A, 5, 'cate = 8')} GROUP BY user_id")


def period(ctx, as_written=False):
    per = ", ".join(
        (f"count(*) AS n{k}" if as_written else f"count(*) FILTER (WHERE type = {k}) AS n{k}") for k in TYPES)
    cols = ", ".join(f"{r(f'CASE WHEN p.n{k} > 0 THEN {float(ctx.acc_days)} / p.n{k} ELSE -1.0 END')} "
                     f"AS {q(f'0_action_period_{k}')}" for k in TYPES)
    return ctx.sql(f"SELECT u.user_id, {cols} FROM users u LEFT JOIN "
                   f"(SELECT user_id, {per} FROM actions WHERE {where(ctx, 0)} GROUP BY user_id) p "
                   f"ON u.user_id = p.user_id")


SQL["a10_action_period"] = period(A)
SQL["a10_action_period_as_written"] = period(A, True)

MIDS = (14, 21, 28, 110, 210)
SQL["a11_model_id_counts"] = A.sql(
    "SELECT user_id, sku_id, " + ", ".join(f"{n(f'model_id = {v}')} AS ui_model_id_{v}" for v in MIDS)
    + f" FROM actions WHERE {where(A, 0, 'model_id IN (14, 21, 28, 110, 210)')} GROUP BY user_id, sku_id")
SQL["a11_model_id_counts_as_written"] = A.sql(
    "SELECT user_id, " + ", ".join(f"{n()} AS user_cate8_model_id_{v}" for v in MIDS)
    + f" FROM actions WHERE {where(A, 0, 'model_id IN (14, 21, 28, 110, 210) AND cate = 8')} GROUP BY user_id")


# ---- A14 / A15 --------------------------------------------------------------------------------

def label_where(ctx, extra=None):
    w = f"{in_range(ctx.end, ctx.label_end)} AND type = 4"
    return w + (f" AND {extra}" if extra else "")


SQL["a14_distinct_users"] = A.sql(f"SELECT DISTINCT user_id FROM actions WHERE {where(A, 30, 'cate = 8')}")
SQL["a15u_user_labels"] = A.sql(f"SELECT DISTINCT user_id, 1 AS label FROM actions WHERE {label_where(A, 'cate = 8')}")
SQL["a15ui_pair_labels"] = A.sql(
    f"SELECT DISTINCT user_id, sku_id, 1 AS label FROM actions WHERE {label_where(A, 'cate = 8')}")
SQL["a15t_truth_rows"] = A.sql(f"SELECT user_id FROM actions WHERE {label_where(A, 'cate = 8')}")


# ---- A2 -------------------------------------------------------------------------------------

STAT_FN = {"avg": "avg", "mean": "avg", "max": "max", "min": "min", "var": "var_samp", "std": "stddev_samp"}


def two_level(ctx, keys, sub, wins, fmt, stats, with_sum=False, extra=None, sub_expr=None, raw=False,
              days_of=None):
    """Nested windows: the widest window defines the rows; narrower ones are
    left-joined (NULL when the group is absent).  ``days_of`` maps a window
    label to its length in days when they differ (label 0 = 35 days)."""
    parts = []
    ks = list(TYPES) + (["sum"] if with_sum else [])
    for i in wins:
        sexpr = sub_expr or sub
        l1_cols = ", ".join(f"count(*) FILTER (WHERE type = {k}) AS t{k}" for k in TYPES)
        sum_col = (", " + " + ".join(f"count(*) FILTER (WHERE type = {k})" for k in TYPES) + " AS tsum") \
            if with_sum else ""
        wh = where(ctx, i, extra) if not days_of or i not in days_of else \
            in_range(minus_days(ctx.end, days_of[i]), ctx.end) + (f" AND {extra}" if extra else "")
        l1 = (f"SELECT {keys}, {sexpr} AS sub, {l1_cols}{sum_col} FROM actions WHERE {wh} "
              f"GROUP BY {keys}, {sexpr}")
        cols = ", ".join(f"{r(f'{STAT_FN[st]}(CAST(t{k} AS DOUBLE))')} AS {q(fmt.format(i=i, k=k, stat=st))}"
                         for k in ks for st in stats)
        parts.append(f"(SELECT {keys}, {cols} FROM ({l1}) l1 GROUP BY {keys})")
    widest = max(wins, key=lambda i: 10 ** 6 if i == 0 else i)
    order = [widest] + [i for i in wins if i != widest]
    kl = [k.strip() for k in keys.split(",")]
    sql = f"SELECT * FROM {parts[wins.index(order[0])]} w{order[0]}"
    for i in order[1:]:
        on = " AND ".join(f"w{order[0]}.{k} = w{i}.{k}" for k in kl)
        sql = f"{sql} LEFT JOIN {parts[wins.index(i)]} w{i} ON {on}"
    # keep only one copy of the keys
    keep = ", ".join(f"w{order[0]}.{k}" for k in kl)
    other = ", ".join(f"w{i}.* EXCLUDE ({keys})" for i in order[1:])
    sel = f"{keep}, w{order[0]}.* EXCLUDE ({keys})" + (f", {other}" if other else "")
    body = sql.replace("SELECT *", f"SELECT {sel}", 1)
    return body if raw else ctx.sql(body)


SQL["a2u_user_sku_stats"] = two_level(A, "user_id", "sku_id", [5, 30], "{i}_day_user_action_{k}_{stat}",
                                      ("avg", "max", "min", "var"), True, "cate = 8")
SQL["a2c_user_category_sku_stats"] = two_level(A, "user_id", "sku_id", [0, 5, 30], "{i}_action_{stat}_{k}",
                                               ("mean", "max", "min", "var", "std"), False, "cate = 8")
SQL["a2p_sku_daily_stats"] = two_level(A, "sku_id", "b", [0, 5, 30], "{i}_pro_action_{stat}_{k}",
                                       ("mean", "max", "min", "var", "std"), False, "cate = 8", b(A))
SQL["a2p_sku_daily_stats_lineitem"] = two_level(B, "sku_id", "b", [0, 5, 30], "{i}_pro_action_{stat}_{k}",
                                                ("mean", "max", "min", "var", "std"), False, "cate = 8", b(B))


# ---- W1 ---------------------------------------------------------------------------------------

def share(ctx, child, parent, rank, ratio4):
    g = (f"SELECT {child}, " + ", ".join(f"count(*) FILTER (WHERE type = {k}) AS g{k}" for k in TYPES)
         + f" FROM actions WHERE {where(ctx, 0)} GROUP BY {child}")
    p = f"SELECT {parent}, " + ", ".join(f"sum(g{k}) AS p{k}" for k in TYPES) + f" FROM g GROUP BY {parent}"
    ratios = [f"CAST(g{k} AS DOUBLE) / NULLIF(p{k}, 0)" for k in TYPES]
    return ctx.sql(f"SELECT {child}, {r(' + '.join(ratios))} AS {q(rank)}, {r(ratios[3])} AS {q(ratio4)} "
                   f"FROM g JOIN p USING ({parent})", [f"g AS ({g})", f"p AS ({p})"])


SQL["w1a_sku_share_in_user"] = share(A, "user_id, sku_id", "user_id", "0_sku_user_rank", "0_sku_user_ratio_4")
SQL["w1b_sku_share_in_user_cate"] = share(A, "user_id, cate, sku_id", "user_id, cate", "sku_in_uc_rank",
                                          "sku_in_uc_ratio_4")
SQL["w1c_cate_share_in_user"] = share(A, "user_id, cate", "user_id", "cate_user_rank", "cate_user_ratio_4")
SQL["w1d_sku_share_in_cate"] = share(A, "sku_id, cate", "cate", "sku_cate_rank", "sku_cate_ratio_4")
SQL["w1e_brand_share_in_cate"] = share(A, "brand, cate", "cate", "brand_cate_rank", "brand_cate_ratio_4")
SQL["w1d_sku_share_in_cate_lineitem"] = share(B, "sku_id, cate", "cate", "sku_cate_rank", "sku_cate_ratio_4")


# ---- A13 ---------------------------------------------------------------------------------------

SQL["a13a_cate_pivot_counts"] = A.sql(
    "SELECT user_id, " + ", ".join(f"{n(f'cate = {c} AND type = {k}')} AS {q(f'5_cate_{c}_action_{k}')}"
                                   for c in CATES for k in TYPES)
    + f" FROM actions WHERE {where(A, 5)} GROUP BY user_id")


def _a13b():
    cols = []
    for c in CATES:
        num = f"count(*) FILTER (WHERE cate = {c} AND type = 4)"
        for k in CONV:
            den = f"count(*) FILTER (WHERE cate = {c} AND type = {k})"
            e = (f"CASE WHEN count(*) FILTER (WHERE cate = {c}) > 0 THEN "
                 f"(CASE WHEN {den} = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / {den} END) END")
            cols.append(f"{r(e)} AS {q(f'0_cate_{c}_conv_ratio_{k}')}")
    return A.sql(f"SELECT user_id, {', '.join(cols)} FROM actions WHERE {where(A, 0)} GROUP BY user_id")


SQL["a13b_cate_pivot_conv"] = _a13b()
SQL["a13c_cate_pivot_days"] = A.sql(
    "SELECT user_id, " + ", ".join(
        f"CAST(count(DISTINCT {b(A)}) FILTER (WHERE cate = {c}) AS BIGINT) AS {q(f'10_cate_{c}_action_days')}, "
        f"CAST(count(DISTINCT {b(A)}) FILTER (WHERE cate = {c} AND type = 4) AS BIGINT) AS {q(f'10_cate_{c}_buy_days')}"
        for c in CATES) + f" FROM actions WHERE {where(A, 10)} GROUP BY user_id")
SQL["a13d_cate_pivot_recency"] = A.sql(
    "SELECT user_id, " + ", ".join(
        f"coalesce(min({b(A)}) FILTER (WHERE cate = {c} AND type = 4), 0) AS {q(f'cate_{c}_last_buy')}"
        for c in CATES) + f" FROM actions WHERE {where(A, 0)} GROUP BY user_id")
SQL["a13e_cate_purchase_basket"] = A.sql(
    "SELECT u.user_id, " + ", ".join(f"p.cate_{c}" for c in CATES) + " FROM users u LEFT JOIN (SELECT user_id, "
    + ", ".join(f"{n(f'cate = {c}')} AS cate_{c}" for c in CATES)
    + f" FROM actions WHERE {where(A, 0, 'type = 4')} GROUP BY user_id) p ON u.user_id = p.user_id")


def _a13f():
    g = ("SELECT user_id, cate, " + ", ".join(f"count(*) FILTER (WHERE type = {k}) AS g{k}" for k in TYPES)
         + f" FROM actions WHERE {where(A, 0)} GROUP BY user_id, cate")
    p = "SELECT user_id, " + ", ".join(f"sum(g{k}) AS p{k}" for k in TYPES) + " FROM g GROUP BY user_id"
    ratios = [f"CAST(g{k} AS DOUBLE) / NULLIF(p{k}, 0)" for k in TYPES]
    s = f"SELECT user_id, cate, {' + '.join(ratios)} AS rk, {ratios[3]} AS r4 FROM g JOIN p USING (user_id)"
    cols = ", ".join(f"{r(f'max(CASE WHEN cate = {c} THEN rk END)')} AS cate_{c}_rank, "
                     f"{r(f'max(CASE WHEN cate = {c} THEN r4 END)')} AS cate_{c}_ratio_4" for c in CATES)
    return A.sql(f"SELECT user_id, {cols} FROM s GROUP BY user_id", [f"g AS ({g})", f"p AS ({p})", f"s AS ({s})"])


SQL["a13f_cate_rank_pivot"] = _a13f()


# ---- D5 / D6 / D7 / D1 ----------------------------------------------------------------------------

import datetime as _dt  # noqa: E402


def _end_ctx(ctx: Ctx, end) -> Ctx:
    c = Ctx(ctx.adapter)
    c.end = end
    return c


def d5_parts(ctx, cate_cond="cate = 8"):
    e = ts(ctx.end)
    ratios = []
    for k in (1, 2, 5, 6):
        num, den = "count(*) FILTER (WHERE type = 4)", f"count(*) FILTER (WHERE type = {k})"
        ex = (f"CASE WHEN {den} = 0 THEN (CASE WHEN {num} > 0 THEN CAST('inf' AS DOUBLE) END) "
              f"ELSE CAST({num} AS DOUBLE) / {den} END")
        ratios.append(f"{r(ex)} AS user_action_{k}_ratio")
    acc = (f"SELECT user_id, " + ", ".join(f"{n(f'type = {k}')} AS user_action_{k}" for k in TYPES) + ", "
           + ", ".join(ratios)
           + f", date_sub('hour', max(time), {e}) AS user_active_last, "
             f"date_sub('hour', max(time) FILTER (WHERE type = 4), {e}) AS user_buy_last, "
             f"CAST(count(DISTINCT CAST(time AS DATE)) AS BIGINT) AS user_active_days, "
             f"CAST(NULLIF(count(DISTINCT CAST(time AS DATE)) FILTER (WHERE type = 4), 0) AS BIGINT) AS user_buy_days "
             f"FROM actions WHERE {where(ctx, 0, cate_cond)} GROUP BY user_id")
    st = two_level(ctx, "user_id", "sku_id", [0], "user_action_{k}_{stat}", ("avg", "max", "min", "var"), True,
                   cate_cond, raw=True)
    return acc, st


def d6_part(ctx):
    e = ts(ctx.end)
    return (f"SELECT user_id, date_sub('hour', max(time), {e}) AS user_all_cate_active_last, "
            f"CAST(count(DISTINCT CAST(time AS DATE)) AS BIGINT) AS user_all_cate_active_days, "
            f"CAST(NULLIF(count(DISTINCT CAST(time AS DATE)) FILTER (WHERE type = 4), 0) AS BIGINT) "
            f"AS user_all_cate_buy_days FROM actions WHERE {where(ctx, 0)} GROUP BY user_id")


def d7_window(ctx, i):
    cols = [f"{n(f'type = {k}')} AS {q(f'{i}_day_user_action_{k}')}" for k in TYPES]
    if i != 1:
        cols += [f"CAST(count(DISTINCT CAST(time AS DATE)) AS BIGINT) AS {q(f'{i}_day_user_active_days')}",
                 f"CAST(NULLIF(count(DISTINCT CAST(time AS DATE)) FILTER (WHERE type = 4), 0) AS BIGINT) "
                 f"AS {q(f'{i}_day_user_buy_days')}"]
    return f"SELECT user_id, {', '.join(cols)} FROM actions WHERE {where(ctx, i, 'cate = 8')} GROUP BY user_id"


UM_WINDOWS = (1, 2, 3, 5, 7, 10, 15, 21, 30)
AGE_CASE = ("CASE age WHEN '-1' THEN 0 WHEN '15岁以下' THEN 1 WHEN '16-25岁' THEN 2 WHEN '26-35岁' THEN 3 "
            "WHEN '36-45岁' THEN 4 WHEN '46-55岁' THEN 5 WHEN '56岁以上' THEN 6 ELSE -1 END")
AGE_CASE_1_7 = ("CASE age WHEN '-1' THEN 1 WHEN '15岁以下' THEN 2 WHEN '16-25岁' THEN 3 WHEN '26-35岁' THEN 4 "
                "WHEN '36-45岁' THEN 5 WHEN '46-55岁' THEN 6 WHEN '56岁以上' THEN 7 ELSE 0 END")


def profile_sql(with_sex=True, codes=range(7), case=AGE_CASE):
    cols = [f"CASE WHEN code = {v} THEN 1 ELSE 0 END AS age_{v}" for v in codes]
    if with_sex:
        cols += [f"CASE WHEN sex = {v}.0 THEN 1 ELSE 0 END AS sex_{v}" for v in range(3)]
    cols += [f"CASE WHEN user_lv_cd = {v} THEN 1 ELSE 0 END AS user_lv_cd_{v}" for v in range(1, 6)]
    return f"SELECT user_id, {', '.join(cols)} FROM (SELECT *, {case} AS code FROM users) u"


def joined(ctx, base, parts, tail=""):
    ctes = [f"base AS ({base})"] + [f"p{j} AS ({p})" for j, p in enumerate(parts)]
    sql = "SELECT * FROM base" + "".join(f" LEFT JOIN p{j} USING (user_id)" for j in range(len(parts)))
    return ctx.sql(sql + tail, ctes)


def d7_sql(ctx):
    base = f"SELECT DISTINCT user_id FROM actions WHERE {where(ctx, 30, 'cate = 8')}"
    return joined(ctx, base, [d7_window(ctx, i) for i in UM_WINDOWS])


def d1_sql(ctx, end=None, with_label=True):
    c = _end_ctx(ctx, end) if end else ctx
    base = f"SELECT DISTINCT user_id FROM actions WHERE {where(c, 30, 'cate = 8')}"
    one_day = (f"SELECT user_id, CAST(count(DISTINCT hour(time)) AS BIGINT) AS \"1_day_user_active_hours\", "
               f"CAST(count(DISTINCT sku_id) AS BIGINT) AS \"1_day_user_product_nums\" "
               f"FROM actions WHERE {where(c, 1, 'cate = 8')} GROUP BY user_id")
    acc, acc_stats = d5_parts(c)
    parts = [d7_window(c, i) for i in UM_WINDOWS] + [
        hours_sql(c, (4, 8, 16), "cate = 8", raw=True), one_day,
        two_level(c, "user_id", "sku_id", [5, 30], "{i}_day_user_action_{k}_{stat}", ("avg", "max", "min", "var"),
                  True, "cate = 8", raw=True),
        profile_sql(with_sex=False), acc, acc_stats, d6_part(c)]
    if with_label:
        parts.append(f"SELECT DISTINCT user_id, 1 AS label FROM actions WHERE "
                     f"{in_range(c.end, c.end + _dt.timedelta(days=5))} AND type = 4 AND cate = 8")
        sql = joined(c, base, parts)
        return sql.replace("SELECT * FROM base", "SELECT * REPLACE (coalesce(label, 0) AS label) FROM base", 1)
    return joined(c, base, parts)


_acc5, _acc5s = d5_parts(A)
SQL["d5_user_accumulate"] = A.sql(f"SELECT * FROM ({_acc5}) a LEFT JOIN ({_acc5s}) s USING (user_id)")
SQL["d6_user_accumulate_all"] = A.sql(d6_part(A))
SQL["d7_user_window"] = d7_sql(A)
SQL["d1_user_dataset"] = d1_sql(A)
SQL["d1_user_dataset_test"] = d1_sql(A, A.score_end, with_label=False)
SQL["d1_user_dataset_lineitem"] = d1_sql(B)
B_ALL = Ctx("B")
B_ALL.acc_start = _dt.datetime(1995, 1, 1)
SQL["d1_user_dataset_lineitem_all"] = d1_sql(B_ALL)


# ---- profile / product / comments ----------------------------------------------------------------

SQL["p2_user_one_hot"] = A.sql(profile_sql(True))
SQL["p2_product_one_hot"] = A.sql(
    "SELECT sku_id, cate, brand, " + ", ".join(
        f"CASE WHEN {a} = {v} THEN 1 ELSE 0 END AS {q(f'{a}_{v}')}" for a in ("a1", "a2", "a3")
        for v in (-1, 0, 1, 2, 3)) + " FROM products")
SQL["p3_recode_age"] = A.sql(
    f"SELECT user_id, {AGE_CASE_1_7} AS age FROM users")
_nonnull = "age IS NOT NULL AND sex IS NOT NULL AND user_lv_cd IS NOT NULL AND user_reg_tm IS NOT NULL"
SQL["t6_days_registered"] = A.sql(
    f"SELECT user_id, CAST(CASE WHEN d < 0 THEN -1 ELSE d END AS BIGINT) AS user_reg_tm FROM "
    f"(SELECT user_id, date_diff('day', CAST(user_reg_tm AS DATE), {dt(A.end)}) AS d FROM users WHERE {_nonnull}) x")
SQL["a8c_reg_to_first_buy"] = A.sql(
    f"SELECT u.user_id, CAST(floor((coalesce(u.reg, -1) - coalesce(f.first_buy, -1) + 1) / 5.0) AS BIGINT) "
    f"AS inter_reg_first_buy FROM (SELECT user_id, date_diff('day', CAST(user_reg_tm AS DATE), {dt(A.end)}) AS reg "
    f"FROM users WHERE {_nonnull}) u LEFT JOIN (SELECT user_id, max({b(A)}) AS first_buy FROM actions "
    f"WHERE {where(A, 0, 'type = 4')} GROUP BY user_id) f ON u.user_id = f.user_id")
_snap = f"SELECT coalesce(max(dt) FILTER (WHERE dt < {dt(A.end)}), min(dt)) AS snap FROM (SELECT DISTINCT dt FROM comments) d"
SQL["t8_asof_snapshot_date"] = A.sql(f"SELECT CAST(snap AS VARCHAR) AS snap FROM ({_snap}) s")
SQL["a16_comment_features"] = A.sql(
    "SELECT sku_id, has_bad_comment, round(bad_comment_rate, 6) AS bad_comment_rate, "
    + ", ".join(f"CASE WHEN comment_num = {v} THEN 1 ELSE 0 END AS comment_num_{v}" for v in (1, 2, 3, 4))
    + f" FROM comments WHERE dt = (SELECT snap FROM ({_snap}) s WHERE snap < {dt(A.end)})")
SQL["j6_product_join"] = A.sql(
    "SELECT b.user_id, b.sku_id, b.cate, b.brand, " + ", ".join(
        f"CASE WHEN {a} = {v} THEN 1 ELSE 0 END AS {q(f'{a}_{v}')}" for a in ("a1", "a2", "a3") for v in (-1, 0, 1, 2, 3))
    .replace("CASE WHEN", "CASE WHEN p.sku_id IS NULL THEN NULL WHEN")
    + f" FROM (SELECT DISTINCT user_id, sku_id, cate, brand FROM actions WHERE {where(A, 0)}) b "
      "LEFT JOIN products p ON b.sku_id = p.sku_id AND b.cate = p.cate AND b.brand = p.brand")


# ---- scalar time functions ------------------------------------------------------------------------

SQL["t1_t7_time_bins"] = A.sql(
    f"SELECT user_id, sku_id, type, CAST(CAST(time AS DATE) AS VARCHAR) AS day, hour(time) AS hour, "
    f"date_diff('day', CAST(time AS DATE), {dt(A.end)}) AS c, {b(A)} AS b, date_sub('hour', time, {ts(A.end)}) AS h, "
    f"round(exp(-{b(A)}), 6) AS decay, CAST(floor(({b(A)} - 20 + 1) / 5.0) AS BIGINT) AS bucket, "
    f"CAST(brand AS BIGINT) AS brand FROM actions WHERE {where(A, 0)}")
SQL["t3_elapsed_days_lineitem"] = B.sql(
    f"SELECT date_diff('day', CAST(time AS DATE), {dt(B.end)}) AS c, {b(B)} AS b, count(*) AS n "
    f"FROM actions WHERE {where(B, 0)} GROUP BY 1, 2")


# ---- filters --------------------------------------------------------------------------------------

TSF = "strftime(time, '%Y-%m-%d %H:%M:%S.%f')"
SQL["t8_asof_rows"] = A.sql(
    f"SELECT a.user_id, a.sku_id, {TSF.replace('(time', '(a.time')} AS time, a.type, CAST(c.dt AS VARCHAR) AS dt, c.comment_num, "
    "c.has_bad_comment, round(c.bad_comment_rate, 6) AS bad_comment_rate "
    "FROM actions a LEFT JOIN comments c ON c.sku_id = a.sku_id AND c.dt = (SELECT max(x.dt) FROM comments x "
    "WHERE x.sku_id = a.sku_id AND x.dt < a.time)")
ROWS = f"SELECT user_id, sku_id, type, cate, {TSF} AS time FROM actions"
SQL["f1_time_range"] = A.sql(f"{ROWS} WHERE {where(A, 5)}")
SQL["f2_f3_category_type"] = A.sql(f"{ROWS} WHERE cate = 8 AND type = 4")
SQL["f4_exclude_period"] = A.sql(
    f"{ROWS} WHERE NOT (CAST(time AS DATE) BETWEEN {dt(A.excl_lo)} AND {dt(A.excl_hi)})")
SQL["f4_exclude_period_as_written"] = A.sql(f"{ROWS} WHERE time < {ts(A.excl_lo)}")
SQL["f5_model_in"] = A.sql("SELECT model_id, count(*) AS n FROM actions WHERE model_id IN (14, 21, 28, 110, 210) "
                           "GROUP BY model_id")
SQL["f6_focus_users"] = A.sql(f"SELECT DISTINCT user_id FROM actions WHERE {where(A, 0, 'cate = 8 AND type IN (2, 4, 5)')}")
SQL["f7_drop_null_rows"] = A.sql(f"SELECT * FROM users WHERE user_id IS NOT NULL AND {_nonnull}")
SQL["f8_purchases_only"] = B.sql(f"{ROWS} WHERE type = 4")
SQL["s5_category_slice"] = A.sql(f"SELECT user_id, sku_id, type, brand, model_id, {TSF} AS time FROM actions "
                                 f"WHERE cate = 8")


# ---- joins / top-k / sets / metrics -----------------------------------------------------------------

USCORE = (f"SELECT user_id, CAST(count(*) FILTER (WHERE type = 4) AS DOUBLE) AS prob FROM actions "
          f"WHERE {where(A, 0)} GROUP BY user_id")
PSCORE = (f"SELECT user_id, sku_id, CAST(count(*) FILTER (WHERE type = 4) * 10 + count(*) FILTER (WHERE type = 1) "
          f"AS DOUBLE) AS label FROM actions WHERE {where(A, 0)} GROUP BY user_id, sku_id")
TRUTH_U = f"SELECT DISTINCT user_id FROM actions WHERE {label_where(A, 'cate = 8')}"
TRUTH_P = f"SELECT DISTINCT user_id, sku_id FROM actions WHERE {label_where(A, 'cate = 8')}"

SQL["l1_topk_by_score"] = A.sql(f"SELECT user_id, CAST(-1 AS BIGINT) AS sku_id FROM ({USCORE}) s "
                                f"ORDER BY prob DESC, user_id LIMIT 1000")


def _sweep():
    top = f"SELECT user_id, row_number() OVER (ORDER BY prob DESC, user_id) AS rk FROM ({USCORE}) s"
    rows = []
    for c in (900, 950, 1000):
        rows.append(
            f"SELECT {c} AS cutoff, CAST(count(*) FILTER (WHERE t.user_id IS NOT NULL AND rk <= {c}) AS BIGINT) AS hits, "
            f"CAST(count(*) FILTER (WHERE rk <= {c}) AS BIGINT) AS predicted, (SELECT count(*) FROM truth) AS actual "
            f"FROM top LEFT JOIN truth t USING (user_id)")
    body = " UNION ALL ".join(rows)
    f = ("CASE WHEN hits > 0 THEN 6.0 * (hits / predicted) * (hits / actual) / "
         "(5.0 * (hits / actual) + hits / predicted) ELSE 0.0 END")
    return A.sql(f"SELECT cutoff, hits, predicted, actual, {r(f.replace('hits /', 'CAST(hits AS DOUBLE) /'))} AS f11 "
                 f"FROM ({body}) x", [f"top AS ({top} QUALIFY rk <= 1000)", f"truth AS ({TRUTH_U})"])


SQL["l2_e3_cutoff_sweep"] = _sweep()


def _f11_sql(pred, truth, prefix=""):
    m = (f"SELECT CAST(count(*) FILTER (WHERE p = 1 AND t = 1) AS BIGINT) AS hits, "
         f"CAST(count(*) FILTER (WHERE p = 1) AS BIGINT) AS predicted, CAST(count(*) FILTER (WHERE t = 1) AS BIGINT) AS actual "
         f"FROM (SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 0 ELSE 1 END AS p, "
         f"CASE WHEN b.user_id IS NULL THEN 0 ELSE 1 END AS t FROM (SELECT DISTINCT user_id FROM ({pred}) x) a "
         f"FULL OUTER JOIN ({truth}) b ON a.user_id = b.user_id) z")
    P, R = "(CAST(hits AS DOUBLE) / predicted)", "(CAST(hits AS DOUBLE) / actual)"
    return (f"SELECT hits, predicted, actual, {r(f'coalesce({P}, 0.0)')} AS precision, "
            f"{r(f'coalesce({R}, 0.0)')} AS recall, "
            f"{r(f'CASE WHEN hits > 0 THEN 6.0 * {P} * {R} / (5.0 * {R} + {P}) ELSE 0.0 END')} AS f11 FROM ({m}) mm")


_PRED_U = f"SELECT user_id FROM ({USCORE}) s ORDER BY prob DESC, user_id LIMIT 1000"
SQL["e1_f11"] = A.sql(_f11_sql(_PRED_U, TRUTH_U))
_PRED_P = f"SELECT user_id, sku_id FROM ({PSCORE}) s ORDER BY label DESC, user_id, sku_id LIMIT 1000"
_pairs = (f"SELECT CAST(count(*) FILTER (WHERE t.user_id IS NOT NULL) AS BIGINT) AS pair_hits, "
          f"CAST(count(*) AS BIGINT) AS pp, (SELECT count(*) FROM ({TRUTH_P}) tt) AS pa "
          f"FROM ({_PRED_P}) p LEFT JOIN ({TRUTH_P}) t ON p.user_id = t.user_id AND p.sku_id = t.sku_id")
_P2, _R2 = "(CAST(pair_hits AS DOUBLE) / pp)", "(CAST(pair_hits AS DOUBLE) / pa)"
SQL["e2_f12_score"] = A.sql(
    f"SELECT u.*, q.pair_hits, q.f12, round(0.4 * u.f11 + 0.6 * q.f12, 6) AS score FROM ({_f11_sql(_PRED_P, TRUTH_U)}) u, "
    f"(SELECT pair_hits, {r(f'CASE WHEN pair_hits > 0 THEN 5.0 * {_P2} * {_R2} / (2.0 * {_R2} + 3.0 * {_P2}) ELSE 0.0 END')}"
    f" AS f12 FROM ({_pairs}) x) q")

def _auc_sql(kind, scores, score, truth, on):
    ranked = (f"SELECT {score} AS s, CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END AS y, "
              f"rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS mid "
              f"FROM ({scores}) p LEFT JOIN ({truth}) t ON {on}")
    return (f"SELECT '{kind}' AS kind, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, "
            f"{r('(sum(y * mid) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))')} AS auc FROM ({ranked}) x")


SQL["e4_auc"] = A.sql(_auc_sql("user", USCORE, "prob", TRUTH_U, "p.user_id = t.user_id") + " UNION ALL "
                      + _auc_sql("pair", PSCORE, "label", TRUTH_P, "p.user_id = t.user_id AND p.sku_id = t.sku_id"))


def _pair_sweep():
    top = f"SELECT *, row_number() OVER (ORDER BY label DESC, user_id, sku_id) AS rk FROM ({PSCORE}) s QUALIFY rk <= 1000"
    rows = [f"SELECT {c} AS cutoff, "
            f"(SELECT count(DISTINCT user_id) FROM top WHERE rk <= {c} AND user_id IN (SELECT user_id FROM truth)) AS user_hits, "
            f"(SELECT count(DISTINCT user_id) FROM top WHERE rk <= {c}) AS users_predicted, "
            f"(SELECT count(DISTINCT user_id) FROM truth) AS users_actual, "
            f"(SELECT count(*) FROM top JOIN truth USING (user_id, sku_id) WHERE rk <= {c}) AS pair_hits, "
            f"(SELECT count(*) FROM top WHERE rk <= {c}) AS pairs_predicted, (SELECT count(*) FROM truth) AS pairs_actual"
            for c in (600, 800, 900, 1000)]
    up, ur = "(CAST(user_hits AS DOUBLE) / users_predicted)", "(CAST(user_hits AS DOUBLE) / users_actual)"
    pp, pr = "(CAST(pair_hits AS DOUBLE) / pairs_predicted)", "(CAST(pair_hits AS DOUBLE) / pairs_actual)"
    f11 = f"CASE WHEN user_hits > 0 THEN 6.0 * {up} * {ur} / (5.0 * {ur} + {up}) ELSE 0.0 END"
    f12 = f"CASE WHEN pair_hits > 0 THEN 5.0 * {pp} * {pr} / (2.0 * {pr} + 3.0 * {pp}) ELSE 0.0 END"
    return A.sql(f"SELECT *, {r(f11)} AS f11, {r(f12)} AS f12, {r(f'0.4 * ({f11}) + 0.6 * ({f12})')} AS score "
                 f"FROM ({' UNION ALL '.join(rows)}) x", [f"top AS ({top})", f"truth AS ({TRUTH_P})"])


SQL["e3_pair_cutoff_sweep"] = _pair_sweep()

_DB = (f"SELECT user_id, sku_id, cate, brand, " + ", ".join(
    f"{r(f'coalesce(sum(exp(-{b(A)})) FILTER (WHERE type = {k}), 0)')} AS action_{k}" for k in TYPES)
    + f" FROM actions WHERE {where(A, 0)} GROUP BY user_id, sku_id, cate, brand")
SQL["j3_semi_restrict"] = A.sql(f"SELECT * FROM ({_DB}) d WHERE user_id IN ({TRUTH_U})")
SQL["j3_semi_restrict_topk"] = A.sql(
    f"SELECT * FROM ({_DB}) d WHERE user_id IN (SELECT user_id FROM ({USCORE}) s ORDER BY prob DESC, user_id LIMIT 1000)")
_CART = f"SELECT user_id, time FROM actions WHERE {where(A, 0, 'type = 2')}"
_UNCART = f"SELECT user_id, time FROM actions WHERE {where(A, 0, 'type = 3')}"
SQL["j4_cart_uncart_latest"] = A.sql(
    "SELECT c.user_id, strftime(c.t, '%Y-%m-%d %H:%M:%S.%f') AS cart_time, "
    "strftime(u.t, '%Y-%m-%d %H:%M:%S.%f') AS uncart_time, CASE WHEN u.t >= c.t THEN 1 ELSE 0 END AS buy_possible "
    f"FROM (SELECT user_id, max(time) AS t FROM ({_CART}) x GROUP BY user_id) c "
    f"LEFT JOIN (SELECT user_id, max(time) AS t FROM ({_UNCART}) y GROUP BY user_id) u ON c.user_id = u.user_id")
SQL["j4_cart_uncart_as_written"] = A.sql(
    f"SELECT c.user_id, count(*) AS rows FROM ({_CART}) c LEFT JOIN ({_UNCART}) u ON c.user_id = u.user_id "
    f"GROUP BY c.user_id")
SQL["j5_topk_overlap"] = A.sql(
    f"SELECT a.user_id, a.prob, b.sku_id, b.label FROM (SELECT * FROM ({USCORE}) s ORDER BY prob DESC, user_id LIMIT 1000) a "
    f"JOIN (SELECT * FROM ({PSCORE}) p ORDER BY label DESC, user_id, sku_id LIMIT 1000) b ON a.user_id = b.user_id")
_PVIEWS = (f"SELECT user_id, sku_id, CAST(count(*) FILTER (WHERE type = 1) AS DOUBLE) AS views FROM actions "
           f"WHERE {where(A, 0)} GROUP BY user_id, sku_id")
SQL["j5_topk_overlap_pairs"] = A.sql(
    f"SELECT user_id, sku_id, a.label, b.views FROM (SELECT * FROM ({PSCORE}) s ORDER BY label DESC, user_id, sku_id LIMIT 1000) a "
    f"JOIN (SELECT * FROM ({_PVIEWS}) p ORDER BY views DESC, user_id, sku_id LIMIT 1000) b USING (user_id, sku_id)")
_VIEWS = (f"SELECT user_id, CAST(count(*) FILTER (WHERE type = 1) AS DOUBLE) AS prob FROM actions "
          f"WHERE {where(A, 0)} GROUP BY user_id")
SQL["u2_intersect"] = A.sql(
    f"SELECT user_id FROM (SELECT user_id FROM ({USCORE}) s ORDER BY prob DESC, user_id LIMIT 1000) a "
    f"INTERSECT SELECT user_id FROM (SELECT user_id FROM ({_VIEWS}) v ORDER BY prob DESC, user_id LIMIT 1000) b")
_PAIRS = f"SELECT DISTINCT user_id, sku_id FROM actions WHERE {where(A, 0)}"
SQL["u1_union_all"] = A.sql(
    f"SELECT user_id, sku_id, 1 AS label FROM ({_PAIRS}) p WHERE (user_id, sku_id) IN ({TRUTH_P}) UNION ALL "
    f"SELECT user_id, sku_id, 0 AS label FROM ({_PAIRS}) p WHERE (user_id, sku_id) NOT IN ({TRUTH_P})")
SQL["w2_dedupe_keep_last"] = A.sql(
    f"SELECT user_id, sku_id, {TSF} AS time, type, model_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sku_id "
    f"ORDER BY time DESC, type DESC, model_id DESC) AS rn FROM actions WHERE cate = 8) x WHERE rn = 1")
SQL["w2_dedupe_keep_first"] = A.sql(
    f"SELECT user_id, sku_id, {TSF} AS time, type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sku_id "
    f"ORDER BY time, type) AS rn FROM actions WHERE cate = 8) x WHERE rn = 1")
_SV = (f"SELECT sku_id, cate, count(*) FILTER (WHERE type = 1) AS views FROM actions WHERE {where(A, 0)} "
       f"GROUP BY sku_id, cate")
SQL["w3_relative_order"] = A.sql(
    "SELECT s.sku_id, s.cate, s.views, (SELECT count(*) FROM sv s2 WHERE s2.cate = s.cate AND s2.views >= s.views) - 1 "
    "AS view_order FROM sv s", [f"sv AS ({_SV})"])
SQL["w3_relative_order_global"] = A.sql(
    "SELECT s.sku_id, s.views, (SELECT count(*) FROM sv s2 WHERE s2.views >= s.views) - 1 AS view_order FROM sv s",
    [f"sv AS (SELECT sku_id, {n('type = 1')} AS views FROM actions WHERE {where(A, 0)} GROUP BY sku_id)"])
SQL["w4_top1_per_user"] = A.sql(
    f"SELECT user_id, sku_id, label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY label DESC, sku_id) "
    f"AS rn FROM ({PSCORE}) p) x WHERE rn = 1")
_WS = (f"SELECT user_id, sku_id, 0.3 * p4 + 0.07 * p1 + 0.07 * p2 AS label FROM (SELECT user_id, sku_id, "
       + ", ".join(f"CAST(count(*) FILTER (WHERE type = {k}) AS DOUBLE) AS p{k}" for k in (1, 2, 4))
       + f" FROM actions WHERE {where(A, 0)} GROUP BY user_id, sku_id) x")
SQL["m8w_weighted_score"] = A.sql(
    f"SELECT user_id, sku_id, {r('label')} AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    f"ORDER BY label DESC, sku_id) AS rn FROM ({_WS}) p) x WHERE rn = 1")


# ---- sampling ----------------------------------------------------------------------------------------

_LAB = (f"SELECT p.user_id, p.sku_id, CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END AS label FROM ({_PAIRS}) p "
        f"LEFT JOIN ({TRUTH_P}) t ON p.user_id = t.user_id AND p.sku_id = t.sku_id")


def _h(seed):
    return f"md5(concat_ws(':', '{seed}', CAST(user_id AS VARCHAR), CAST(sku_id AS VARCHAR)))"


SQL["m1_downsample_negatives"] = A.sql(
    f"SELECT user_id, sku_id, label FROM lab WHERE label = 1 UNION ALL "
    f"SELECT user_id, sku_id, label FROM (SELECT *, row_number() OVER (ORDER BY {_h(7)}, user_id, sku_id) AS rn "
    f"FROM lab WHERE label = 0) x WHERE rn <= (SELECT round(3.0 * count(*)) FROM lab WHERE label = 1)",
    [f"lab AS ({_LAB})"])
SQL["m2_shuffle_rows"] = A.sql(f"SELECT *, {_h(7)} AS shuffle_key FROM ({_LAB}) l")
SQL["m3_train_eval_split"] = A.sql(
    f"SELECT *, CASE WHEN bucket = 0 THEN 1 ELSE 0 END AS is_eval FROM (SELECT *, "
    f"CAST(CAST(('0x' || substr({_h(0)}, 1, 8)) AS BIGINT) % 5 AS INTEGER) AS bucket FROM ({_LAB}) l) x")
_M4 = (f"SELECT b.user_id, " + ", ".join(f"w.{q(f'5_day_user_action_{k}')}" for k in TYPES)
       + f" FROM (SELECT DISTINCT user_id FROM actions WHERE {where(A, 30, 'cate = 8')}) b LEFT JOIN ("
       + f"SELECT user_id, " + ", ".join(f"{n(f'type = {k}')} AS {q(f'5_day_user_action_{k}')}" for k in TYPES)
       + f" FROM actions WHERE {where(A, 5, 'cate = 8')} GROUP BY user_id) w ON b.user_id = w.user_id")
SQL["m4_impute_mean"] = A.sql(
    "SELECT user_id, " + ", ".join(
        f"{r(f'coalesce(CAST({q(c)} AS DOUBLE), avg({q(c)}) OVER ())')} AS {q(c)}"
        for c in [f"5_day_user_action_{k}" for k in TYPES]) + f" FROM ({_M4}) m")


# ---- file round trips ----------------------------------------------------------------------------------

SQL["s1_scan_actions"] = A.sql(ROWS)
SQL["s2_scan_users_gbk"] = A.sql("SELECT * FROM users")
SQL["s3_scan_products"] = A.sql("SELECT * FROM products")
SQL["s4_scan_comments"] = A.sql("SELECT CAST(dt AS VARCHAR) AS dt, sku_id, comment_num, has_bad_comment, "
                                "round(bad_comment_rate, 6) AS bad_comment_rate FROM comments")
SQL["s6_materialize"] = SQL["a3_decayed_counts"]
SQL["s7_write_user_submission"] = A.sql(
    f"SELECT user_id, CAST(-1 AS BIGINT) AS sku_id, CAST(row_number() OVER (ORDER BY prob DESC, user_id) AS INTEGER) "
    f"AS rank FROM ({USCORE}) s ORDER BY prob DESC, user_id LIMIT 1000")
SQL["s10_read_candidates"] = A.sql(f"SELECT user_id, CAST(-1 AS BIGINT) AS sku_id FROM ({USCORE}) s "
                                   f"ORDER BY prob DESC, user_id LIMIT 1000")
SQL["s8_s9_scores_submission"] = A.sql(f"SELECT user_id, sku_id FROM ({PSCORE}) p")


# ---- D3: (user, sku) dataset ----------------------------------------------------------------------------

UI_WINDOWS = (1, 2, 3, 5, 10, 15, 21, 28, 35)
MIDS_T = (14, 21, 28, 110, 210)


def d3_sql(ctx0: Ctx, end=None, with_label=True):
    c = _end_ctx(ctx0, end) if end else ctx0
    E = ts(c.end)
    bexp = f"date_sub('day', time, {E})"
    wins = list(UI_WINDOWS) + [0]

    def wf(i):
        return f"time >= {ts(start_of(c, i))}"

    def cnt_w(i, cond=None):
        return f"count(*) FILTER (WHERE {wf(i)}" + (f" AND {cond})" if cond else ")")

    def counts_cols(fmt, ws, types=TYPES):
        return [f"CASE WHEN {cnt_w(i)} > 0 THEN CAST({cnt_w(i, f'type = {k}')} AS BIGINT) END "
                f"AS {q(fmt.format(i=i, k=k))}" for i in ws for k in types]

    def since(i):      # ranks, conversions and first purchases accumulate from rank_start
        return f"time >= {ts(c.rank_start)}" if i == 0 else wf(i)

    def rcnt(i, cond=None):
        return f"count(*) FILTER (WHERE {since(i)}" + (f" AND {cond})" if cond else ")")

    def conv_cols(fmt, ws):
        out = []
        for i in ws:
            for k in CONV:
                num, den = rcnt(i, "type = 4"), rcnt(i, f"type = {k}")
                e = f"CASE WHEN {rcnt(i)} > 0 THEN (CASE WHEN {den} = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / {den} END) END"
                out.append(f"{r(e)} AS {q(fmt.format(i=i, k=k))}")
        return out

    def days_cols(any_fmt, buy_fmt, ws):
        out = []
        for i in ws:
            out.append(f"CAST(NULLIF(count(DISTINCT {bexp}) FILTER (WHERE {wf(i)}), 0) AS BIGINT) AS {q(any_fmt.format(i=i))}")
            out.append(f"CAST(NULLIF(count(DISTINCT {bexp}) FILTER (WHERE {wf(i)} AND type = 4), 0) AS BIGINT) "
                       f"AS {q(buy_fmt.format(i=i))}")
        return out

    def first_last_cols(first, interval):
        m = f"{since(0)} AND type = 4"
        return [f"max({bexp}) FILTER (WHERE {m}) AS {q(first)}",
                f"max({bexp}) FILTER (WHERE {m}) - min({bexp}) FILTER (WHERE {m}) AS {q(interval)}"]

    def grp(keys, cols, extra=None):
        lo = min(start_of(c, 0), minus_days(c.end, max(UI_WINDOWS)))
        wh = in_range(lo, c.end) + (f" AND {extra}" if extra else "")
        return f"SELECT {keys}, {', '.join(cols)} FROM actions WHERE {wh} GROUP BY {keys}"

    def share_body(child, parent, rank, ratio4):
        g = (f"SELECT {child}, " + ", ".join(f"count(*) FILTER (WHERE type = {k}) AS g{k}" for k in TYPES)
             + f" FROM actions WHERE {in_range(c.rank_start, c.end)} GROUP BY {child}")
        pp = f"SELECT {parent}, " + ", ".join(f"sum(g{k}) AS p{k}" for k in TYPES) + f" FROM ({g}) g0 GROUP BY {parent}"
        ratios = [f"CAST(g{k} AS DOUBLE) / NULLIF(p{k}, 0)" for k in TYPES]
        return (f"SELECT {child}, {r(' + '.join(ratios))} AS {q(rank)}, {r(ratios[3])} AS {q(ratio4)} "
                f"FROM ({g}) g JOIN ({pp}) p USING ({parent})")

    ac = c.acc_days
    base = (f"SELECT user_id, sku_id, cate, brand, " + ", ".join(
        f"{r(f'coalesce(sum(exp(-{bexp})) FILTER (WHERE type = {k}), 0)')} AS action_{k}" for k in TYPES)
        + f" FROM actions WHERE {where(c, 30, 'cate = 8')} GROUP BY user_id, sku_id, cate, brand")
    u = grp("user_id", counts_cols("{i}_user_action_{k}", [0], CONV) + conv_cols("{i}_user_conv_ratio_{k}", wins)
            + first_last_cols("0_user_first_buy", "0_user_interval")
            + [f"min({bexp}) FILTER (WHERE {wf(0)} AND type = 4) AS user_last_buy",
               f"min({bexp}) FILTER (WHERE {wf(0)} AND type = 3) AS user_last_cart"]
            + days_cols("{i}_user_action_tm", "{i}_user_action_buy_tm", wins))
    u_stats = two_level(c, "user_id", "sku_id", [0, 5, 30], "{i}_action_{stat}_{k}",
                        ("mean", "max", "min", "var", "std"), False, "cate = 8", raw=True)
    reg = (f"SELECT user_id, CAST(CASE WHEN d < 0 THEN -1 ELSE d END AS BIGINT) AS user_reg_tm FROM "
           f"(SELECT user_id, date_diff('day', CAST(user_reg_tm AS DATE), {dt(c.end)}) AS d FROM users WHERE {_nonnull}) x")
    reg_first = (f"SELECT u.user_id, CAST(floor((coalesce(u.reg, -1) - coalesce(f.first_buy, -1) + 1) / 5.0) AS BIGINT) "
                 f"AS inter_reg_first_buy FROM (SELECT user_id, date_diff('day', CAST(user_reg_tm AS DATE), {dt(c.end)}) "
                 f"AS reg FROM users WHERE {_nonnull}) u LEFT JOIN (SELECT user_id, max({bexp}) AS first_buy FROM actions "
                 f"WHERE {in_range(c.rank_start, c.end)} AND type = 4 GROUP BY user_id) f ON u.user_id = f.user_id")
    per = ", ".join(f"count(*) FILTER (WHERE type = {k}) AS n{k}" for k in TYPES)
    period = (f"SELECT u.user_id, " + ", ".join(
        f"{r(f'CASE WHEN p.n{k} > 0 THEN {float(ac)} / p.n{k} ELSE -1.0 END')} AS {q(f'0_action_period_{k}')}"
        for k in TYPES) + f" FROM users u LEFT JOIN (SELECT user_id, {per} FROM actions WHERE {where(c, 0)} "
        f"GROUP BY user_id) p ON u.user_id = p.user_id")
    basket = ("SELECT u.user_id, " + ", ".join(f"p.cate_{cc}" for cc in CATES) + " FROM users u LEFT JOIN (SELECT user_id, "
              + ", ".join(f"{n(f'cate = {cc}')} AS cate_{cc}" for cc in CATES)
              + f" FROM actions WHERE {in_range(c.rank_start, c.end)} AND type = 4 GROUP BY user_id) p ON u.user_id = p.user_id")

    def model(keys, prefix, extra=None):
        cond = "model_id IN (14, 21, 28, 110, 210)" + (f" AND {extra}" if extra else "")
        return (f"SELECT {keys}, " + ", ".join(f"{n(f'model_id = {v}')} AS {prefix}_{v}" for v in MIDS_T)
                + f" FROM actions WHERE {where(c, 0, cond)} GROUP BY {keys}")

    uc = grp("user_id, cate", counts_cols("{i}_uc_action_{k}", wins)
             + [f"CAST(NULLIF({cnt_w(i, 'type = 4')}, 0) AS BIGINT) AS {q(f'{i}_sku_buy_num_in_cate')}" for i in wins]
             + conv_cols("{i}_uc_conv_ratio_{k}", [0]) + days_cols("{i}_uc_tm", "{i}_uc_buy_tm", wins))
    uic = grp("user_id, sku_id, cate", counts_cols("{i}_syn_action_{k}", wins) + conv_cols("{i}_syn_conv_ratio_{k}", [0])
              + first_last_cols("0_first_buy", "0_interval"))
    ui = grp("user_id, sku_id", counts_cols("{i}_action_{k}", wins) + conv_cols("{i}_ui_conv_ratio_{k}", [0])
             + [f"min({bexp}) FILTER (WHERE {wf(0)} AND type = {k} AND cate = 8) AS {nm}"
                for k, nm in ((3, "ui_last_cart"), (4, "ui_last_buy"), (2, "ui_last_del_cart"))]
             + days_cols("{i}_ui_tm", "{i}_ui_buy_tm", wins))
    sku = grp("sku_id", counts_cols("{i}_sku_action_{k}", wins) + conv_cols("{i}_sku_conv_ratio_{k}", [0]))
    sku_stats = two_level(c, "sku_id", "b", [0, 5, 30], "{i}_pro_action_{stat}_{k}",
                          ("mean", "max", "min", "var", "std"), False, "cate = 8", bexp, raw=True, days_of={0: 35})
    snap = (f"SELECT coalesce(max(dt) FILTER (WHERE dt < {dt(c.end)}), min(dt)) AS snap "
            f"FROM (SELECT DISTINCT dt FROM comments) d")
    comments = ("SELECT sku_id, has_bad_comment, round(bad_comment_rate, 6) AS bad_comment_rate, "
                + ", ".join(f"CASE WHEN comment_num = {v} THEN 1 ELSE 0 END AS comment_num_{v}" for v in (1, 2, 3, 4))
                + f" FROM comments WHERE dt = (SELECT snap FROM ({snap}) s WHERE snap < {dt(c.end)})")
    product = ("SELECT sku_id, cate, brand, " + ", ".join(
        f"CASE WHEN {a} = {v} THEN 1 ELSE 0 END AS {q(f'{a}_{v}')}" for a in ("a1", "a2", "a3") for v in (-1, 0, 1, 2, 3))
        + " FROM products")
    joins = [("user_id", u), ("user_id", u_stats), ("user_id", profile_sql(with_sex=False, codes=range(8), case=AGE_CASE_1_7)), ("user_id", reg),
             ("user_id", reg_first), ("user_id", period), ("user_id", basket),
             ("user_id", model("user_id", "user_model_id")), ("user_id", model("user_id", "user_cate8_model_id", "cate = 8")),
             ("user_id, cate", uc), ("user_id, cate", share_body("user_id, cate", "user_id", "cate_user_rank",
                                                                 "cate_user_ratio_4")),
             ("user_id, cate, sku_id", share_body("user_id, cate, sku_id", "user_id, cate", "sku_in_uc_rank",
                                                  "sku_in_uc_ratio_4")),
             ("user_id, sku_id, cate", uic), ("user_id, sku_id", ui),
             ("user_id, sku_id", model("user_id, sku_id", "ui_model_id")),
             ("user_id, sku_id", share_body("user_id, sku_id", "user_id", "0_sku_user_rank", "0_sku_user_ratio_4"))]
    if with_label:
        joins.append(("user_id, sku_id", f"SELECT DISTINCT user_id, sku_id, 1 AS label FROM actions WHERE "
                                         f"{in_range(c.end, c.end + _dt.timedelta(days=5))} AND type = 4 AND cate = 8"))
    joins += [("sku_id", sku), ("sku_id", sku_stats), ("sku_id", comments),
              ("sku_id, cate", share_body("sku_id, cate", "cate", "sku_cate_rank", "sku_cate_ratio_4")),
              ("brand, cate", share_body("brand, cate", "cate", "brand_cate_rank", "brand_cate_ratio_4")),
              ("sku_id, cate, brand", product)]
    ctes = [f"base AS ({base})"] + [f"j{j} AS ({body})" for j, (_, body) in enumerate(joins)]
    sql = "SELECT * FROM base" + "".join(f" LEFT JOIN j{j} USING ({k})" for j, (k, _) in enumerate(joins))
    filled = f"SELECT coalesce(COLUMNS(*), 0) FROM ({sql}) x"
    return c.sql(f"SELECT *, CAST(CASE WHEN ui_last_del_cart - ui_last_cart <= 0 THEN 1 ELSE 0 END AS INTEGER) "
                 f"AS cart_or_not FROM ({filled}) y", ctes)


SQL["d3_user_sku_dataset"] = d3_sql(A)
SQL["d3_user_sku_dataset_test"] = d3_sql(A, A.score_end, with_label=False)
SQL["d3_user_sku_dataset_lineitem"] = d3_sql(B)


# ---- streaming ----------------------------------------------------------------------------------------

SQL["st1_streamed_daily_cube"] = A.sql(
    f"SELECT user_id, sku_id, cate, brand, type, date_diff('day', CAST(time AS DATE), {dt(A.end)}) AS c, {b(A)} AS b, "
    f"count(*) AS n, strftime(min(time), '%Y-%m-%d %H:%M:%S.%f') AS t_min, "
    f"strftime(max(time), '%Y-%m-%d %H:%M:%S.%f') AS t_max FROM actions WHERE {where(A, 0)} "
    f"GROUP BY user_id, sku_id, cate, brand, type, 6, 7")


# ---- D2: wide user dataset ------------------------------------------------------------------------------

def d2_sql(ctx0: Ctx, end=None, with_label=True, days=5):
    c = _end_ctx(ctx0, end) if end else ctx0
    E = ts(c.end)
    bexp = f"date_sub('day', time, {E})"
    wins = [0] + list(UI_WINDOWS)
    ac = c.acc_days

    def wf(i):
        return f"time >= {ts(start_of(c, i))}"

    def cw(i, cond=None):
        return f"count(*) FILTER (WHERE {wf(i)}" + (f" AND {cond})" if cond else ")")

    def since(i):      # conversions accumulate from rank_start
        return f"time >= {ts(c.rank_start)}" if i == 0 else wf(i)

    def rw(i, cond=None):
        return f"count(*) FILTER (WHERE {since(i)}" + (f" AND {cond})" if cond else ")")

    def ratio0(num, den):
        return f"CASE WHEN {den} = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / {den} END"

    ucols = []
    for i in wins:
        wd = ac if i == 0 else i
        for k in CONV:
            ucols.append(f"{r(f'CASE WHEN {rw(i)} > 0 THEN {ratio0(rw(i, 'type = 4'), rw(i, f'type = {k}'))} END')} "
                         f"AS {q(f'{i}_user_conv_ratio_{k}')}")
        for k in CONV:
            ucols.append(f"CASE WHEN {cw(i)} > 0 THEN CAST({cw(i, f'type = {k}')} AS BIGINT) END AS {q(f'{i}_user_action_{k}')}")
        for k in TYPES:
            ucols.append(f"{r(f'CASE WHEN {cw(i, f'type = {k}')} > 0 THEN {float(wd)} / {cw(i, f'type = {k}')} ELSE -1.0 END')} "
                         f"AS {q(f'{i}_action_period_{k}')}")
        for k in TYPES:
            ucols.append(f"{r(f'CASE WHEN {cw(i, 'cate = 8')} > 0 THEN {ratio0(cw(i, f'cate = 8 AND type = {k}'), cw(i, 'cate = 8'))} END')} "
                         f"AS {q(f'{i}_user_cate8_ratio_{k}')}")
        for cc in (CATES if i == 0 else (8,)):
            for k in CONV:
                e = (f"CASE WHEN {rw(i, f'cate = {cc}')} > 0 THEN "
                     f"{ratio0(rw(i, f'cate = {cc} AND type = 4'), rw(i, f'cate = {cc} AND type = {k}'))} END")
                ucols.append(f"{r(e)} AS {q(f'{i}_cate_{cc}_conv_ratio_{k}')}")
        ucols.append(f"CAST(NULLIF(count(DISTINCT {bexp}) FILTER (WHERE {wf(i)}), 0) AS BIGINT) AS {q(f'{i}_user_action_tm')}")
        ucols.append(f"CAST(NULLIF(count(DISTINCT {bexp}) FILTER (WHERE {wf(i)} AND type = 4), 0) AS BIGINT) "
                     f"AS {q(f'{i}_user_action_buy_tm')}")
        ucols.append(f"CAST(count(DISTINCT {bexp}) FILTER (WHERE {wf(i)} AND cate = 8) AS BIGINT) AS {q(f'{i}_cate_8_action_days')}")
        ucols.append(f"CAST(count(DISTINCT {bexp}) FILTER (WHERE {wf(i)} AND cate = 8 AND type = 4) AS BIGINT) "
                     f"AS {q(f'{i}_cate_8_buy_days')}")
    ucols += [f"min({bexp}) FILTER (WHERE {wf(0)} AND type = 3) AS user_last_cart",
              f"min({bexp}) FILTER (WHERE {wf(0)} AND type = 4) AS user_last_buy"]
    lo = min(start_of(c, 0), minus_days(c.end, max(UI_WINDOWS)))
    u = f"SELECT user_id, {', '.join(ucols)} FROM actions WHERE {in_range(lo, c.end)} GROUP BY user_id"
    cart = (f"SELECT user_id, uc8_last_cart, coalesce(uc8_last_del_cart, 0) AS uc8_last_del_cart, "
            f"CASE WHEN coalesce(uc8_last_del_cart, 0) - uc8_last_cart >= 0 THEN 1 ELSE 0 END AS buy_possible FROM ("
            f"SELECT user_id, min({bexp}) FILTER (WHERE type = 2) AS uc8_last_cart, "
            f"min({bexp}) FILTER (WHERE type = 3) AS uc8_last_del_cart FROM actions "
            f"WHERE {where(c, 0, 'cate = 8 AND type IN (2, 3)')} GROUP BY user_id) x WHERE uc8_last_cart IS NOT NULL")
    g = ("SELECT user_id, cate, " + ", ".join(f"count(*) FILTER (WHERE type = {k}) AS g{k}" for k in TYPES)
         + f" FROM actions WHERE {where(c, 0)} GROUP BY user_id, cate")
    pp = "SELECT user_id, " + ", ".join(f"sum(g{k}) AS p{k}" for k in TYPES) + f" FROM ({g}) g0 GROUP BY user_id"
    ratios = [f"CAST(g{k} AS DOUBLE) / NULLIF(p{k}, 0)" for k in TYPES]
    sh = f"SELECT user_id, cate, {' + '.join(ratios)} AS rk, {ratios[3]} AS r4 FROM ({g}) g JOIN ({pp}) p USING (user_id)"
    rank_piv = (f"SELECT user_id, " + ", ".join(
        f"{r(f'max(CASE WHEN cate = {cc} THEN rk END)')} AS cate_{cc}_rank, "
        f"{r(f'max(CASE WHEN cate = {cc} THEN r4 END)')} AS cate_{cc}_ratio_4" for cc in CATES)
        + f" FROM ({sh}) s GROUP BY user_id")
    basket = ("SELECT u.user_id, " + ", ".join(f"p.cate_{cc}" for cc in CATES) + " FROM users u LEFT JOIN (SELECT user_id, "
              + ", ".join(f"{n(f'cate = {cc}')} AS cate_{cc}" for cc in CATES)
              + f" FROM actions WHERE {where(c, 0, 'type = 4')} GROUP BY user_id) p ON u.user_id = p.user_id")
    last_buy = ("SELECT user_id, " + ", ".join(
        f"coalesce(min({bexp}) FILTER (WHERE cate = {cc} AND type = 4), 0) AS {q(f'cate_{cc}_last_buy')}" for cc in CATES)
        + f" FROM actions WHERE {where(c, 0)} GROUP BY user_id")
    reg = (f"SELECT user_id, CAST(CASE WHEN d < 0 THEN -1 ELSE d END AS BIGINT) AS user_reg_tm FROM "
           f"(SELECT user_id, date_diff('day', CAST(user_reg_tm AS DATE), {dt(c.end)}) AS d FROM users WHERE {_nonnull}) x")
    reg_first = (f"SELECT u.user_id, CAST(floor((coalesce(u.reg, -1) - coalesce(f.first_buy, -1) + 1) / 5.0) AS BIGINT) "
                 f"AS inter_reg_first_buy FROM (SELECT user_id, date_diff('day', CAST(user_reg_tm AS DATE), {dt(c.end)}) "
                 f"AS reg FROM users WHERE {_nonnull}) u LEFT JOIN (SELECT user_id, max({bexp}) AS first_buy FROM actions "
                 f"WHERE {in_range(c.rank_start, c.end)} AND type = 4 GROUP BY user_id) f ON u.user_id = f.user_id")
    st = two_level(c, "user_id", "sku_id", [0, 5, 30], "{i}_action_{stat}_{k}", ("mean", "max", "min", "var", "std"),
                   False, "cate = 8", raw=True)
    parts = [profile_sql(with_sex=False), reg, reg_first, u, cart, rank_piv, basket, last_buy, st]
    if with_label:
        parts.append(f"SELECT DISTINCT user_id, 1 AS label FROM actions WHERE "
                     f"{in_range(c.end, c.end + _dt.timedelta(days=5))} AND type = 4 AND cate = 8")
    base = f"SELECT DISTINCT user_id FROM actions WHERE {where(c, days, 'cate = 8')}"
    ctes = [f"base AS ({base})"] + [f"p{j} AS ({b_})" for j, b_ in enumerate(parts)]
    sql = "SELECT * FROM base" + "".join(f" LEFT JOIN p{j} USING (user_id)" for j in range(len(parts)))
    return c.sql(f"SELECT coalesce(COLUMNS(*), 0) FROM ({sql}) x", ctes)


SQL["d2_user_dataset_wide"] = d2_sql(A)
SQL["d2_user_dataset_wide_test"] = d2_sql(A, A.score_end, with_label=False)
SQL["d2_user_dataset_wide_lineitem"] = d2_sql(B)


# ---- projections on their own ---------------------------------------------------------------------------

SQL["p1_project_rename"] = A.sql(
    f"SELECT user_id, sku_id, cate, action_1 AS view_decay, action_2, action_3, action_4 AS buy_decay, action_5 "
    f"FROM ({_DB}) d")
SQL["p4_row_sum"] = A.sql(f"SELECT user_id, CAST(count(*) AS BIGINT) AS \"5_user_action_sum\" FROM actions "
                          f"WHERE {where(A, 5)} GROUP BY user_id")


def _p6():
    cols = []
    for k in (1, 2, 5, 6):
        num, den = "count(*) FILTER (WHERE type = 4)", f"count(*) FILTER (WHERE type = {k})"
        cols.append(f"{r(f'coalesce(CASE WHEN {den} = 0 THEN NULL ELSE CAST({num} AS DOUBLE) / {den} END, 0.0)')} "
                    f"AS user_action_{k}_ratio")
    h = f"date_sub('hour', max(time) FILTER (WHERE type = 4), {ts(A.end)})"
    cols.append(f"CASE WHEN {h} IS NULL OR {h} <= 0 THEN -1 ELSE {h} END AS user_buy_last")
    return A.sql(f"SELECT user_id, {', '.join(cols)} FROM actions WHERE {where(A, 0, 'cate = 8')} GROUP BY user_id")


SQL["p6_fill_replace"] = _p6()
SQL["p8_pair_key"] = A.sql(f"SELECT concat_ws('-', CAST(user_id AS VARCHAR), CAST(sku_id AS VARCHAR)) AS pair "
                           f"FROM ({TRUTH_P}) t")
SQL["j1_j2_left_joins"] = A.sql(
    f"SELECT b.user_id, b.sku_id, u.\"5_user_action_4\", ui.ui_last_buy FROM ({_PAIRS}) b "
    f"LEFT JOIN (SELECT user_id, {n('type = 4')} AS \"5_user_action_4\" FROM actions WHERE {where(A, 5)} "
    f"GROUP BY user_id) u ON b.user_id = u.user_id "
    f"LEFT JOIN (SELECT user_id, sku_id, min({b(A)}) AS ui_last_buy FROM actions WHERE {where(A, 0, 'type = 4')} "
    f"GROUP BY user_id, sku_id) ui ON b.user_id = ui.user_id AND b.sku_id = ui.sku_id")
SQL["d4_drop_columns"] = SQL["d1_user_dataset"].replace(
    "SELECT * REPLACE (coalesce(label, 0) AS label) FROM base", "SELECT * EXCLUDE (user_id, label) FROM base", 1)
SQL["d3_user_sku_dataset_from_daily"] = SQL["d3_user_sku_dataset"]
