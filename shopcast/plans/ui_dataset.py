"""The (user, sku) dataset for one end date.

Physical plan:

1. one activity cube over ``[min(acc_start, end - 35d), end)``, written once to
   the shared checkpoint folder, so the raw log is scanned and shuffled once
   however many families read it;
2. the base rows — pairs of the target category with an event in the last 30
   days — written and measured: the aggregates by user, pair and sku read only
   the cube rows of the base's users and skus (category totals read all);
3. ONE fused ``groupBy(grain).agg(...)`` per grain (pair, user, sku) with every
   window of every family as conditional aggregates.  The base has one category,
   so the families within the category are windows with that condition in the
   same aggregates; distinct-day counts come from day bitmasks in them, and the
   shares of a category from its totals (one row);
4. left joins onto the base rows ordered by key set.  A user, sku or brand with a
   large share of the base is spread over salts in its joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.exprs import flag
from shopcast.functions.timebins import window_start
from shopcast.operators import families as fam
from shopcast.operators import stats
from shopcast.operators.cube import (
    Win, cnt0_sql, day_mask_aggs, days_from_masks, in_win, is_type, mask_columns, materialized_cube, sql_col,
    type_sql, win_sql,
)
from shopcast.operators.joins import key_sizes, salted, salted_left_join, semi_restrict
from shopcast.operators.profile import (
    AGE_CODES_1_7, basic_product_features, comment_features, static_user_features,
)
from shopcast.plans.wide_user import basket_measures, of_known_users, period_measures
from shopcast.schemas import CATES, CONV_TYPES, MODEL_IDS, PURCHASE, TYPES, UI_DAY_WINDOWS
from shopcast.sources.adapters import Dates
from shopcast.sources.files import staged

FEW_KEYS = 1 << 20      # a list of so many ids (8 MB) is broadcast


@dataclass(frozen=True)
class UISpec:
    windows: tuple = UI_DAY_WINDOWS
    base_days: int = 30          # base rows: (user, sku) with an event in the last N days (0 = accumulate)
    stat_windows: tuple = (5, 30)
    product_stat_days: int = 35  # window of the "0" product statistics (explicit; see H13)


def _recency_in_cate(w: Win, name: str, k: int, cate: int):
    return F.min(F.when(in_win(w) & is_type(k) & (F.col("cate") == cate), F.col("b"))).alias(name)


def _model_ids(w: Win, prefix: str, cond: str | None = None) -> list:
    """A11 on the cube's model-id counts."""
    m = win_sql(w) + (f" AND {cond}" if cond else "")
    return [sql_col(f"sum(CASE WHEN {m} THEN m_{v} END)", f"{prefix}_{v}") for v in MODEL_IDS]


def _with_days(aggs, keys, cube, max_day, *families):
    """Grain aggregate plus distinct active / purchase days per window, from
    day bitmasks in the same aggregate (no day-level table, no extra join).
    ``families``: (tag, windows, active-day name, purchase-day name)."""
    aggs, days = list(aggs), []
    for tag, wins, any_fmt, buy_fmt in families:
        of = f"cate = {wins[0].cate}" if wins[0].cate is not None else "TRUE"
        aggs += day_mask_aggs(f"{tag}x", max_day, of) + day_mask_aggs(f"{tag}p", max_day, f"type = {PURCHASE} AND {of}")
        for w in wins:
            days.append(F.expr(days_from_masks(f"{tag}x", w, max_day)).alias(any_fmt.format(i=w.label)))
            days.append(F.expr(days_from_masks(f"{tag}p", w, max_day)).alias(buy_fmt.format(i=w.label)))
    g = cube.groupBy(*keys).agg(*aggs)
    hidden = {c for tag, *_ in families for c in mask_columns(g, f"{tag}x") + mask_columns(g, f"{tag}p")}
    return g.select(*[F.col(f"`{c}`") for c in g.columns if c not in hidden], *days)


def _restricted(rows: DataFrame, base: DataFrame, key: str, keys: int) -> DataFrame:
    """``rows`` of the keys that ``base`` (a written table) has; they are
    broadcast only where their number shows that they are few."""
    return semi_restrict(rows, base.select(key).distinct(), key, bound=keys if keys <= FEW_KEYS else None)


def pruned(cube: DataFrame, base: DataFrame, users: int, skus: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cube rows that the aggregates by user, by pair and by sku need;
    ``users`` and ``skus`` are how many the base has."""
    of_users = _restricted(cube, base, "user_id", users)
    return of_users, _restricted(of_users, base, "sku_id", skus), _restricted(cube, base, "sku_id", skus)


def _one_row_a_key(frames, key: str) -> DataFrame:
    """Frames with one row a key and columns of their own, as one such frame (no join)."""
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    return both.groupBy(key).agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in both.columns if c != key])


def _share_cols(child_fmt: str, parent, rank: str, ratio4: str):
    """Share rank from counts on the row: Σ_k child_k / parent_k (NULL when a
    parent total is 0) and the purchase share.  ``parent``: the names of the
    totals on the row, or a row of totals ``t{k}``."""
    total = {k: f"`{parent.format(k=k)}`" if isinstance(parent, str) else f"{parent[f't{k}']}L" for k in TYPES}
    r = [f"try_divide(CAST(`{child_fmt.format(k=k)}` AS DOUBLE), {total[k]})" for k in TYPES]
    return [sql_col(" + ".join(r), rank), sql_col(r[PURCHASE - 1], ratio4)]


def packed(t: DataFrame, keys, name: str) -> DataFrame:
    """``t``'s columns beside the keys as one struct, which joins and sorts copy as a whole."""
    return t.select(*keys, F.struct(*[F.col(f"`{c}`") for c in t.columns if c not in keys]).alias(name))


def unpacked(df: DataFrame, names) -> DataFrame:
    """The structs' columns in place of the structs (NULL where a left join found no row)."""
    out = []
    for c in df.columns:
        if c in names:
            out += [F.col(f"`{c}`.`{f}`").alias(f) for f in df.schema[c].dataType.names]
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def user_sku_dataset(src: dict, with_label: bool = True, spec: UISpec = UISpec(),
                     end=None) -> DataFrame:
    """Build the (user, sku) table.  ``src`` has ``actions``, ``users``,
    ``products``, ``comments`` and ``dates`` (a ``Dates``)."""
    D: Dates = src["dates"]
    end = end or D.end
    acc_days = (end - D.acc_start).days
    acc = Win(0, acc_days)
    racc = Win(0, (end - D.rank_start).days)    # ranks, conversions, first / last purchase, basket
    wins = [Win.of(i) for i in spec.windows]
    start = min(D.acc_start, D.rank_start, window_start(end, days=max(spec.windows)))
    cate = D.target_cate
    actions = src["actions"]
    cube = materialized_cube(actions, end, start, src.get("daily"), MODEL_IDS)

    # base rows: decayed counts per (user, sku, cate, brand) in the base window, target category
    bw = acc if spec.base_days == 0 else Win.of(spec.base_days)
    base = fam.aggregate(cube.filter(F.col("cate") == cate), "UICB",
                         fam.decayed_counts(bw, "action_{k}"), bw)

    # the base is written and measured first: only its users and skus are
    # aggregated, and those with a large share of its rows are spread over salts
    base = staged(base, "ui-base")
    rows = base.count()
    (users, hot_users), (skus, hot_skus), (_, hot_brands) = (key_sizes(base, k, rows) for k in ("user_id", "sku_id", "brand"))
    by_user, by_pair, by_sku = pruned(cube, base, users, skus)
    in_cate = cube.filter(F.col("cate") == cate)
    wins8, acc8, racc8 = ([Win(w.label, w.days, cate) for w in ws] for ws in (wins, [acc], [racc]))
    acc8, racc8 = acc8[0], racc8[0]
    max_day = max(acc_days, max(spec.windows))

    # pairs, over all categories (base pairs have one) and within the category
    pair_m = []
    for w in wins + [acc]:
        pair_m += fam.type_counts(w, "{i}_action_{k}")
    pair_m += fam.conv_ratios(racc, "{i}_ui_conv_ratio_{k}") + fam.type_counts(racc, "_rui_{k}")
    pair_m += [_recency_in_cate(acc, "ui_last_cart", 3, cate), _recency_in_cate(acc, "ui_last_buy", PURCHASE, cate),
               _recency_in_cate(acc, "ui_last_del_cart", 2, cate)]
    pair_m += _model_ids(acc, "ui_model_id")
    for w in wins8 + [acc8]:
        pair_m += fam.type_counts(w, "{i}_syn_action_{k}")
    pair_m += fam.conv_ratios(racc8, "{i}_syn_conv_ratio_{k}") + fam.type_counts(racc8, "_ruic_{k}")
    pair_m += fam.first_last_buy(racc8, "0_first_buy", "0_interval")
    pair = _with_days(pair_m, ["user_id", "sku_id"], by_pair, max_day, ("ui", [acc] + wins, "{i}_ui_tm", "{i}_ui_buy_tm"))

    # users (+ hidden totals per type: the parent of the user share ranks), also within the category
    u_m = fam.type_counts(acc, "{i}_user_action_{k}", CONV_TYPES)
    u_m += fam.type_counts(racc, "_ru_{k}")
    for w in wins + [racc]:
        u_m += fam.conv_ratios(w, "{i}_user_conv_ratio_{k}")
    u_m += fam.first_last_buy(racc, "0_user_first_buy", "0_user_interval")
    u_m += [fam.recency_days(acc, "user_last_buy", PURCHASE), fam.recency_days(acc, "user_last_cart", 3)]
    u_m += _model_ids(acc, "user_model_id") + _model_ids(acc, "user_cate8_model_id", f"cate = {cate}")
    u_m += period_measures(acc, acc_days, "{i}_action_period_{k}") + basket_measures(racc, "cate_{c}")
    for w in wins8 + [acc8]:
        u_m += fam.type_counts(w, "{i}_uc_action_{k}") + [fam.purchase_rows(w, f"{w.label}_sku_buy_num_in_cate")]
    u_m += fam.conv_ratios(racc8, "{i}_uc_conv_ratio_{k}") + fam.type_counts(racc8, "_ruc_{k}")
    u = _with_days(u_m, ["user_id"], by_user, max_day,
                   ("u", [acc] + wins, "{i}_user_action_tm", "{i}_user_action_buy_tm"),
                   ("uc", [acc8] + wins8, "{i}_uc_tm", "{i}_uc_buy_tm"))
    u_stats = stats.user_category_sku_stats(by_user, [acc] + [Win.of(i) for i in spec.stat_windows], cate)
    profile = static_user_features(src["users"], end, AGE_CODES_1_7, default=0, drop_sex=True)   # D4: no sex

    # skus and brands; their shares of the category from its totals per type (one row)
    totals = in_cate.filter(in_win(racc)).agg(*[sql_col(cnt0_sql(racc, type_sql(k)), f"t{k}") for k in TYPES]).first()
    i_m = []
    for w in wins + [acc]:
        i_m += fam.type_counts(w, "{i}_sku_action_{k}")
    i_m += fam.conv_ratios(racc, "{i}_sku_conv_ratio_{k}") + fam.type_counts(racc8, "_ric_{k}")
    sku = by_sku.groupBy("sku_id").agg(*i_m)
    sku = sku.select("*", *_share_cols("_ric_{k}", totals, "sku_cate_rank", "sku_cate_ratio_4")).drop(*[f"_ric_{k}" for k in TYPES])
    pwins = [Win(0, spec.product_stat_days)] + [Win.of(i) for i in spec.stat_windows]
    sku_stats = stats.sku_daily_stats(by_sku, pwins, cate)
    by_one_sku = _one_row_a_key([sku, sku_stats, comment_features(src["comments"], end)], "sku_id")
    brand = in_cate.filter(in_win(racc)).groupBy("brand").agg(*fam.type_counts(racc, "_rb_{k}"))
    brand = brand.select("brand", *_share_cols("_rb_{k}", totals, "brand_cate_rank", "brand_cate_ratio_4"))
    product = basic_product_features(src["products"].filter(F.col("cate") == cate)).drop("cate")

    # joins, grouped by key set (consecutive joins on the same keys reuse the
    # base's partitioning); each side's columns travel as one struct, so that a
    # row of hundreds of columns is taken apart once, after the last join
    df = base.join(packed(pair, ["user_id", "sku_id"], "_pair"), ["user_id", "sku_id"], "left")
    if with_label:
        lab = fam.labels(actions, D.label_start, D.label_end, ("user_id", "sku_id"), cate=cate)
        df = df.join(lab, ["user_id", "sku_id"], "left")
    df = salted(df, "user_id", hot_users, ["sku_id", "brand"])
    for name, t in (("_user", u), ("_user_stats", u_stats), ("_profile", profile)):
        df = salted_left_join(df, packed(t, ["user_id"], name), ["user_id"], "user_id", hot_users)
    df = salted(df, "sku_id", hot_skus, ["user_id"])
    df = salted_left_join(df, packed(by_one_sku, ["sku_id"], "_sku"), ["sku_id"], "sku_id", hot_skus)
    df = salted_left_join(df, packed(product, ["sku_id", "brand"], "_product"), ["sku_id", "brand"], "sku_id", hot_skus)
    df = salted(df, "brand", hot_brands, ["user_id", "sku_id"])
    df = salted_left_join(df, brand, ["brand"], "brand", hot_brands).drop("_salt")
    last_of_user = df.schema["_profile"].dataType.names[-1]
    df = unpacked(df, ("_pair", "_user", "_user_stats", "_profile", "_sku", "_product"))
    df = of_known_users(df, [f"0_action_period_{k}" for k in TYPES] + [f"cate_{c}" for c in CATES], "0_user_first_buy")
    *names, first_buy = df.columns
    names.insert(names.index(last_of_user) + 1, first_buy)      # beside the other columns of the user
    df = df.select(*[F.col(f"`{c}`") for c in names])

    # W1a–W1c as projections: child and parent counts since rank_start are already
    # on every row (user totals, (user, cate) and (user, cate, sku) counts)
    df = df.select("*", *_share_cols("_rui_{k}", "_ru_{k}", "0_sku_user_rank", "0_sku_user_ratio_4"),
                   *_share_cols("_ruic_{k}", "_ruc_{k}", "sku_in_uc_rank", "sku_in_uc_ratio_4"),
                   *_share_cols("_ruc_{k}", "_ru_{k}", "cate_user_rank", "cate_user_ratio_4"))
    df = df.drop("_reg", "_known", *[f"_{g}_{k}" for g in ("ru", "rui", "ruc", "ruic") for k in TYPES])

    df = df.na.fill(0)
    return df.withColumn("cart_or_not", flag((F.col("ui_last_del_cart") - F.col("ui_last_cart")) <= 0))


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs = everything except keys and label, sorted by name so
    train and test vectors line up by name, never by position."""
    drop = {"user_id", "sku_id", "label"}
    return sorted(c for c in df.columns if c not in drop)
