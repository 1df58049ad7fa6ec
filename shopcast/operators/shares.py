"""Share-of-total ranks (W1a–W1e).

For a child grain G inside a parent grain P, per type k:
``share_k = count_G,k / count_P,k`` and ``rank = Σ_k share_k``.  A parent
total of 0 makes that share NULL, and NULL propagates through the sum (so the
rank is NULL unless all six totals are non-zero).

Parent totals are an aggregate of the child table (never a window
``partitionBy(parent)``, which would put a hot user in one task), joined back
on the parent key; AQE broadcasts them when their measured size is small.  The
rows of a hot user are spread over salts in that join.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.exprs import safe_ratio
from shopcast.operators.cube import GRAINS, Win, cnt0_sql, in_win, sql_col, type_sql
from shopcast.operators.joins import hot_keys, salted, salted_left_join
from shopcast.schemas import PURCHASE, TYPES
from shopcast.sources.files import staged


def share_rank(cube: DataFrame, child, parent, w: Win, rank_name: str, ratio4_name: str, spread: str | None = None) -> DataFrame:
    """``spread``: the child column that parts the rows of a hot parent.  The
    child counts are then written and measured; a parent key that holds a large
    share of them is spread over salts, its total copied to each."""
    ck = list(GRAINS[child]) if isinstance(child, str) else list(child)
    pk = list(GRAINS[parent]) if isinstance(parent, str) else list(parent)
    g = (cube.filter(in_win(w)).groupBy(*ck)
             .agg(*[sql_col(cnt0_sql(w, type_sql(k)), f"_g{k}") for k in TYPES]))
    hot = []
    if spread:
        g = staged(g, "share-counts")
        hot = hot_keys(g, pk[0])
    p = g.groupBy(*pk).agg(*[F.sum(f"_g{k}").alias(f"_p{k}") for k in TYPES])
    # every child has a parent, so the left join is an inner one
    j = salted_left_join(salted(g, pk[0], hot, [spread]), p, pk, pk[0], hot) if hot else g.join(p, pk, "inner")
    ratios = {k: safe_ratio(F.col(f"_g{k}"), F.col(f"_p{k}"), "null") for k in TYPES}
    return j.select(*ck, reduce(add, ratios.values()).alias(rank_name),
                    ratios[PURCHASE].alias(ratio4_name))


def sku_share_in_user(cube, w: Win):
    """W1a."""
    return share_rank(cube, "UI", "U", w, f"{w.label}_sku_user_rank", f"{w.label}_sku_user_ratio_4", "sku_id")


def sku_share_in_user_cate(cube, w: Win):
    """W1b."""
    return share_rank(cube, ("user_id", "cate", "sku_id"), "UC", w, "sku_in_uc_rank", "sku_in_uc_ratio_4",
                      "sku_id")


def cate_share_in_user(cube, w: Win):
    """W1c."""
    return share_rank(cube, "UC", "U", w, "cate_user_rank", "cate_user_ratio_4", "cate")


def sku_share_in_cate(cube, w: Win):
    """W1d."""
    return share_rank(cube, "IC", "C", w, "sku_cate_rank", "sku_cate_ratio_4")


def brand_share_in_cate(cube, w: Win):
    """W1e."""
    return share_rank(cube, "BC", "C", w, "brand_cate_rank", "brand_cate_ratio_4")
