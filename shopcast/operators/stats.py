"""Two-level statistics (A2u, A2c, A2p).

Level 1 counts events per type at a finer key (user×sku, or sku×elapsed
day) for every requested window at once; level 2 takes avg / max / min /
sample variance (/ sample std) of those counts per group, over the level-1
rows present in each window.  Both levels are plain hash aggregates with
map-side combine, so a hot user or sku never lands raw in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.operators.cube import cnt0_sql, cnt_sql, sql_col, type_sql
from shopcast.schemas import TYPES

_STATS_SQL = {
    "avg": "avg", "mean": "avg", "max": "max", "min": "min", "var": "var_samp", "std": "stddev_samp",
}


def two_level_stats(cube: DataFrame, keys, sub, wins, fmt: str,
                    stats=("avg", "max", "min", "var"), types=TYPES, with_sum: bool = False,
                    sum_label: str = "sum") -> DataFrame:
    """Statistics of per-(keys, sub) type counts, per group of ``keys``.

    ``fmt`` receives ``i`` (window label), ``k`` (type code or ``sum_label``)
    and ``stat``.  Groups with no event in any requested window are dropped;
    statistics of a window the group is absent from are NULL.
    """
    keys, sub = list(keys), list(sub)
    lvl1_aggs = []
    for w in wins:
        lvl1_aggs.append(sql_col(f"{cnt_sql(w)} IS NOT NULL", f"_p{w.label}"))
        for k in types:
            lvl1_aggs.append(sql_col(cnt0_sql(w, type_sql(k)), f"_w{w.label}_{k}"))
    lvl1 = cube.groupBy(*keys, *sub).agg(*lvl1_aggs)
    if with_sum:
        lvl1 = lvl1.select("*", *[reduce(add, [F.col(f"_w{w.label}_{k}") for k in types])
                                  .alias(f"_w{w.label}_{sum_label}") for w in wins])
    ks = list(types) + ([sum_label] if with_sum else [])
    aggs = [sql_col(f"max(CAST(_p{w.label} AS INT))", f"_any{w.label}") for w in wins]
    for w in wins:
        for k in ks:
            v = f"CASE WHEN _p{w.label} THEN CAST(_w{w.label}_{k} AS DOUBLE) END"
            for st in stats:
                aggs.append(sql_col(f"{_STATS_SQL[st]}({v})", fmt.format(i=w.label, k=k, stat=st)))
    out = lvl1.groupBy(*keys).agg(*aggs)
    keep = reduce(lambda a, b: a | b, [F.col(f"_any{w.label}") == 1 for w in wins])
    return out.filter(keep).drop(*[f"_any{w.label}" for w in wins])


def user_sku_stats(cube: DataFrame, wins, fmt: str = "{i}_day_user_action_{k}_{stat}",
                   with_sum: bool = True) -> DataFrame:
    """A2u: per-user statistics over the user's (user, sku) type counts."""
    return two_level_stats(cube, ["user_id"], ["sku_id"], wins, fmt, with_sum=with_sum)


def user_category_sku_stats(cube: DataFrame, wins, cate: int,
                            fmt: str = "{i}_action_{stat}_{k}") -> DataFrame:
    """A2u inside one category, with std."""
    return two_level_stats(cube.filter(F.col("cate") == cate), ["user_id"], ["sku_id"], wins, fmt,
                           stats=("mean", "max", "min", "var", "std"))


def sku_daily_stats(cube: DataFrame, wins, cate: int,
                    fmt: str = "{i}_pro_action_{stat}_{k}") -> DataFrame:
    """A2p: per-sku statistics over (sku, elapsed day) type counts (only days
    with events count)."""
    return two_level_stats(cube.filter(F.col("cate") == cate), ["sku_id"], ["b"], wins, fmt,
                           stats=("mean", "max", "min", "var", "std"))
