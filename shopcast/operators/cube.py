"""The daily activity cube (one pre-aggregation shared by every day window).

For a fixed midnight ``end`` every event gets

* ``c`` — calendar distance (``datediff(end, to_date(time))``): day window i
  is exactly ``c <= i`` (closed start ``end - i days``);
* ``b`` — elapsed whole days (``timestampdiff(DAY, time, end)``), the unit of
  recency, decay and active-day features,

and the log is aggregated once to ``(user, sku, cate, brand, type, c, b)``
with the event count and first/last time.  All day-window families become
conditional aggregates over this much smaller table, so nine windows cost one
scan and one (map-side combined) shuffle instead of nine.

Skew: a hot user / sku only appears as many cube rows as it has distinct
(sku, type, day) combinations, and every later aggregate is partial
(map-side) first, so no single key is ever gathered raw into one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.functions.timebins import calendar_distance, elapsed_days, ts_lit
from shopcast.schemas import PURCHASE

CUBE_KEYS = ("user_id", "sku_id", "cate", "brand", "type", "c", "b")

GRAINS = {
    "U": ("user_id",),
    "I": ("sku_id",),
    "UI": ("user_id", "sku_id"),
    "UC": ("user_id", "cate"),
    "IC": ("sku_id", "cate"),
    "BC": ("brand", "cate"),
    "C": ("cate",),
    "UIC": ("user_id", "sku_id", "cate"),
    "UICB": ("user_id", "sku_id", "cate", "brand"),
}


@dataclass(frozen=True)
class Win:
    """A look-back window: ``label`` is used in column names, ``days`` selects
    ``c <= days`` (``None`` = everything in the cube); ``cate`` keeps one
    category's events only."""
    label: int
    days: int | None
    cate: int | None = None

    @staticmethod
    def of(i: int) -> "Win":
        return Win(i, i)


ALL = Win(0, None)


def model_counts(ids) -> list[Column]:
    """Hidden cube columns ``m_{v}``: events with each listed model id."""
    return [F.count(F.when(F.col("model_id") == v, 1)).alias(f"m_{v}") for v in ids]


def activity_cube(actions: DataFrame, end, start=None, models=()) -> DataFrame:
    """Aggregate the action log in ``[start, end)`` to the daily cube;
    ``models`` adds the counts of those model ids."""
    cond = F.col("time") < ts_lit(end)
    if start is not None:
        cond = cond & (F.col("time") >= ts_lit(start))
    return (actions.filter(cond)
            .select("user_id", "sku_id", "cate", "brand", "type", "time", *(["model_id"] if models else []),
                    calendar_distance(end).alias("c"), elapsed_days(end).alias("b"))
            .groupBy(*CUBE_KEYS)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min("time").alias("t_min"),
                 F.max("time").alias("t_max"),
                 *model_counts(models)))


# ---- conditional aggregate building blocks ---------------------------------

def in_win(w: Win) -> Column:
    return F.expr(win_sql(w))


def is_type(k: int) -> Column:
    return F.col("type") == F.lit(k)


def cnt(w: Win, cond: Column | None = None) -> Column:
    """Events in the window (and condition); NULL when there are none."""
    m = in_win(w) if cond is None else (in_win(w) & cond)
    return F.sum(F.when(m, F.col("n")))


def has(w: Win, cond: Column | None = None) -> Column:
    return cnt(w, cond).isNotNull()


def cnt0(w: Win, cond: Column | None = None) -> Column:
    return F.coalesce(cnt(w, cond), F.lit(0).cast("long"))


# ---- the same building blocks as SQL text ------------------------------------
# Feature tables have hundreds of columns; composing each through the Column
# API costs ~20 driver->JVM calls per column, while one SQL expression per
# column is parsed in a single call.  Same semantics as the Column helpers.

def win_sql(w: Win) -> str:
    days = "TRUE" if w.days is None else f"c <= {int(w.days)}"
    return days if w.cate is None else f"{days} AND cate = {int(w.cate)}"


def cnt_sql(w: Win, cond: str | None = None) -> str:
    m = win_sql(w) if cond is None else f"{win_sql(w)} AND ({cond})"
    return f"sum(CASE WHEN {m} THEN n END)"


def cnt0_sql(w: Win, cond: str | None = None) -> str:
    return f"coalesce({cnt_sql(w, cond)}, 0L)"


def present_sql(w: Win, value: str) -> str:
    return f"CASE WHEN {cnt_sql(w)} IS NOT NULL THEN {value} END"


def type_sql(k: int) -> str:
    return f"type = {int(k)}"


def ratio_sql(num: str, den: str, on_zero: str = "null") -> str:
    """``safe_ratio`` as SQL text."""
    q = f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"
    if on_zero == "null":
        return q
    if on_zero == "zero":
        return f"coalesce({q}, 0D)"
    if on_zero == "inf":
        return (f"CASE WHEN CAST({den} AS DOUBLE) = 0 THEN (CASE WHEN {num} > 0 THEN CAST('Infinity' AS DOUBLE) "
                f"WHEN {num} < 0 THEN CAST('-Infinity' AS DOUBLE) END) ELSE {q} END")
    raise ValueError(on_zero)


def sql_col(expr: str, name: str) -> Column:
    return F.expr(expr).alias(name)


# ---- distinct-day counts from day bitmasks -------------------------------------
# Per group, OR together 1 << day over the events: the set of active days in
# a fixed number of longs (63 days each, bounded by the window length, not by
# the data) that combines map-side like any sum.  For elapsed days b, window i
# holds every day b < i plus day i only through midnight events (c == b), so
# a second mask over midnight events makes the count exact:
#     days_i = popcount(any & (days < i)) + bit(midnight, i).
# For calendar days c, window i is simply popcount(any & (days <= i)).

_CHUNK = 63


def _chunks(max_day: int) -> int:
    return max_day // _CHUNK + 1


def day_mask_aggs(tag: str, max_day: int, cond: str | None = None, by: str = "b") -> list[Column]:
    """Hidden aggregate columns ``_{tag}a{j}`` (any event) and, for elapsed
    days, ``_{tag}m{j}`` (midnight events)."""
    out = []
    kinds = [("a", None)] + ([("m", "c = b")] if by == "b" else [])
    for kind, extra in kinds:
        for j in range(_chunks(max_day)):
            lo = j * _CHUNK
            m = f"{by} >= {lo} AND {by} < {lo + _CHUNK}"
            if cond:
                m += f" AND ({cond})"
            if extra:
                m += f" AND {extra}"
            out.append(sql_col(f"bit_or(CASE WHEN {m} THEN shiftleft(1L, {by} - {lo}) END)", f"_{tag}{kind}{j}"))
    return out


def _popcount_below(col: str, upto: int, max_day: int) -> str:
    terms = []
    for j in range(_chunks(max_day)):
        n = upto - j * _CHUNK
        if n <= 0:
            break
        mask = (1 << min(n, _CHUNK)) - 1
        terms.append(f"bit_count(coalesce({col}{j}, 0L) & {mask}L)")
    return " + ".join(terms) if terms else "0"


def days_from_masks(tag: str, w: Win, max_day: int, by: str = "b") -> str:
    """Distinct days in window ``w`` from the hidden mask columns (NULL when
    none)."""
    top = max_day if w.days is None else w.days
    if by == "c":
        count = _popcount_below(f"_{tag}a", top + 1, max_day)
    else:
        j, r = divmod(top, _CHUNK)
        count = (f"{_popcount_below(f'_{tag}a', top, max_day)} + "
                 f"CAST(shiftright(coalesce(_{tag}m{j}, 0L), {r}) & 1L AS INT)")
    return f"CAST(nullif({count}, 0) AS BIGINT)"


def mask_columns(df: DataFrame, tag: str) -> list[str]:
    return [c for c in df.columns if c.startswith(f"_{tag}a") or c.startswith(f"_{tag}m")]


# ---- day-level tables for distinct-day counts ------------------------------

def day_level(cube: DataFrame, keys, by: str = "b") -> DataFrame:
    """One row per (keys, day) with the smallest calendar distance of any
    event / any purchase on that day.  Counting rows of this table with
    ``mc <= i`` is a distinct-day count for window i, so no
    ``countDistinct`` (and no Expand blow-up per window) is needed."""
    return (cube.groupBy(*keys, by)
                .agg(F.min("c").alias("mc"),
                     F.min(F.when(is_type(PURCHASE), F.col("c"))).alias("mc4")))


def days_in(w: Win, purchase: bool = False) -> Column:
    """Distinct days in window (on a ``day_level`` table); NULL when none."""
    col = F.col("mc4" if purchase else "mc")
    m = col.isNotNull() if w.days is None else (col <= F.lit(w.days))
    return F.nullif(F.count(F.when(m, F.lit(1))), F.lit(0))


def materialized_cube(actions: DataFrame, end, start=None, daily: DataFrame | None = None, models=()) -> DataFrame:
    """The cube written once as Parquet under the shared checkpoint folder
    (``spark.checkpoint.dir``) and read back.

    Many families read the cube with different filters and columns; Catalyst
    pushes those filters below the cube aggregate, so the branches would not
    share one exchange and the raw log would be re-scanned per family.
    Writing the (much smaller) cube once gives a single scan + shuffle of the
    log, column pruning / predicate pushdown on the cube for every family,
    and a lineage cut that survives executor loss.

    With ``daily`` (the end-independent daily table, see ``streaming``) the
    cube is derived from it instead of the raw log, so several end dates
    (train and scoring sets) cost one pass over the log.
    """
    import uuid

    from shopcast.session import checkpoint_dir

    spark = actions.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cube/{uuid.uuid4().hex}"
    if daily is not None:
        from shopcast.streaming.daily_cube import cube_from_daily
        cube = cube_from_daily(daily, end, start, models)
    else:
        cube = activity_cube(actions, end, start, models)
    cube.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialized_daily(actions: DataFrame) -> DataFrame:
    """The end-independent daily table written once under the checkpoint
    folder (batch form of the streaming job)."""
    import uuid

    from shopcast.session import checkpoint_dir
    from shopcast.streaming.daily_cube import daily_partials

    spark = actions.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/daily/{uuid.uuid4().hex}"
    daily_partials(actions).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
