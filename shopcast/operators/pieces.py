"""Running values over sorted rows without a window that holds a whole key (T8 per row, W3).

``pieces`` range-partitions rows by key and order and writes them, so a hot key
is spread over consecutive pieces.  Inside a piece an ordinary window runs; what
the earlier pieces of the key add is carried over.  Only keys that lie in several
pieces need that: at most one per border, so the carried table has at most twice
as many rows as there are pieces and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopcast.sources.files import staged

NUMBERED = 997      # equal rows may be parted anywhere, so they are numbered


def pieces(df: DataFrame, keys, order, label: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``_piece``: rows in order of keys and ``order`` cut into ranges of about equal size."""
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = df.withColumn("_no", F.monotonically_increasing_id() % NUMBERED)
    cut = numbered.repartitionByRange(parts, *keys, *order, "_no").drop("_no")
    return staged(cut.withColumn("_piece", F.spark_partition_id()), label)


def carried(cut: DataFrame, keys, sums: dict[str, Column], carry) -> DataFrame:
    """(keys, _piece, name...) for the pieces of keys that lie in several.

    ``sums`` reduces the rows of a key inside a piece; ``carry(column, window)``
    combines those of the pieces before.
    """
    keys = list(keys)
    spans = cut.groupBy(*keys).agg(F.min("_piece").alias("_first"), F.max("_piece").alias("_last")).where("_first < _last")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    renamed = spans.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    each = (cut.join(F.broadcast(renamed), same, "left_semi").groupBy(*keys, "_piece")
            .agg(*[c.alias(name) for name, c in sums.items()]))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*keys, "_piece", *[carry(F.col(name), before).alias(name) for name in sums])


def with_carried(rows: DataFrame, carry: DataFrame, keys) -> DataFrame:
    """``rows`` with the carried columns of their key and piece (null where nothing is carried)."""
    keys = [*keys, "_piece"]
    renamed = carry.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(F.broadcast(renamed), same, "left").drop(*[f"_k_{k}" for k in keys])


def asof_join(rows: DataFrame, snapshots: DataFrame, keys, row_time: str, snap_time: str, values,
              parts: int | None = None) -> DataFrame:
    """T8 per row: ``rows`` with ``snap_time`` and ``values`` of the latest
    snapshot of their key strictly before them (NULL where there is none; of
    snapshots of one time the greatest values).  A NULL key or time has no
    snapshot and is none.

    Rows and snapshots are one union; the last snapshot runs along each piece of
    it, and the last one of the pieces before is carried over."""
    keys, names = list(keys), [snap_time, *values]
    mine = rows.select(*keys, F.col(row_time).cast("timestamp_ntz").alias("_t"), F.lit(0).alias("_kind"),
                       F.struct(*[F.col(c) for c in rows.columns if c not in keys]).alias("_row"))
    known = snapshots.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, snap_time])).select(
        *keys, F.col(snap_time).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_kind"),
        F.struct(*names).alias("_snap"))
    both = mine.unionByName(known, allowMissingColumns=True)
    cut = pieces(both, keys, ["_t", "_kind", "_snap"], "asof", parts)
    order = ["_t", "_kind", "_snap"]
    along = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max_by("_snap", F.when(F.col("_kind") == 1, F.struct("_t", "_snap")))
    carry = carried(cut, keys, {"_before": latest}, lambda c, w: F.last(c, ignorenulls=True).over(w))
    out = with_carried(cut.withColumn("_last", F.last("_snap", ignorenulls=True).over(along)).where("_kind = 0"), carry, keys)
    found = F.coalesce("_last", "_before")
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns],
                      *[found.getField(c).alias(c) for c in names])


def running_order(hist: DataFrame, keys, value: str, count: str, out: str, parts: int | None = None) -> DataFrame:
    """(keys, value, out): rows of the key with a value at least this one, less 1 (``hist``: distinct values and counts)."""
    cut = pieces(hist, keys, [F.col(value).desc_nulls_last()], "order", parts)
    along = (Window.partitionBy(*keys, "_piece").orderBy(F.col(value).desc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = carried(cut, keys, {"_above": F.sum(count)}, lambda c, w: F.sum(c).over(w))
    rows = with_carried(cut.withColumn("_sum", F.sum(count).over(along)), carry, keys)
    return rows.select(*keys, value, (F.col("_sum") + F.coalesce("_above", F.lit(0)) - 1).alias(out))
