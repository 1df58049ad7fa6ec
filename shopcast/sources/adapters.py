"""Map the driver's test tables onto the engine's source schemas.

Adapter A turns ``events`` into a dense action log; adapter B turns
``lineitem ⋈ orders ⋈ part`` into a sparse, large one whose timestamps are all
exactly midnight.  Users, products and comments come from ``customer`` and
``part``.  Each adapter is a projection (plus, for B, two equi-joins) that
Catalyst prunes and pushes down like any other plan.
"""

from __future__ import annotations

from dataclasses import dataclass
import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass(frozen=True)
class Dates:
    """The fixed dates a dataset is built for (all midnight)."""
    end: _dt.datetime                 # feature end (exclusive)
    label_start: _dt.datetime         # label window [label_start, label_end)
    label_end: _dt.datetime
    acc_start: _dt.datetime           # accumulate start of counts, days, periods, recency, model ids
    rank_start: _dt.datetime          # accumulate start of ranks, conversions, first / last purchase
    score_end: _dt.datetime           # end used for the scoring set
    excl_lo: _dt.datetime | None = None   # holiday period (F4)
    excl_hi: _dt.datetime | None = None
    target_cate: int = 8

    @property
    def acc_days(self) -> int:
        return (self.end - self.acc_start).days


_d = _dt.datetime
# Dates of the two adapters (fixed by the test fixtures).
DATES_A = Dates(end=_d(2024, 1, 26), label_start=_d(2024, 1, 26), label_end=_d(2024, 1, 31),
                acc_start=_d(2024, 1, 1), rank_start=_d(2024, 1, 6), score_end=_d(2024, 1, 31),
                excl_lo=_d(2024, 1, 7), excl_hi=_d(2024, 1, 13))
DATES_B = Dates(end=_d(2001, 6, 5), label_start=_d(2001, 6, 5), label_end=_d(2001, 6, 10),
                acc_start=_d(2001, 1, 1), rank_start=_d(2001, 2, 1), score_end=_d(2001, 6, 10))


def actions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A: ``events`` as an action log (fixed code mapping)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    typ = (F.when(F.col("event_type") == "view", 1)
           .when(F.col("event_type") == "signup", 2)
           .when(F.col("event_type") == "error", 3)
           .when(F.col("event_type") == "purchase", 4)
           .when(F.col("event_type") == "click",
                 F.when(F.col("event_id") % 2 == 0, 5).otherwise(6)))
    m = F.col("event_id") % 7
    model = (F.when(m == 0, 14).when(m == 1, 21).when(m == 2, 28)
             .when(m == 3, 110).when(m == 4, 210).otherwise(0))
    return (e.select("event_id", "user_id", "ts", "event_type", k.alias("k"))
             .select(F.col("user_id").cast("long").alias("user_id"),
                     F.col("k").cast("long").alias("sku_id"),
                     F.col("ts").alias("time"),
                     model.cast("int").alias("model_id"),
                     typ.cast("int").alias("type"),
                     (F.lit(4) + F.col("k") % 8).cast("int").alias("cate"),
                     (F.col("k") % 13).cast("int").alias("brand")))


def actions_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter B: ``lineitem ⋈ orders ⋈ part`` as an action log."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_linenumber")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    fl = F.concat("l_returnflag", "l_linestatus")
    typ = (F.when(fl == "NO", 1).when(fl == "RO", 2).when(fl == "RF", 3)
           .when(fl == "AF", 4).when(fl == "AO", 5).when(fl == "NF", 6))
    cate = (F.when(F.col("p_type") == "ECONOMY", 4).when(F.col("p_type") == "LARGE", 5)
            .when(F.col("p_type") == "MEDIUM", 6).when(F.col("p_type") == "PROMO", 7)
            .when(F.col("p_type") == "SMALL", 8).when(F.col("p_type") == "STANDARD", 9))
    j = (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
           .join(p, li.l_partkey == p.p_partkey, "inner"))
    return j.select(F.col("o_custkey").cast("long").alias("user_id"),
                    F.col("l_partkey").cast("long").alias("sku_id"),
                    F.col("l_shipdate").alias("time"),
                    F.col("l_linenumber").cast("int").alias("model_id"),
                    typ.cast("int").alias("type"),
                    cate.cast("int").alias("cate"),
                    F.substring("p_brand", 7, 100).cast("int").alias("brand"))


# Age-bucket text per market segment (fixture mapping).
_SEGMENT_AGE = {"AUTOMOBILE": "15岁以下", "BUILDING": "16-25岁",
                "FURNITURE": "26-35岁", "HOUSEHOLD": "36-45岁"}


def users_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    age = F.lit("-1")
    for seg, txt in reversed(list(_SEGMENT_AGE.items())):
        age = F.when(F.col("c_mktsegment") == seg, F.lit(txt)).otherwise(age)
    k = F.col("c_custkey")
    return c.select(
        k.cast("long").alias("user_id"),
        age.alias("age"),
        F.when(k % 50 == 49, F.lit(None).cast("double")).otherwise((k % 3).cast("double")).alias("sex"),
        (F.lit(1) + k % 5).cast("int").alias("user_lv_cd"),
        F.date_format(F.date_add(F.lit("2023-12-01").cast("date"), (k % 70).cast("int")),
                      "yyyy-MM-dd").alias("user_reg_tm"))


def products_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products for adapter A: category and (except every 11th sku) brand agree
    with the action log; the exceptions exercise the brand-mismatch join."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select(k.cast("long").alias("sku_id"),
                    (s % 4 - 1).cast("int").alias("a1"),
                    (s % 3 - 1).cast("int").alias("a2"),
                    (s % 5 - 1).cast("int").alias("a3"),
                    (F.lit(4) + k % 8).cast("int").alias("cate"),
                    F.when(k % 11 == 0, F.lit(99)).otherwise(k % 13).cast("int").alias("brand"))


def products_from_part_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products for adapter B: category and brand use adapter B's mapping."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    s = F.col("p_size")
    cate = (F.when(F.col("p_type") == "ECONOMY", 4).when(F.col("p_type") == "LARGE", 5)
            .when(F.col("p_type") == "MEDIUM", 6).when(F.col("p_type") == "PROMO", 7)
            .when(F.col("p_type") == "SMALL", 8).when(F.col("p_type") == "STANDARD", 9))
    return p.select(F.col("p_partkey").cast("long").alias("sku_id"),
                    (s % 4 - 1).cast("int").alias("a1"),
                    (s % 3 - 1).cast("int").alias("a2"),
                    (s % 5 - 1).cast("int").alias("a3"),
                    cate.cast("int").alias("cate"),
                    F.substring("p_brand", 7, 100).cast("int").alias("brand"))


# Weekly comment snapshot dates of the fixture, with their week index.
COMMENT_SNAPSHOTS = (("2024-01-01", 0), ("2024-01-08", 1), ("2024-01-15", 2), ("2024-01-22", 3))


def comments_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comment row per sku per weekly snapshot (no join: the snapshot list
    is exploded per part row)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    snaps = F.array(*[F.struct(F.lit(d).cast("date").alias("dt"), F.lit(w).alias("w"))
                      for d, w in COMMENT_SNAPSHOTS])
    x = p.select("p_partkey", "p_size", F.explode(snaps).alias("s"))
    return x.select(F.col("s.dt").alias("dt"),
                    F.col("p_partkey").cast("long").alias("sku_id"),
                    ((F.col("p_partkey") + F.col("s.w")) % 5).cast("int").alias("comment_num"),
                    F.when(F.col("p_size") > 25, 1).otherwise(0).cast("int").alias("has_bad_comment"),
                    (F.col("p_size").cast("double") / 50).alias("bad_comment_rate"))


def load_a(spark: SparkSession, sf_dir: str) -> dict:
    return {"actions": actions_from_events(spark, sf_dir),
            "users": users_from_customer(spark, sf_dir),
            "products": products_from_part(spark, sf_dir),
            "comments": comments_from_part(spark, sf_dir),
            "dates": DATES_A}


def load_b(spark: SparkSession, sf_dir: str) -> dict:
    return {"actions": actions_from_lineitem(spark, sf_dir),
            "users": users_from_customer(spark, sf_dir),
            "products": products_from_part_b(spark, sf_dir),
            "comments": comments_from_part(spark, sf_dir),
            "dates": DATES_B}
