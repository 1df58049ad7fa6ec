"""Edge rows, one per hazard (end = 2016-04-11 00:00:00)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import END, actions_df
from shopcast.functions import exprs, timebins as tb
from shopcast.operators import families as fam
from shopcast.operators import filters as flt
from shopcast.operators import shares, stats
from shopcast.operators import windows as wn
from shopcast.operators.cube import Win, activity_cube


def test_window_boundary_and_two_day_notions(spark):
    a = actions_df(spark, [(1, 1, "2016-04-10 00:00:00", 1), (2, 1, "2016-04-10 00:00:01", 1),
                           (3, 1, "2016-04-11 00:00:00", 1)])
    cube = activity_cube(a, END, END - dt.timedelta(days=1))
    got = {r.user_id: (r.c, r.b) for r in cube.collect()}
    assert got == {1: (1, 1), 2: (1, 0)}          # closed start included, end excluded; c vs b differ


def test_recency_hours(spark):
    a = actions_df(spark, [(1, 1, "2016-04-10 20:30:00", 1)])
    cube = activity_cube(a, END, END - dt.timedelta(days=3))
    r = fam.aggregate(cube, "U", [fam.recency_hours(Win(0, None), END, "h")]).first()
    assert r.h == 3


def test_exclude_period_modes(spark):
    a = actions_df(spark, [(1, 1, "2016-02-06 10:00:00", 1), (1, 1, "2016-02-10 10:00:00", 1),
                           (1, 1, "2016-02-20 10:00:00", 1)])
    lo, hi = dt.datetime(2016, 2, 7), dt.datetime(2016, 2, 13)
    rng = sorted(r.time.day for r in flt.exclude_period(a, lo, hi, "range").collect())
    aft = sorted(r.time.day for r in flt.exclude_period(a, lo, hi, "after").collect())
    assert rng == [6, 20] and aft == [6]


def test_zero_denominator_policies(spark):
    df = spark.createDataFrame([(2, 0), (0, 0)], "n long, d long")
    rows = df.select(exprs.safe_ratio("n", "d", "null").alias("a"), exprs.safe_ratio("n", "d", "zero").alias("b"),
                     exprs.safe_ratio("n", "d", "inf").alias("c")).collect()
    assert (rows[0].a, rows[0].b, rows[0].c) == (None, 0.0, float("inf"))
    assert (rows[1].a, rows[1].b, rows[1].c) == (None, 0.0, None)


def test_rank_null_when_a_type_missing(spark):
    rows = [(1, 1, "2016-04-01 10:00:00", k) for k in (1, 2, 3, 4, 5)]       # no type 6
    cube = activity_cube(actions_df(spark, rows), END, dt.datetime(2016, 3, 1))
    r = shares.sku_share_in_user(cube, Win(0, None)).first()
    assert r["0_sku_user_rank"] is None and r["0_sku_user_ratio_4"] == 1.0


def test_dummy_count_as_written_vs_intended(spark):
    rows = [(1, 1, "2016-04-01 10:00:00", 1), (1, 1, "2016-04-02 10:00:00", 1), (1, 1, "2016-04-03 10:00:00", 4)]
    a = actions_df(spark, rows, )
    a = a.withColumn("model_id", F.lit(14))
    w = fam.model_id_counts(a, dt.datetime(2016, 3, 1), END, mode="as_written").first()
    assert w["user_model_id_14"] == 3 and w["user_model_id_21"] == 3
    cube = activity_cube(a, END, dt.datetime(2016, 3, 1))
    users = spark.createDataFrame([(1,)], "user_id long")
    per = fam.action_period(cube, users, Win(0, None), 10, mode="as_written").first()
    assert per["0_action_period_1"] == 10 / 3 and per["0_action_period_4"] == 10 / 3
    per = fam.action_period(cube, users, Win(0, None), 10).first()
    assert per["0_action_period_1"] == 5.0 and per["0_action_period_4"] == 10.0 and per["0_action_period_2"] == -1.0


def test_basket_intended(spark):
    from shopcast.operators.pivots import cate_purchase_basket
    rows = [(1, 1, "2016-04-01 10:00:00", 4, 5), (1, 2, "2016-04-02 10:00:00", 4, 8)]
    cube = activity_cube(actions_df(spark, rows), END, dt.datetime(2016, 3, 1))
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = {r.user_id: r for r in cate_purchase_basket(cube, users, Win(0, None)).collect()}
    assert got[1]["cate_5"] == 1 and got[1]["cate_8"] == 1 and got[1]["cate_4"] == 0
    assert got[2]["cate_5"] is None


def test_last_is_latest_by_time_not_file_order(spark):
    rows = [(1, 1, "2016-04-09 10:00:00", 2), (1, 1, "2016-04-01 10:00:00", 3)]
    out = wn.keep_latest(actions_df(spark, rows), ["user_id"], "time").first()
    assert out.time.day == 9


def test_cart_uncart_latest_and_fan_out(spark):
    from shopcast.operators.joins import fan_out_counts, latest_per_user_join
    rows = [(1, 1, f"2016-04-0{d} 10:00:00", 2) for d in (1, 2)] + [(1, 1, f"2016-04-0{d} 10:00:00", 3) for d in (3, 4, 5)]
    a = actions_df(spark, rows)
    cart = a.filter("type = 2").select("user_id", F.col("time").alias("t2"))
    uncart = a.filter("type = 3").select("user_id", F.col("time").alias("t3"))
    assert [r.rows for r in fan_out_counts(cart, uncart).collect()] == [6] == [cart.join(uncart, "user_id", "left").count()]
    latest = latest_per_user_join(cart, uncart, "t2", "t3").collect()
    assert [(r.t2.day, r.t3.day) for r in latest] == [(2, 5)]



def test_no_cart_events_flag(spark):
    df = spark.createDataFrame([(None, None)], "del_cart long, cart long").na.fill(0)
    assert df.select(exprs.flag((F.col("del_cart") - F.col("cart")) <= 0).alias("f")).first().f == 1


def test_single_sku_variance_null(spark):
    rows = [(1, 1, "2016-04-01 10:00:00", 1)]
    cube = activity_cube(actions_df(spark, rows), END, dt.datetime(2016, 3, 1))
    r = stats.user_category_sku_stats(cube, [Win(0, None)], 8).first()
    assert r["0_action_var_1"] is None and r["0_action_std_1"] is None and r["0_action_mean_1"] == 1.0


def test_missing_type_column_exists(spark):
    rows = [(1, 1, "2016-04-10 10:00:00", 1)]
    cube = activity_cube(actions_df(spark, rows), END, dt.datetime(2016, 4, 1))
    out = fam.type_counts_df(cube, "U", Win.of(5), "{i}_user_action_{k}")
    r = out.first()
    assert "5_user_action_5" in out.columns and r["5_user_action_5"] == 0


def test_interval_bucket_floor(spark):
    df = spark.createDataFrame([(-3,), (4,), (9,)], "x long")
    assert [r.b for r in df.select(tb.interval_bucket("x").alias("b")).collect()] == [-1, 1, 2]


def test_both_registration_date_formats(spark):
    df = spark.createDataFrame([("2016/4/1",), ("2016-04-01",), ("2016-04-20",)], "user_reg_tm string")
    got = [r.d for r in df.select(tb.days_registered(END).alias("d")).collect()]
    assert got == [10, 10, -1]


def test_relative_order(spark):
    df = spark.createDataFrame([(0, 3), (1, 1), (2, 3), (3, 2)], "i int, v int")
    got = [r.o for r in wn.relative_order(df, "v", "o").orderBy("i").collect()]
    assert got == [1, 3, 1, 2]


def test_top1_tie_lower_sku(spark):
    df = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (2, 1, 0.1)], "user_id long, sku_id long, label double")
    got = {r.user_id: r.sku_id for r in wn.top1_per_key(df).collect()}
    assert got == {1: 3, 2: 1}
