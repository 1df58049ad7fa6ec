"""Property tests: cube-derived windows equal direct window queries; datasets
have one row per key; train and scoring schemas agree."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shopcast.functions.timebins import ts_lit
from shopcast.operators import families as fam
from shopcast.operators.cube import Win, activity_cube
from shopcast.sources.adapters import load_a, load_b


def _direct_counts(actions, end, days):
    start = end - dt.timedelta(days=days)
    a = actions.filter((F.col("time") >= ts_lit(start)) & (F.col("time") < ts_lit(end)))
    return {(r.user_id, r.type): r.n for r in a.groupBy("user_id", "type").agg(F.count(F.lit(1)).alias("n")).collect()}


def _cube_counts(actions, end, days):
    cube = activity_cube(actions, end, end - dt.timedelta(days=40))
    c = cube.filter(F.col("c") <= days).groupBy("user_id", "type").agg(F.sum("n").alias("n"))
    return {(r.user_id, r.type): r.n for r in c.collect()}


def test_cube_equals_direct_windows(spark):
    rnd = random.Random(3)
    for loader in (load_a, load_b):
        d = loader(spark, SF_SMALL)
        base = d["dates"].end
        for _ in range(2):
            end = base - dt.timedelta(days=rnd.randint(0, 10))
            days = rnd.choice([1, 2, 5, 10, 35])
            assert _cube_counts(d["actions"], end, days) == _direct_counts(d["actions"], end, days)


def test_windows_monotone(spark):
    d = load_a(spark, SF_SMALL)
    D = d["dates"]
    cube = activity_cube(d["actions"], D.end, D.acc_start)
    ms = []
    for i in (1, 5, 10):
        ms += fam.type_counts(Win.of(i), "{i}_n_{k}", (1,))
    rows = cube.groupBy("user_id").agg(*ms).na.fill(0).collect()
    assert all(r["1_n_1"] <= r["5_n_1"] <= r["10_n_1"] for r in rows)


def test_shares_sum_to_number_of_nonzero_types(spark):
    from shopcast.operators.shares import sku_share_in_cate
    d = load_a(spark, SF_SMALL)
    D = d["dates"]
    cube = activity_cube(d["actions"], D.end, D.acc_start)
    s = sku_share_in_cate(cube, Win(0, None)).groupBy("cate").agg(F.sum("sku_cate_rank").alias("s")).collect()
    for r in s:
        if r.s is not None:
            assert abs(r.s - 6.0) < 1e-9


def test_d3_one_row_per_key_and_schema_equal(spark):
    from shopcast.plans.ui_dataset import user_sku_dataset
    d = load_a(spark, SF_SMALL)
    train = user_sku_dataset(d, with_label=True)
    test = user_sku_dataset(d, with_label=False, end=d["dates"].score_end)
    assert train.count() == train.select("user_id", "sku_id").distinct().count()
    assert sorted(c for c in train.columns if c != "label") == sorted(test.columns)
    assert train.filter(F.col("label").isNull()).count() == 0


def test_d1_one_row_per_user(spark):
    from shopcast.plans.user_dataset import user_dataset
    df = user_dataset(load_a(spark, SF_SMALL))
    assert df.count() == df.select("user_id").distinct().count()
    assert set(r.label for r in df.select("label").distinct().collect()) <= {0, 1}


def test_cube_from_daily_equals_cube_midnight_heavy(spark):
    from shopcast.streaming import cube_from_daily, daily_partials, merge_partials
    for loader in (load_a, load_b):
        d = loader(spark, SF_SMALL)
        D = d["dates"]
        a = d["actions"]
        halves = a.randomSplit([0.5, 0.5], seed=1)
        daily = merge_partials(daily_partials(halves[0]).unionByName(daily_partials(halves[1])))
        cols = ["user_id", "sku_id", "cate", "brand", "type", "c", "b", "n", "t_min", "t_max"]
        got = sorted(tuple(r) for r in cube_from_daily(daily, D.end, D.acc_start).select(*cols).collect())
        want = sorted(tuple(r) for r in activity_cube(a, D.end, D.acc_start).select(*cols).collect())
        assert got == want


def test_streamed_daily_table_gives_the_cube(spark):
    import __spark_entry__ as entry
    d = load_a(spark, SF_SMALL)
    D = d["dates"]
    got = entry.queries()["st1_streamed_daily_cube"](spark, SF_SMALL)
    want = activity_cube(d["actions"], D.end, D.acc_start)
    key = ["user_id", "sku_id", "cate", "brand", "type", "c", "b", "n"]
    assert sorted(tuple(r) for r in got.select(*key).collect()) == sorted(tuple(r) for r in want.select(*key).collect())


def test_d2_one_row_per_user_and_schema_equal(spark):
    from shopcast.plans.wide_user import user_dataset_wide, user_dataset_wide_test
    d = load_a(spark, SF_SMALL)
    train = user_dataset_wide(d)
    test = user_dataset_wide_test(d)
    assert train.count() == train.select("user_id").distinct().count()
    assert sorted(c for c in train.columns if c != "label") == sorted(test.columns)


def test_active_days_without_a_window_equal_the_bitmasks(spark):
    d = load_a(spark, SF_SMALL)
    D = d["dates"]
    cube = activity_cube(d["actions"], D.end, D.acc_start)
    wide = Win(0, D.acc_days)
    for purchase in (False, True):
        for by in ("b", "c"):
            a, b = (sorted(tuple(r) for r in fam.active_days_df(cube, "UC", w, "n", purchase, by).collect())
                    for w in (Win(0, None), wide))
            assert a == b and a


def test_a_user_with_a_third_of_the_rows_is_spread_over_tasks(spark):
    from shopcast.operators import joins
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 400 + 100).alias("user_id"),
                                    F.col("id").alias("sku_id"))
    per_user = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    hot = joins.hot_keys(rows, "user_id")
    assert hot == [7]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.salted_left_join(joins.salted(rows, "user_id", hot, ["sku_id"]), per_user, ["user_id"], "user_id", hot)
        assert got.where("user_id = 7").select("_salt").distinct().count() == joins.SALTS
        assert "_salt" in got._jdf.queryExecution().executedPlan().toString()
        want = rows.join(per_user, ["user_id"], "left")
        assert sorted(map(tuple, got.drop("_salt").collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_d3_with_a_hot_user_equals_the_plain_joins(spark, monkeypatch):
    from shopcast.plans import ui_dataset
    d = load_a(spark, SF_SMALL)
    plain = ui_dataset.user_sku_dataset(d).select("user_id", "sku_id", "0_user_action_1", "0_uc_action_1", "user_lv_cd_1")
    users = [r.user_id for r in d["actions"].groupBy("user_id").count().orderBy(F.col("count").desc()).limit(2).collect()]
    monkeypatch.setattr(ui_dataset, "key_sizes", lambda df, key, total: (total, users if key == "user_id" else []))
    split = ui_dataset.user_sku_dataset(d).select(*plain.columns)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.collect()))


def test_packed_columns_come_back_in_place(spark):
    from shopcast.plans.ui_dataset import packed, unpacked
    left = spark.createDataFrame([(1, 5), (2, 6)], "k long, a long")
    right = spark.createDataFrame([(1, 7, None)], "k long, `0_x` long, y double")
    joined = left.join(packed(right, ["k"], "_r"), "k", "left")
    assert joined.columns == ["k", "a", "_r"]
    out = unpacked(joined.withColumn("z", F.lit(0)), ("_r",))
    assert out.columns == ["k", "a", "0_x", "y", "z"]
    assert sorted(map(tuple, out.collect())) == [(1, 5, 7, None, 0), (2, 6, None, None, 0)]
