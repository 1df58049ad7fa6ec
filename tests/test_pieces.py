"""Running values over pieces, salted shares, input-aware feature sets and the base-first dataset plan."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, actions_df
from shopcast.operators import pieces as pc
from shopcast.operators import windows as wn


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def task_rows(df, *keys):
    """Rows of each partition."""
    return [r["count"] for r in df.select(F.spark_partition_id().alias("task"), *keys).groupBy("task").count().collect()]


def asof_tables(spark, n=900, seed=1):
    rng = random.Random(seed)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 30))
    rows = [(i, 7 if i % 3 else rng.randint(1, 30), None if rng.random() < 0.03 else day()) for i in range(n)]
    rows += [(n, None, day()), (n + 1, 7, dt.datetime(2024, 1, 3)), (n + 2, 7, dt.datetime(2024, 1, 3))]
    snaps = [(k, day().date(), rng.randint(0, 9)) for k in list(range(1, 25)) * 3 + [7] * 12]
    snaps += [(7, dt.date(2024, 1, 3), 100), (7, dt.date(2024, 1, 3), 101), (None, dt.date(2024, 1, 1), 5), (8, None, 6)]
    return rows, snaps, (spark.createDataFrame(rows, "id long, sku long, at timestamp_ntz").repartition(3),
                         spark.createDataFrame(snaps, "sku long, dt date, v int").repartition(2))


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_asof_join_equals_search(spark, parts):
    rows, snaps, (left, right) = asof_tables(spark)
    got = {r.id: (r.dt, r.v) for r in pc.asof_join(left, right, ["sku"], "at", "dt", ["v"], parts).collect()}
    assert len(got) == len(rows)
    for i, sku, at in rows:
        before = [(d, v) for k, d, v in snaps if k is not None and k == sku and d is not None and at is not None
                  and dt.datetime(d.year, d.month, d.day) < at]
        assert got[i] == max(before, default=(None, None))


def test_asof_join_of_repeated_and_no_rows(spark):
    rows, _, (left, right) = asof_tables(spark, 30)
    twice = left.unionByName(left).withColumn("extra", F.lit("x"))
    got = pc.asof_join(twice, right, ["sku"], "at", "dt", ["v"], 5)
    assert got.columns == ["id", "sku", "at", "extra", "dt", "v"] and got.count() == 2 * len(rows)
    assert pc.asof_join(left.limit(0), right, ["sku"], "at", "dt", ["v"]).count() == 0
    assert {r.v for r in pc.asof_join(left, right.limit(0), ["sku"], "at", "dt", ["v"]).collect()} == {None}


def test_asof_join_parts_a_hot_key(spark):
    rows = spark.range(30_000).select((F.col("id") % 3 == 0).cast("long").alias("sku"),
                                      F.lit("2024-01-05 00:00:00").cast("timestamp_ntz").alias("at"))
    cut = pc.pieces(rows, ["sku"], ["at"], "test", 10)          # all rows of a key are equal
    sizes = [r["count"] for r in cut.groupBy("_piece").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 30_000 / 10


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_relative_order_with_keys_equals_counting(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(40)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v int")
    hist = df.groupBy("k", "v").count()
    got = {(r.k, r.v): r.o for r in pc.running_order(hist, ["k"], "v", "count", "o", parts).collect()}
    whole = {(r.k, r.v): r.order for r in wn.relative_order(df, "v", partition_by=["k"]).collect()}
    for k, v in set(rows):
        mine = [x for key, x in rows if key == k]
        want = len(mine) - 1 if v is None else sum(x is not None and x >= v for x in mine) - 1
        assert got[k, v] == whole[k, v] == want


def test_no_task_holds_a_hot_keys_values(spark):
    hist = spark.range(40_000).select(F.when(F.col("id") % 10 < 8, F.lit(1)).otherwise(F.col("id")).alias("k"),
                                      F.col("id").alias("v"), F.lit(1).alias("n"))
    cut = pc.pieces(hist, ["k"], [F.col("v").desc_nulls_last()], "test", 8)
    assert max(r["count"] for r in cut.groupBy("_piece").count().collect()) < 2 * 40_000 / 8


def test_share_ranks_of_a_hot_user(spark, no_broadcast):
    """A third of the rows on one user: equal results, and no task above its share."""
    from shopcast.operators import shares
    from shopcast.operators.cube import Win, activity_cube
    rng = random.Random(5)
    rows = [(1 if i % 3 == 0 else 1000 + i, i % 2000 if i % 3 == 0 else rng.randint(0, 50),
             "2016-04-%02d 10:00:00" % (1 + i % 9), 1 + rng.randint(0, 5), 4 + i % 8) for i in range(6000)]
    cube = activity_cube(actions_df(spark, rows), dt.datetime(2016, 4, 11))
    for rank, keys in ((shares.sku_share_in_user, ("user_id", "sku_id")), (shares.sku_share_in_user_cate, ("user_id", "cate", "sku_id"))):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = rank(cube, Win(0, None))
            sizes = task_rows(got, *keys)
            assert max(sizes) < 0.25 * sum(sizes), sizes        # unsplit, the hot user's task alone has over a third
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        count = {}
        for user, sku, _, kind, cate in rows:
            key = (user, cate, sku) if "cate" in keys else (user, sku)
            parent = (user, cate) if "cate" in keys else user
            for name in (("child", key), ("parent", parent)):
                count.setdefault(name, [0] * 7)[kind] += 1
            count.setdefault("of", {})[key] = parent
        for r in got.collect():
            key = tuple(r[k] for k in keys)
            child, parent = count["child", key], count["parent", count["of"][key]]
            want = None if 0 in parent[1:] else sum(c / p for c, p in zip(child[1:], parent[1:], strict=True))
            assert r[len(keys)] == (want if want is None else pytest.approx(want))


def test_feature_set_notices_a_changed_log(spark, tmp_path):
    from shopcast.sources.files import feature_path, manifest, materialize
    log = str(tmp_path / "log")
    spark.range(5).write.parquet(log)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(log).withColumn("y", F.col("id") * 2)

    read = lambda: materialize(build, "log_test", [spark.read.parquet(log)], spark, a=1)
    assert read().count() == 5 and read().count() == 5 and len(calls) == 1          # the second call reads the first's
    first = feature_path(spark, "log_test", [spark.read.parquet(log)], a=1)
    spark.range(5, 9).write.mode("append").parquet(log)
    assert read().count() == 9 and len(calls) == 2
    assert feature_path(spark, "log_test", [spark.read.parquet(log)], a=1) != first
    assert len(manifest(spark.read.parquet(log))) == len(spark.read.parquet(log).inputFiles())
    other = feature_path(spark, "log_test", [spark.read.parquet(log)], a=2)
    assert other != feature_path(spark, "log_test", [spark.read.parquet(log)], a=1)


def test_registered_feature_set_is_read_again(spark):
    import __spark_entry__ as entry
    query = entry.queries()["s6_materialize"]
    one, two = query(spark, SF_SMALL), query(spark, SF_SMALL)
    assert one.inputFiles() and sorted(one.inputFiles()) == sorted(two.inputFiles())


def test_dataset_reads_only_the_bases_keys(spark):
    """Rows that enter the user, pair and sku aggregates are those of the base's users and skus."""
    from shopcast.operators import families as fam
    from shopcast.operators.cube import Win, materialized_cube
    from shopcast.plans import ui_dataset as ui
    from shopcast.sources.adapters import load_a
    from shopcast.sources.files import staged
    d = load_a(spark, SF_SMALL)
    D = d["dates"]
    cube = materialized_cube(d["actions"], D.end, D.acc_start)
    base = staged(fam.aggregate(cube.filter("cate = 8 AND user_id % 5 = 0"), "UICB", fam.decayed_counts(Win.of(30), "action_{k}"),
                                Win.of(30)), "test-base")
    users, skus = ({r[0] for r in base.select(k).distinct().collect()} for k in ("user_id", "sku_id"))
    rows = cube.collect()
    by_user, by_pair, by_sku = ui.pruned(cube, base, len(users), len(skus))
    assert by_user.count() == sum(r.user_id in users for r in rows) < len(rows)
    assert by_sku.count() == sum(r.sku_id in skus for r in rows) < len(rows)
    assert by_pair.count() == sum(r.user_id in users and r.sku_id in skus for r in rows)
    plan = ui.user_sku_dataset(d)._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate [user_id" in line or "Aggregate [sku_id" in line]
    assert aggregates and len(re.findall(r"Join LeftSemi", plan)) >= 3


def test_dataset_of_a_hot_sku(spark, no_broadcast):
    """A sku with half of the base rows: the same table, its rows spread over tasks in the joins by sku."""
    from shopcast.plans import ui_dataset as ui
    from shopcast.sources.adapters import DATES_A, load_a
    d = load_a(spark, SF_SMALL)
    rows = []
    for i in range(900):
        sku, brand = (4, 4) if i % 2 else (12 + 8 * (i % 40), 1 + i % 6)
        rows.append((i, sku, "2024-01-%02d 08:00:00" % (6 + i % 18), 1 + i % 6, 8, brand, 14))
    src = dict(d, actions=actions_df(spark, rows))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = ui.user_sku_dataset(src, with_label=False)
        got = {(r.user_id, r.sku_id): r for r in df.collect()}
        sizes = task_rows(df, "sku_id", "28_sku_action_1", "brand_cate_rank")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    base = {(u, s) for u, s, t, *_ in rows if t < str(DATES_A.end)}
    assert set(got) == base
    hot = [r for r in got.values() if r.sku_id == 4]
    ones = sum(s == 4 and k == 1 for _, s, _, k, *_ in rows)
    assert len(hot) == 450 and {r["28_sku_action_1"] for r in hot} == {ones}
    assert max(sizes) < 0.35 * sum(sizes), sizes
