"""Model steps on small tables, and the file chain between them."""

import pytest
from pyspark.sql import functions as F

from conftest import actions_df
from shopcast.operators import evaluate as ev
from shopcast.operators import model as md
from shopcast.operators import windows as wn


@pytest.fixture(scope="module")
def table(spark):
    """x1 decides the label, x2 is noise, x3 is half empty."""
    n = 400
    return spark.range(n).select(
        F.col("id").alias("user_id"), (F.col("id") % 7).alias("sku_id"),
        (F.col("id") % 20).cast("double").alias("x1"), (F.crc32(F.col("id").cast("string").cast("binary")) % 10).cast("double").alias("x2"),
        F.when(F.col("id") % 2 == 0, F.lit(3.0)).alias("x3"),
        F.when(F.col("id") % 20 > 14, 1).otherwise(0).alias("label")).cache()


COLS = ["x1", "x2", "x3"]


def test_boosted_trees_separate_a_separable_table(spark, table):
    got = md.fit_predict_boosted(table, table, COLS, max_iter=5)
    rows = got.select("label", "prob").collect()
    assert all(0 <= r.prob <= 1 for r in rows)
    assert min(r.prob for r in rows if r.label) > max(r.prob for r in rows if not r.label)


def test_impute_mean(spark, table):
    got = md.impute_mean(table.withColumn("x3", F.col("x3") + F.col("x1")), ["x3"])
    mean = table.agg(F.avg(F.col("x3") + F.col("x1"))).first()[0]
    assert got.where("user_id % 2 = 1").select("x3").distinct().first()[0] == pytest.approx(mean)


def test_importances_are_positive(spark, table):
    m = md.fit_gbt(table, COLS, max_iter=3)
    top = ev.importance_topn(md.importance_table(spark, m, COLS), 2).collect()
    assert top[0].feature == "x1" and all(r.importance > 0 for r in top) and len(top) <= 2


def test_the_importance_fit_reads_short_vectors_dealt_to_all_cores(spark, table, monkeypatch):
    one, cores, kept = table.coalesce(1), spark.sparkContext.defaultParallelism, []
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sizes(md._vectors(one, COLS, "label")) == [400]      # too small to be dealt
    monkeypatch.setattr(md, "VECTOR_BYTES", 400 * 8 * len(COLS) // cores)
    assert sizes(md._vectors(one, COLS, "label")) == [400 // cores] * cores
    monkeypatch.setattr(md, "staged", lambda df, label: kept.append(df) or df)
    md.fit_gbt(one, COLS, max_iter=1)
    assert [df.columns for df in kept] == [["features", "label"]]


def test_ensemble_weights_and_scores(spark, table):
    import inspect
    weights = inspect.signature(md.fit_ensemble).parameters["weights"].default
    assert len(weights) == 11 and sum(weights) == pytest.approx(1.0)
    members = md.fit_ensemble(table, COLS, weights=(0.5, 0.5), max_iter=3)
    rows = md.score_ensemble(members, table.drop("label")).select("user_id", "label").collect()
    assert len(rows) == 400 and all(0 <= r.label <= 1 for r in rows)


def test_all_fits_of_the_ensemble_read_the_same_blocks(spark, table, monkeypatch):
    import os

    from shopcast.operators import boosting as bo
    from shopcast.session import checkpoint_dir
    made, binned = [], bo.binned
    for module in (bo, md):
        monkeypatch.setattr(module, "binned", lambda *a: made.append(binned(*a)) or made[-1], raising=False)
    scores = md.subspace_ensemble(table, table.drop("label"), COLS, weights=(0.5, 0.3, 0.2), max_iter=3, parallelism=2)
    assert scores.count() == 400 and len(made) == 1 and not os.path.exists(made[0].path.removeprefix("file:"))


def test_training_defaults():
    import inspect
    stopped, ensemble, boosted = (inspect.signature(f).parameters for f in (md.fit_stopped, md.fit_ensemble, md.fit_predict_boosted))
    for p in (stopped, ensemble):
        assert [p[k].default for k in ("max_iter", "max_depth", "step", "columns", "patience")] == [1000, 5, 0.05, 0.8, 50]
    assert boosted["max_iter"].default == 100


def test_candidate_file_keeps_its_rank_in_any_number_of_files(spark, tmp_path):
    from shopcast.sources.files import read_candidates
    from shopcast.sources.sinks import write_user_submission
    scores = spark.range(50).select(F.col("id").alias("user_id"), (F.col("id") * 7 % 50).cast("double").alias("prob"))
    write_user_submission(scores, 40, str(tmp_path / "one"))
    spark.read.option("header", True).csv(str(tmp_path / "one")).repartition(5).write.option("header", True).csv(str(tmp_path / "many"))
    want = [r.user_id for r in scores.orderBy(F.col("prob").desc(), "user_id").limit(10).collect()]
    for name in ("one", "many"):
        got = read_candidates(spark, str(tmp_path / name), 10)
        assert got.columns == ["user_id", "sku_id"] and sorted(r.user_id for r in got.collect()) == sorted(want)


def test_final_submission_has_one_row_per_user(spark, tmp_path):
    from shopcast.sources.sinks import final_submission, write_scores
    scores = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.9), (2, 5, 0.1), (2, 4, 0.1)], "user_id long, sku_id long, label double")
    write_scores(wn.top1_per_key(scores), str(tmp_path / "s"))
    got = final_submission(spark, str(tmp_path / "s"), str(tmp_path / "o")).collect()
    assert sorted((r.user_id, r.sku_id) for r in got) == [(1, 2), (2, 4)]


def test_labels_and_truth_are_of_the_target_category(spark):
    import datetime as dt
    from shopcast.operators import families as fam
    a = actions_df(spark, [(1, 1, "2016-04-11 10:00:00", 4, 8), (2, 2, "2016-04-11 10:00:00", 4, 9), (1, 1, "2016-04-12 10:00:00", 4, 8)])
    lo, hi = dt.datetime(2016, 4, 11), dt.datetime(2016, 4, 16)
    assert [r.user_id for r in fam.labels(a, lo, hi, cate=8).collect()] == [1]
    assert [r.user_id for r in fam.truth_rows(a, lo, hi, cate=8).collect()] == [1, 1]


def test_restriction_keeps_every_key(spark):
    from shopcast.operators.joins import fan_out_counts, semi_restrict
    rows, keep = spark.range(100).withColumnRenamed("id", "user_id"), spark.range(60).withColumnRenamed("id", "user_id")
    assert semi_restrict(rows, keep, bound=10).count() == 60     # a wrong bound loses no key
    left = spark.createDataFrame([(1,), (1,), (2,)], "user_id long")
    right = spark.createDataFrame([(1,), (1,), (1,)], "user_id long")
    assert sorted(tuple(r) for r in fan_out_counts(left, right).collect()) == [(1, 6), (2, 1)]


def test_materialize_reuses_a_complete_write(spark):
    import uuid
    from shopcast.sources.files import feature_path, materialize
    run = uuid.uuid4().hex
    a = materialize(spark.range(5).toDF("x"), "reuse", run=run)
    b = materialize(spark.range(9).toDF("x"), "reuse", run=run)      # same key: the first write is read
    c = materialize(spark.range(9).toDF("x"), "reuse", run=run, other=1)
    assert a.count() == b.count() == 5 and c.count() == 9
    assert feature_path(spark, "reuse", run=run) != feature_path(spark, "reuse", run=run, other=1)


def test_landed_log_prunes_partitions(spark, tmp_path):
    from shopcast.sources.files import category_slice, land_actions
    land_actions(actions_df(spark, [(1, 1, "2016-04-11 10:00:00", 4, 8), (2, 2, "2016-04-11 10:00:00", 4, 9)]), str(tmp_path / "log"))
    got = category_slice(spark.read.parquet(str(tmp_path / "log")))
    assert [r.user_id for r in got.collect()] == [1]
    assert "PartitionFilters: [isnotnull(cate" in got._jdf.queryExecution().executedPlan().toString()


def test_checkpoint_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace
    from shopcast.session import checkpoint_dir
    there = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None),
                            sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(there)


def test_relative_order_over_many_ranges_equals_counting(spark, monkeypatch):
    monkeypatch.setattr(wn, "RANGES", 5)
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 50 != 0, F.col("id") * 37 % 83).alias("v"))
    values = [r.v for r in df.collect()]
    for r in wn.relative_order(df, "v").collect():
        want = len(values) - 1 if r.v is None else sum(x is not None and x >= r.v for x in values) - 1
        assert r.order == want
