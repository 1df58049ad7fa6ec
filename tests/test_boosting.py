"""Second-order boosting: leaf values by hand, child weights, gaps, column draws, patience, split counts."""

import math

import pytest
from pyspark.sql import functions as F

from shopcast.operators import boosting as bo
from shopcast.operators import evaluate as ev

sigmoid = lambda m: 1 / (1 + math.exp(-m))


def frame(spark, rows, names):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "id long, " + ", ".join(f"{c} double" for c in names))


def test_two_rounds_by_hand(spark):
    """x <= 0.5 has labels 0, 0, 1; above: 1, 1, 1, 0.  Both rounds split there; rows of class 1 weigh 2."""
    rows = [(0.0, 0.0), (0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    model = bo.fit_boosted(frame(spark, rows, ["x", "label"]), ["x"], rounds=2, depth=3, rate=0.5, min_child_weight=0.1,
                           l2=1.0, pos_weight=2.0)
    margin = {0.0: 0.0, 1.0: 0.0}
    for _ in range(2):
        step = {}
        for side in margin:
            p = sigmoid(margin[side])
            mine = [(y, 2.0 if y else 1.0) for x, y in rows if x == side]
            g, h = sum(w * (p - y) for y, w in mine), sum(w * p * (1 - p) for _, w in mine)
            step[side] = -g / (h + 1.0)
        margin = {s: m + 0.5 * step[s] for s, m in margin.items()}
    # round one at margin 0: left −G/(H+1) = 0/2, right = (3 − 0.5)/(1.75 + 1)
    assert model.values[0] == pytest.approx([0.0, 0.5 * 2.5 / 2.75])
    for r in model.predict(frame(spark, rows, ["x", "label"])).collect():
        assert r.prob == pytest.approx(sigmoid(margin[r.x]), abs=1e-12)


def test_least_hessian_sum_of_a_node(spark):
    """At margin 0 a row's hessian is 1/4: ten rows of x = 1 weigh 2.5."""
    rows = [(0.0, 0.0)] * 30 + [(1.0, 1.0)] * 10
    df = frame(spark, rows, ["x", "label"])
    small = bo.fit_boosted(df, ["x"], rounds=1, min_child_weight=2.4)
    large = bo.fit_boosted(df, ["x"], rounds=1, min_child_weight=2.6)
    none = bo.fit_boosted(df, ["x"], rounds=1, min_child_weight=6.0)     # two such nodes outweigh the table
    assert [len(m.values[0]) for m in (small, large, none)] == [2, 1, 1]
    assert large.values[0] == pytest.approx([0.1 * (10 - 20) / 11])


def test_gaps_go_to_the_side_that_fits(spark):
    """Gaps behave like high values of x and like low values of y."""
    rows = [(float(i), float(i), 1.0 if i >= 10 else 0.0) for i in range(20)]
    rows += [(None, 0.0 + i, 1.0) for i in range(12)] + [(15.0, None, 1.0)] * 2
    rows += [(1.0 + i % 3, None, 0.0) for i in range(9)]
    df = frame(spark, rows, ["x", "y", "label"])
    model = bo.fit_boosted(df, ["x"], rounds=1, depth=1, min_child_weight=0.5)
    assert model.features.two_sided == ("x",)
    got = {(r.x, r.prob) for r in model.predict(df).select("x", "prob").collect()}
    high = {p for x, p in got if x is not None and x >= 10}
    assert len(high) == 1 and {p for x, p in got if x is None} == high
    assert all(p < min(high) for x, p in got if x is not None and x < 10)
    low = bo.fit_boosted(df.where("x < 10 OR x IS NULL OR x > 14").withColumn("label", F.when(F.col("y").isNull(), 0.0).when(
        F.col("y") >= 3, 1.0).otherwise(0.0)), ["y"], rounds=1, depth=1, min_child_weight=0.5)
    got = {(r.y, r.prob) for r in low.predict(df).select("y", "prob").collect()}
    assert {p for y, p in got if y is None} == {p for y, p in got if y is not None and y < 3}


def test_values_without_gaps_in_training_and_infinite_ones(spark):
    rows = [(float(i), 1.0 if i > 4 else 0.0) for i in range(10)] + [(math.inf, 1.0), (-math.inf, 0.0)]
    df = frame(spark, rows, ["x", "label"])
    model = bo.fit_boosted(df, ["x"], rounds=2, min_child_weight=0.1)
    got = {r.x: r.prob for r in model.predict(df.unionByName(frame(spark, [(None, 0.0)], ["x", "label"]))).collect()}
    assert got[math.inf] == got[9.0] and got[-math.inf] == got[0.0] == got[None]


@pytest.fixture(scope="module")
def noisy(spark):
    """Three of nine features matter."""
    h = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(100)).cast("double")
    df = spark.range(600).select("id", *[h(k).alias(f"f{k}") for k in range(9)])
    return df.withColumn("label", (F.col("f1") + F.col("f2") + F.col("f7") + h(11) > 200).cast("int")).cache()


NINE = [f"f{k}" for k in range(9)]


def test_trees_split_on_their_own_draw_only(spark, noisy):
    model = bo.fit_boosted(noisy, NINE, rounds=6, depth=4, columns=0.4, seed=3)
    assert all(len(d) == 3 for d in model.draws) and len(set(model.draws)) > 1
    for tree, drawn in zip(model.trees, model.draws, strict=True):
        importance = tree.featureImportances.toArray()
        assert {c for c, v in zip(NINE, importance, strict=True) if v > 0} <= drawn
    assert bo.Features(tuple(NINE)).drawn(0.4, 3, 0) == model.draws[0]


def test_split_counts_are_those_of_the_trees(spark, noisy):
    import re
    model = bo.fit_boosted(noisy, [*NINE], rounds=4, depth=3)
    want = dict.fromkeys(NINE, 0)
    for tree in model.trees:
        for k in re.findall(r"If \(feature (\d+) <=", tree.toDebugString):
            want[NINE[int(k)]] += 1
    got = {r.feature: r.splits for r in model.split_counts(spark).collect()}
    assert got == want and sum(got.values()) > 4


def test_the_best_round_after_a_pause():
    aucs = [0.6, 0.7, 0.7, 0.69, 0.7, 0.71, 0.7, 0.7, 0.7]
    assert bo.best_round(aucs, 2) == (2, True)          # the pause is longer than the patience
    assert bo.best_round(aucs, 4) == (6, False)         # it is waited out; three rounds after the best are too few
    assert bo.best_round(aucs, 3) == (2, True)
    assert bo.best_round(aucs, None) == (6, False)


def test_improvement_pauses_and_resumes(spark, noisy, monkeypatch):
    """Rounds whose draw holds no feature that matters bring nothing; the fit waits for those that do."""
    monkeypatch.setattr(bo, "CHUNK", 4)
    held = F.pmod(F.xxhash64(F.col("id"), F.lit(99)), F.lit(4)) == 0
    fit = lambda patience: bo.fit_boosted(noisy, NINE, rounds=16, depth=2, rate=0.3, columns=0.12, validation=held,
                                          patience=patience, seed=4)
    long = fit(12)
    assert len(long.trees) == bo.best_round(long.aucs, 12)[0] and long.rounds_run <= 16
    rising = [i for i in range(1, len(long.aucs)) if long.aucs[i] > max(long.aucs[:i])]
    pause = max(b - a for a, b in zip([0, *rising], rising, strict=False)) - 1
    assert pause >= 1                                    # it did pause and resume
    short = fit(pause)
    assert short.rounds_run < long.rounds_run and len(short.trees) < len(long.trees)
    assert short.aucs == pytest.approx(long.aucs[:len(short.aucs)])


def test_validation_auc_equals_the_models(spark, noisy):
    held = F.col("id") % 5 == 0
    model = bo.fit_boosted(noisy, NINE, rounds=5, validation=held, patience=5)
    scored = model.predict(noisy.where(held)).withColumn("g", F.lit(1))
    got = ev.auc_by(scored, ["g"], F.col("prob"), F.col("label") == 1).first()
    assert got.auc == pytest.approx(max(model.aucs))


def test_auc_equals_counting_pairs(spark, monkeypatch):
    monkeypatch.setattr(ev, "AUC_RANGES", 5)
    df = spark.range(400).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(37)).cast("double").alias("s"),
                                 (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) < 2).alias("y"))
    df = df.unionByName(spark.createDataFrame([(9, 1.0, True), (9, None, False)], "g long, s double, y boolean"))
    rows = df.collect()
    for r in ev.auc_by(df, ["g"], F.col("s"), F.col("y")).collect():
        pos = [x.s for x in rows if x.g == r.g and x.y and x.s is not None]
        neg = [x.s for x in rows if x.g == r.g and not x.y and x.s is not None]
        won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert (r.positives, r.negatives) == (len(pos), len(neg))
        assert r.auc == (pytest.approx(won / len(pos) / len(neg)) if pos and neg else None)


def test_one_class_and_no_rows(spark):
    one = frame(spark, [(float(i), 0.0) for i in range(8)], ["x", "label"])
    model = bo.fit_boosted(one, ["x"], rounds=9, validation=F.col("id") % 2 == 0, patience=3)
    assert len(model.trees) == 1 and model.rounds_run == 4
    empty = bo.fit_boosted(one.limit(0), ["x"], rounds=3)
    assert [r.prob for r in empty.predict(one).collect()] == [0.5] * 8
    assert empty.split_counts(spark).collect() == [("x", 0)]


def test_same_seed_gives_the_same_scores_and_no_copies_stay(spark, noisy):
    import os

    from shopcast.session import checkpoint_dir
    staged = os.path.join(checkpoint_dir(spark), "staged")
    before = set(os.listdir(staged)) if os.path.isdir(staged) else set()
    a, b = (bo.fit_boosted(noisy, NINE, rounds=12, depth=2, columns=0.8) for _ in range(2))
    assert a.values == b.values and a.draws == b.draws
    assert {n for n in os.listdir(staged) if n.startswith("boosting")} <= before


def test_sums_by_shuffle_and_on_the_driver_give_the_same_trees(spark, noisy, monkeypatch):
    few = dict(rounds=3, depth=3, columns=0.8)
    a = bo.fit_boosted(noisy.repartition(3), NINE, **few)
    monkeypatch.setattr(bo, "DIRECT", 0)
    monkeypatch.setattr(bo, "PIECE", 2)
    b = bo.fit_boosted(noisy.repartition(3), NINE, **few)
    assert [t.place for t in a.trees] == [t.place for t in b.trees] and [t.threshold for t in a.trees] == [t.threshold for t in b.trees]
    for x, y in zip(a.values, b.values, strict=True):
        assert x == pytest.approx(y)


def test_models_side_by_side_equal_those_alone(spark, noisy):
    few = dict(rounds=12, depth=2, columns=0.8, validation=F.col("id") % 5 == 0, patience=3)
    subsets = [["f1", "f2"], ["f0", "f7", "f8"]]
    for subset, model in zip(subsets, bo.fit_all(noisy, NINE, subsets, **few), strict=True):
        alone = bo.fit_boosted(noisy, subset, **few)
        assert model.draws == alone.draws and model.rounds_run == alone.rounds_run
        assert [(t.place, t.threshold) for t in model.trees] == [(t.place, t.threshold) for t in alone.trees]


def test_more_values_than_bins_keep_at_most_255_candidates(spark):
    df = spark.range(3000).select("id", (F.col("id") * 1.0).alias("x"), (F.col("id") > 1999).cast("int").alias("label"))
    tree = bo.fit_boosted(df, ["x"], rounds=1, depth=1).trees[0]
    assert abs(tree.threshold[0] - 1999.5) < 3000 / 255 and max(tree.cut) < 255


def awkward(spark):
    """Gaps, a constant, many values, infinite ones; rows of class 1 are rare."""
    h = lambda k, m: F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(m)).cast("double")
    df = spark.range(900).select("id", h(0, 3).alias("a"), F.when(h(1, 4) > 0, h(2, 50)).alias("b"), F.lit(7.0).alias("c"),
                                 F.when(h(3, 90) == 0, F.lit(math.inf)).otherwise(h(4, 700)).alias("d"), h(5, 11).alias("e"))
    return df.withColumn("label", (F.col("a") * 10 + F.coalesce("b", F.lit(60.0)) + h(6, 20) > 70).cast("int"))


@pytest.mark.parametrize("options", [dict(rounds=25, depth=4, columns=0.6, rate=0.3, held=True, patience=6), dict(rounds=3, depth=3, pos_weight=4.0),
                                     dict(rounds=4, depth=2, min_child_weight=30.0, held=True), dict(rounds=2, depth=0)])
def test_one_task_grows_the_trees_that_passes_over_the_blocks_grow(spark, monkeypatch, options):
    names, held = list("abcde"), (F.col("id") % 4 == 0) if options.pop("held", False) else None
    df, subsets = awkward(spark).repartition(3).cache(), [names, ["b", "d"], ["c"]]
    monkeypatch.setattr(bo, "ENTRIES", 64)
    alone = bo.fit_all(df, names, subsets, validation=held, **options)
    monkeypatch.setattr(bo, "ALONE", 0)
    monkeypatch.setattr(bo, "_fit_alone", None)
    for x, y in zip(alone, bo.fit_all(df, names, subsets, validation=held, **options), strict=True):
        assert (x.features, x.draws, x.rounds_run) == (y.features, y.draws, y.rounds_run)
        assert [(t.place, t.cut, t.threshold, t.left, t.right) for t in x.trees] == [(t.place, t.cut, t.threshold, t.left, t.right) for t in y.trees]
        for a, b in zip(x.values, y.values, strict=True):
            assert a == pytest.approx(b)
        assert x.aucs == pytest.approx(y.aucs[:len(x.aucs)])


def test_jobs_of_a_fit_do_not_grow_with_its_rounds(spark, noisy):
    def jobs(rounds: int) -> int:
        spark.sparkContext.setJobGroup(f"fit-{rounds}", "")
        models = bo.fit_all(noisy, NINE, [NINE, NINE[:4]], rounds=rounds, depth=3, validation=F.col("id") % 5 == 0, patience=rounds)
        spark.sparkContext.setJobGroup("", "")
        assert [m.rounds_run for m in models] == [rounds] * 2
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{rounds}"))
    assert jobs(30) == jobs(3) > 0


def test_sums_of_entries_equal_direct_ones(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(3)
    bins = [1, 2, 7, 256, 3]
    codes = np.stack([rng.integers(0, b, 500).astype(np.uint8) for b in bins])
    codes[4] = np.where(rng.random(500) < 0.9, 1, codes[4])
    g, h = rng.normal(size=500), rng.random(500)
    parts = [np.arange(0, 500, 3), np.zeros(0, np.intp), np.array([499])]
    for most in (1, 100, 1 << 16):
        monkeypatch.setattr(bo, "ENTRIES", most)
        entries = bo._Entries(codes, bins)
        for got, rows in ((entries.root(g, h), [np.arange(500)]), (entries.sums(parts, g, h), parts)):
            assert got.shape == (2, len(rows), sum(bins) + 1) and not got[:, :, -1].any()
            for p, b in enumerate(bins):
                for n, at in enumerate(rows):
                    for i, x in enumerate((g, h)):
                        assert got[i, n, entries.first[p]:][:b] == pytest.approx(np.bincount(codes[p][at], x[at], b), abs=1e-12)


def test_auc_of_one_task_equals_the_tables(spark):
    import numpy as np
    rows = [(float(i * 7 % 23), float(i % 3 == 0) if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, s double, y double")
    want = ev.auc_by(df, ["g"], F.col("s"), F.col("y") == 1).first().auc
    score, y = (np.array([r[k] for r in rows], float) for k in (0, 1))
    assert bo._auc(score, y == 1) == want
    assert bo._auc(score, y > 5) == bo._auc(score, y != 5) == bo._auc(score[:0], y[:0] == 1) == 0.5
