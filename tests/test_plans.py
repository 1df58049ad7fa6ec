"""Physical-plan properties that matter at scale."""

import re

from conftest import SF_SMALL
from shopcast.operators.cube import activity_cube
from shopcast.sources.adapters import load_a, load_b


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_predicates_reach_parquet_scans(spark):
    for loader, col in ((load_a, "ts"), (load_b, "l_shipdate")):
        d = loader(spark, SF_SMALL)
        D = d["dates"]
        plan = _plan(activity_cube(d["actions"], D.end, D.acc_start))
        pushed = " ".join(re.findall(r"PushedFilters: (.*?), ReadSchema", plan))
        assert f"LessThan({col}" in pushed and f"GreaterThanOrEqual({col}" in pushed


def test_events_scan_prunes_unused_columns(spark):
    d = load_a(spark, SF_SMALL)
    D = d["dates"]
    plan = _plan(activity_cube(d["actions"], D.end, D.acc_start))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)
    assert "value" not in schema


def test_dataset_plans_have_no_python_udfs_or_cartesian_joins(spark):
    from shopcast.plans.ui_dataset import user_sku_dataset
    from shopcast.plans.user_dataset import user_dataset
    from shopcast.plans.wide_user import user_dataset_wide
    d = load_a(spark, SF_SMALL)
    for df in (user_sku_dataset(d), user_dataset(d), user_dataset_wide(d)):
        plan = _plan(df)
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, bad


def test_dataset_plans_have_few_joins(spark):
    from shopcast.plans.ui_dataset import user_sku_dataset
    from shopcast.plans.user_dataset import user_dataset
    from shopcast.plans.wide_user import user_dataset_wide
    d = load_a(spark, SF_SMALL)
    for build, most, columns in ((user_sku_dataset, 8, 661), (user_dataset, 8, 208), (user_dataset_wide, 6, 488)):
        df = build(d)
        joins = len(re.findall(r"\bJoin (?:LeftOuter|Inner)", df._jdf.queryExecution().optimizedPlan().toString()))
        assert joins <= most, (build.__name__, joins)
        assert len(df.columns) == columns
