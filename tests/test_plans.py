"""Plans that must hold at scale, checked on the registered queries."""

import re

import pytest

import __spark_entry__ as spark_entry
from checks import tables as t
from faultline.plans.features import feature_dataset, feature_dataset_periods
from faultline.plans.mtbf import mtbf

SMALL = "/root/testdata/sf0.001"
JOBS = [
    "mtbf", "mtbf_periods", "burst_table", "feature_dataset", "feature_dataset_periods",
    "feature_dataset_rolling", "win_lag_by_key", "win_lag_global", "win_burst_id",
    "temporal_split", "downsample_negatives", "eval_roc_auc", "eval_threshold_curve",
    "next_hour_label_rolling", "seasonal_decompose", "heatmap_day_hour", "log_intensity",
]


def plan_of(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOBS)
def test_no_python_rows_and_no_pairs(spark, name):
    plan = plan_of(spark_entry.queries()[name](spark, SMALL))
    for operator in ("Python", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan, operator


def scans(plan):
    """Scans that run; a reused exchange repeats none."""
    return len(re.findall(r"FileScan parquet", plan))


def test_features_read_once_and_never_join(spark):
    logs = t.typed(spark, SMALL)
    for table in (
        feature_dataset(logs, 2024, 1, 3600),
        feature_dataset_periods(logs, (2024, 1), (2024, 1), [300, 10800], "rolling"),
    ):
        plan = plan_of(table)
        assert scans(plan) == 1 and "Join" not in plan and "Window [" not in plan
        assert plan.count("partial_count") >= 1


def test_mtbf_reads_once(spark):
    table = mtbf(t.errors(spark, SMALL))
    table.collect()
    final = plan_of(table).split("Initial Plan")[0]
    assert scans(final) == 1 and "ReusedExchange" in final
    assert "Exchange SinglePartition" not in final
    windows = re.findall(r"Window \[.*?windowspecdefinition\((.*?)\)", final)
    assert windows and all("cpu_info" in window for window in windows)


def test_unused_fields_are_not_extracted(spark):
    plan = plan_of(mtbf(t.errors(spark, SMALL)))
    assert "ChannelAddress" not in plan and "syndrome" not in plan


def test_columns_are_pruned(spark):
    plan = plan_of(feature_dataset(t.typed(spark, SMALL), 2024, 1, 3600))
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "event_id" not in schema and "exact_ts" not in schema
    assert "PartitionFilters: [isnotnull(year" in plan
