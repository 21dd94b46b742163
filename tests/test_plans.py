"""Physical plans: where data is shuffled, what is read, and that no rows go through Python."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hexcadence.plans import forecast

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_table_shuffles_cells_once_after_counting(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    plan = plan_of(forecast.feature_table(events, "user_id", "ts", "weekly", target="n"))
    by_cell = re.findall(r"Exchange hashpartitioning\(user_id#\d+L, \d+\)", plan)
    assert len(by_cell) == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_what_is_needed(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").where(F.col("value") > 10)
    plan = plan_of(forecast.feature_table(events, "user_id", "ts", "weekly", target="n"))
    assert "GreaterThan(value,10" in plan
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("props" not in s and "event_type" not in s for s in schemas)


@pytest.mark.parametrize("name", ["top_values", "rare_values", "coordinate_samples"])
def test_top_n_is_cut_inside_the_tasks(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["top_rows", "random_sample", "datetime_candidates"])
def test_limits_keep_a_heap_and_do_not_sort_everything(spark, name):
    assert "TakeOrderedAndProject" in plan_of(entry.queries()[name](spark, SF))


LAZY = sorted(
    set(entry.queries())
    - {
        # Building these runs jobs (checkpoints, model training, files); they are looked at in the other tests.
        "logistic_forecast",
        "boosted_forecast",
        "logistic_coefficients",
        "tree_importance",
        "permutation_importance",
        "stacked_models",
        "threshold_refit",
        "pca_components",
        "pca_feature_scores",
        "forecast_evaluation",
        "spatial_clusters",
        "csv_folder_scan",
    }
)


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_product_in_the_plan(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
