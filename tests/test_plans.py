"""Properties of the physical plans."""

import re

import pytest

import __spark_entry__ as entry
from clickweave.plans.catalog import all_queries

SF_DIR = "/root/testdata/sf0.001"
# These run a stream or write tables first; their result is a plain read.
BATCH = sorted(n for n in all_queries() if not n.endswith("_stream") and not n.startswith(("stored_", "raw_to_", "ingest_two_logs_", "requests_to_", "ensured_")))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_plan(spark, name):
    """No Python and no products. Every window is partitioned, but for the one over the
    time axis, which sees a few sums per hour; and the ordinary branch never sees a hot
    key."""
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    windows = re.findall(r"\bWindow \[.*\], \[(.*?)\], \[(.*?)\]\s*$", plan, re.M)
    for keys, order in windows:
        assert keys or "__chunk" in order, order
    if any(keys and "__chunk" not in keys + order for keys, order in windows):
        assert "LeftAnti" in plan and "LeftSemi" in plan


def test_scan_is_pruned_and_filtered(spark):
    plan = plan_of(entry.queries()["site_ctr"](spark, SF_DIR))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,view))]" in plan
    orders = plan_of(entry.queries()["current_deployment"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in orders and "o_totalprice" not in orders


def test_window_metrics_take_one_exchange_per_table(spark):
    plan = plan_of(entry.queries()["page_window_metrics"](spark, SF_DIR))
    assert plan.count("hashpartitioning") == 1 and "Expand" not in plan
