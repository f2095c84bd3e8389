"""The registered queries: contract, results on the smallest tables, and the shape of their plans."""

import os
import re

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "trace_tables",
    "v_samples",
    "v_calls",
    "v_power_events",
    "timestamped_ranges",
    "ipc_spans",
    "ancestor_walk",
    "full_syscalls_near_view",
    "errors_and_ranges",
    "range_cdf",
    "log_histogram",
    "interval_overlap_join",
    "log_normalize_stream",
    "event_aligned_ipc",
    "trials_ipc_spans",
    "trials_full_syscalls",
    "publish_replace_recover",
    "ipc_spans_ordered",
    "log_normalize_files",
    "on_cpu_time",
]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, name):
    assert compare(spark, connect(SF), SF, name) == []


@needs_data
@pytest.mark.parametrize(
    "name", ["ipc_spans", "timestamped_ranges", "on_cpu_syscalls", "error_gaps", "range_cdf", "interval_overlap_join"]
)
def test_plans_stay_distributed(spark, name):
    plan = contract.queries()[name](spark, SF.replace("0.001", "0.01"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "Python" not in plan
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = next(text for text in lines[at + 1 :] if re.search(r"Aggregate|Scan|Window|Join", text))
            assert "Aggregate" in below, "rows reach one task without being aggregated first"


@needs_data
def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert "end_linear_interp_ipc" in df.columns
