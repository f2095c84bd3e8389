"""How many rows steps shuffle, from the metrics of the executed plans."""

from __future__ import annotations

import pytest

from traceloom.operators import overlap_join, overlap_totals
from traceloom.plans import timeline


@pytest.fixture
def without_broadcast(spark):
    """Small tables are joined as large ones are."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def shuffled_rows(df):
    """Rows of ``df``, and how many were written to shuffles for them."""
    rows = [tuple(r) for r in df.collect()]
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += plan.metrics().apply("shuffleRecordsWritten").value()
            children = plan.children()
            plans += [children.apply(i) for i in range(children.size())]
    return rows, total


def test_overlap_join_copies_points_for_intervals_of_their_group_only(spark, without_broadcast):
    a = spark.createDataFrame([(1, 10, 10 + 4**i) for i in range(12)], "g long, sa long, ea long")
    b = spark.createDataFrame([(i % 40, i, i + 1, i) for i in range(2000)], "g long, sb long, eb long, ib long")
    found, shuffled = shuffled_rows(overlap_join(a, b, a_interval=("sa", "ea"), b_interval=("sb", "eb"), keys=["g"]))
    want = [(i, 10 + 4**j) for i in range(2000) for j in range(12) if i % 40 == 1 and i + 1 > 10 and i < 10 + 4**j]
    assert sorted((r[5], r[2]) for r in found) == sorted(want)
    assert shuffled < 4 * 2012


def test_overlap_totals_leave_groups_without_intervals_out_of_the_sweep(spark, without_broadcast):
    a = spark.createDataFrame([(i % 40, i, i, i + 2) for i in range(2000)], "g long, id long, sa long, ea long")
    b = spark.createDataFrame([(1, 0, 1000)], "g long, sb long, eb long")
    totals = overlap_totals(a, b, a_id="id", a_interval=("sa", "ea"), b_interval=("sb", "eb"), keys=["g"], rows_per_slice=50)
    want = [(i % 40, i, int(i % 40 == 1 and i < 1000), 2 * int(i % 40 == 1 and i < 1000)) for i in range(2000)]
    found, shuffled = shuffled_rows(totals)
    assert sorted(found, key=lambda r: r[1]) == want
    assert shuffled < 3 * 2000


def test_whole_traces_look_up_no_ancestors(spark, monkeypatch):
    names = ["__x64_sys_a", *timeline.SYSCALL_SHAPE]
    frames = [(4 * n + i, 4 * n + i + 1 if i < 3 else 0, n - i, n + i, name) for n in range(1, 50) for i, name in enumerate(names)]
    named = spark.createDataFrame(
        [(0, 0, 0, 0, None), *frames], "id long, parent_id long, call_time long, return_time long, symbol string"
    )
    monkeypatch.setattr(timeline, "nearest_marked", None)
    found = timeline.syscalls_of(timeline.marked_frames(named, None))
    assert sorted(tuple(r) for r in found.collect()) == [(n - 3, n + 3, "__x64_sys_a", 4 * n) for n in range(1, 50)]
