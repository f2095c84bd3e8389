"""Stacks, switches, overflows, gaps and distributions on small tables."""

import pytest
from pyspark.sql import functions as F

from traceloom.operators import asof_join
from traceloom.plans import distribution, gaps, overlays, timeline
from traceloom.plans.ranges import View

NAMES = ["unknown", "__x64_sys_read", "x64_sys_call", "do_syscall_64", "entry_SYSCALL_64", "leaf"]


@pytest.fixture(scope="module")
def dims(spark):
    symbols = spark.createDataFrame([(i, 1, n) for i, n in enumerate(NAMES)], "id int, dso_id long, name string")
    paths = symbols.select(F.col("id").alias("id"), F.col("id").cast("long").alias("symbol_id"))
    dsos = spark.createDataFrame([(1, timeline.KERNEL)], "id int, short_name string")
    return paths, symbols, dsos


def make_calls(spark, rows):
    """Rows of (id, parent, path, call_time, return_time)."""
    data = [(0, 0, 0, 0, 0), *rows]
    return spark.createDataFrame(
        data, "id long, parent_id long, call_path_id long, call_time long, return_time long"
    )


def stack(base, start, end, names=(1, 2, 3, 4)):
    """Nested frames, innermost first; each caller begins one earlier and ends one later."""
    out = []
    for i, name in enumerate(names):
        parent = base + i + 1 if i + 1 < len(names) else 0
        out.append((base + i, parent, name, start - i, end + i))
    return out


def syscalls(spark, dims, calls, view):
    df = timeline.full_syscalls(timeline.stacks(calls, *dims), view)
    return sorted((r.call_id, r.call_time, r.return_time, r.syscall_kernel_name) for r in df.collect())


def test_full_syscalls(spark, dims):
    wrong_order = stack(20, 200, 220, (1, 3, 2, 4))
    calls = make_calls(spark, stack(10, 100, 120) + wrong_order)
    expected = [(10, 97, 123, "__x64_sys_read")]
    assert syscalls(spark, dims, calls, None) == expected
    assert syscalls(spark, dims, calls, View(90, 300)) == expected
    assert syscalls(spark, dims, calls, View(500, 600)) == []


def test_frame_enclosing_the_view_breaks_the_shape(spark, dims):
    # The outermost frame has no end in the view, so the shape in view is one frame short.
    calls = make_calls(spark, stack(10, 100, 120))
    assert syscalls(spark, dims, calls, View(98, 122)) == []
    assert syscalls(spark, dims, calls, View(97, 122)) != []


def test_calls_near_the_view_give_the_same_syscalls(spark, dims):
    rows = []
    for i in range(1, 40):
        rows += stack(i * 10, i * 100, i * 100 + 60)
        rows.append((i * 10 + 5, i * 10, 5, i * 100 + 1, i * 100 + 2))
    calls = make_calls(spark, rows)
    for view in (View(1000, 2050), View(1059, 1062), View(1, 5)):
        near = timeline.calls_near(calls, view)
        assert near.count() < calls.count()
        assert syscalls(spark, dims, near, view) == syscalls(spark, dims, calls, view)


def test_calls_near_keeps_open_calls_and_callees_that_outlive_their_callers(spark, dims):
    rows = stack(10, 100, 120) + stack(20, 200, 220) + stack(30, 900, 920)
    rows = [(i, p, n, a, None if i in (10, 20) else b) for i, p, n, a, b in rows]
    rows.append((15, 10, 5, 50, 5000))  # called before and returning after all of its callers
    rows.append((16, 15, 5, 5000, None))
    calls = make_calls(spark, rows)
    whole = timeline.stacks(calls, *dims)
    for view in (View(90, 130), View(121, 123)):
        near = timeline.stacks(timeline.calls_near(calls, view), *dims)
        want, got = (sorted(map(repr, timeline.stack_summary(c, view).collect())) for c in (whole, near))
        assert got == want
    assert timeline.calls_near(calls, View(0, 1)).count() == calls.count()
    assert {r.id for r in timeline.calls_near(calls, View(121, 123)).collect()} == {10, 11, 12, 13, 15, 16}
    looped = calls.unionByName(calls.limit(1).selectExpr("77L", "77L", "5L", "1L", "2L").toDF(*calls.columns))
    with pytest.raises(ValueError):
        timeline.calls_near(looped, View(90, 130))


def test_last_stretch_on_a_cpu_is_open(spark):
    switches = spark.createDataFrame(
        [(1, 0, 10, 7), (2, 0, 50, 8), (3, 1, 20, 7)], "id long, cpu int, time long, thread_in_id long"
    )
    stretches = overlays.on_cpu_stretches(switches).collect()
    assert {(r.cpu, r.switch_in, r.switch_out) for r in stretches} == {(0, 10, 50), (0, 50, None), (1, 20, None)}
    calls = spark.createDataFrame(
        [(7, 1, 0, 15), (8, 2, 60, 90), (7, 3, 30, 400)], "thread_id long, id long, call_time long, return_time long"
    )
    got = {(r.call_id, r.cpu, r.overlap_start, r.overlap_end) for r in overlays.thread_on_cpu_calls(switches, calls).collect()}
    assert got == {(1, 0, 10, 15), (2, 0, 60, 90), (3, 0, 30, 50), (3, 1, 30, 400)}


def test_only_the_covering_range_of_a_tie_is_emptied(spark):
    # Ranges 2 and 3 end at the same cycle; only 2 covers the overflow.
    ranges = spark.createDataFrame(
        [(1, None, 10, 5, 5, 5, 5), (2, 10, 20, 9, 4, 4, 4), (3, 20, 30, 9, 0, 3, 0)],
        "end_sample_id long, start_time long, end_time long, end_cum_cyc long, cyc_count long, insn_count long, start_cum_cyc long",
    ).withColumn("branch_type_name", F.lit("call"))
    errors = spark.createDataFrame([(15, "Overflow packet")], "time long, msg string")
    got = {r.end_sample_id: (r.is_gap, r.insn_count) for r in overlays.zero_fill_gaps(ranges, errors).collect()}
    assert got == {1: (False, 5), 2: (True, 0), 3: (False, 3)}


def test_on_cpu_and_violations(spark):
    view = View(0, 1000)
    switches = spark.createDataFrame([(50,), (700,), (None,)], "smio_call_time long")
    calls = spark.createDataFrame(
        [(10, 100, "__a", 1), (200, 300, "b", 2)],
        "call_time long, return_time long, syscall_kernel_name string, call_id long",
    )
    on_cpu = timeline.on_cpu_syscalls(switches, calls, view)
    got = sorted((r.starts_time, r.starts_call_id, r.ends_time, r.ends_call_id) for r in on_cpu.collect())
    # The call is switched out at 50 and resumed at 50; the second runs through.
    assert got == [(10, 1, 50, None), (50, None, 100, 1), (200, 2, 300, 2)]
    assert timeline.on_cpu_violations(on_cpu, view).count() == 0
    labels = timeline.spans_by_label(timeline.on_cpu_labels(on_cpu, view)).collect()
    assert {(r.label, r.spans, r.total_duration) for r in labels} == {("a", 2, 90), ("b", 1, 100)}
    mixed = calls.unionByName(calls.selectExpr("400L", "450L", "'c'", "3L").toDF(*calls.columns)).withColumn(
        "return_time", F.when(F.col("call_id") == 2, 420).otherwise(F.col("return_time")).cast("long")
    )
    assert timeline.on_cpu_violations(timeline.on_cpu_syscalls(switches, mixed, view), view).count() > 0


def test_errors_outside_all_ranges(spark):
    ranges = spark.createDataFrame(
        [(None, 10, None, 5, 5, 1), (10, 20, 5, 9, 4, 2)],
        "start_time long, end_time long, start_cum_cyc long, end_cum_cyc long, cyc_count long, end_sample_id long",
    )
    errors = spark.createDataFrame(
        [(1, "Overflow packet"), (10, "Overflow packet"), (25, "Overflow packet"), (12, "other")],
        "time long, msg string",
    )
    covered = timeline.errors_and_ranges(errors, ranges)
    got = {r.time: (r.start_time, r.end_time, r.duration_ns) for r in covered.collect()}
    assert got == {1: (None, 10, None), 10: (10, 20, 10), 25: (None, None, None)}
    assert timeline.overflow_in_view(covered, View(12, 15)).count() == 1


def test_filter_after_asof_join_stays_after_it(spark):
    left = spark.createDataFrame([(1, 1), (2, 5)], "n long, k long")
    right = spark.createDataFrame([(3, 1), (6, 2)], "k long, id long")
    joined = asof_join(left, right, left_on="k", right_on="k", right_id="id", columns={"hit": "id"})
    assert [tuple(r) for r in joined.filter("hit = 2").select("n", "hit").collect()] == [(2, 2)]


def test_gaps(spark):
    samples = spark.createDataFrame(
        [(1, 10, "call", 1, 1), (2, 20, "trace begin", 0, 0), (3, 30, "call", 2, 2), (4, 30, "return", 0, 3),
         (5, 40, "trace begin", 1, 1), (6, 50, "call", 1, 1)],
        "id long, time long, branch_type_name string, insn_count long, cyc_count long",
    )
    errors = spark.createDataFrame(
        [(0, 20, 7, "m"), (1, 5, 7, "m"), (2, 35, 7, "m"), (3, None, 7, "m")], "id long, time long, code int, msg string"
    )
    got = {}
    for r in gaps.error_gaps(errors, samples, rows_per_slice=2).collect():
        got.setdefault(r.id, set()).add(
            (r.prev_sample_time, r.matching_sample_time, r.next_sample_time, r.next_sample_id)
        )
    assert got == {
        0: {(10, 20, 30, 3), (10, 20, 30, 4)},
        1: {(None, None, 10, 1)},
        2: {(30, None, 40, 5)},
        3: {(None, None, None, None)},
    }
    odd = gaps.errors_begin_one_to_one(errors, samples).collect()
    assert {(r.err_id, r.sample_id) for r in odd} == {(1, None), (2, None), (3, None), (None, 5)}
    free = gaps.error_free_ranges(samples, rows_per_slice=2).collect()
    assert {(r.start_time, r.end_time, r.duration, r.start_id, r.end_id) for r in free} == {
        (10, 10, 0, 1, 1),
        (20, 30, 10, None, 4),
        (40, None, None, 5, None),
    }
    top = gaps.top_error_free_ranges(gaps.error_free_ranges(samples), 1).collect()
    assert [r.duration for r in top] == [10]


def test_distribution(spark):
    rows = [(10, 1000, "call"), (1, 5, "call"), (30, 5, "return"), (2, 7, "call"), (9, 9, None), (9, 99, "trace begin")]
    ranges = spark.createDataFrame(rows, "insn_count long, cyc_count long, branch_type_name string")
    kept = sorted((r.cyc_count, r.cum_cycles) for r in distribution.samples_for_cdf(ranges, 0.99).collect())
    assert kept == [(5, 1017), (5, 1017), (7, 1007)]
    whole = distribution.range_cdf(ranges, 0.0, width=3).orderBy("cyc_count").collect()
    assert [r.cyc_count for r in whole] == [5, 7, 1000]
    assert [r.cdf for r in whole] == [0.5, 0.75, 1.0]
    assert whole[-1].weighted_cdf == 1.0
    first = whole[0]
    assert (first.perc_insns_1_stacked, first.perc_insns_20_stacked, first.perc_insns_100_stacked) == (0.5, 0.0, 0.5)
    shares = distribution.insn_class_share(ranges, 0.0, tail=0.6).orderBy("cyc_count").collect()
    assert [r.cyc_count for r in shares] == [7, 1000]
    assert sum(r.weighted_insn_count_0 for r in shares) == pytest.approx(1007 / 1017)


def test_latency_and_transitions(spark):
    calls = spark.createDataFrame(
        [(1, 100, "r"), (2, 150, "r"), (3, 160, "w"), (4, 150, "r")],
        "call_id long, return_time long, syscall_kernel_name string",
    )
    got = timeline.iteration_latency(calls, ["r"], rows_per_slice=1).collect()
    assert sorted(r.latency_ns for r in got) == [0, 50]
    samples = spark.createDataFrame(
        [(1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (4, 1, "a"), (5, 2, "b"), (6, 1, "b")],
        "id long, thread_id long, kind string",
    )
    counts = overlays.transition_counts(samples, "kind", at_least=2).collect()
    assert [(r.from_state, r.to_state, r.transitions) for r in counts] == [("a", "b", 3)]


def test_folded_stacks(spark, dims):
    calls = make_calls(spark, stack(10, 100, 120))
    got = {r.path: r.self_time for r in overlays.folded_stacks(timeline.calls_with_symbols(calls, *dims)).collect()}
    full = "entry_SYSCALL_64;do_syscall_64;x64_sys_call;__x64_sys_read"
    assert got[full] == 20 and got["entry_SYSCALL_64"] == 2
    assert sum(got.values()) == 26
