"""Ranges, the sliding window and IPC on hand-built and random traces."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import WidthSlices
from traceloom.plans import ipc, overlays, ranges

FIELDS = "id long, time long, insn_count long, cyc_count long"


def ranges_of(spark, counts, **options):
    """Ranges from (instructions, cycles) pairs at times 10, 20, ..."""
    data = [(i + 1, (i + 1) * 10, insns, cyc) for i, (insns, cyc) in enumerate(counts)]
    samples = spark.createDataFrame(data, FIELDS)
    return ranges.stored_ranges(samples, slices=WidthSlices(3), **options)


def spans_of(spark, counts, size, **options):
    window = ipc.sliding_window(ranges_of(spark, counts), size, **options)
    return [r.asDict() for r in ipc.ipc_spans(window, size).orderBy("window_end_cum_cyc").collect()]


def test_ranges(spark):
    got = ranges_of(spark, [(4, 10), (0, 0), (6, 20), (5, 0)]).orderBy("end_sample_id").collect()
    assert [(r.start_sample_id, r.end_sample_id, r.start_cum_cyc, r.end_cum_cyc) for r in got] == [
        (None, 1, None, 10),
        (1, 3, 10, 30),
        (3, 4, 30, 30),
    ]
    assert [(r.start_offset_time, r.end_offset_time, r.end_cum_insns) for r in got] == [
        (None, 0, 4),
        (0, 20, 10),
        (20, 30, 15),
    ]
    assert [r.end_sample_row_number for r in got] == [1, 2, 3]


def test_interleaved_cpus_are_separate(spark):
    data = [(1, 10, 1, 5, 0), (2, 11, 2, 7, 1), (3, 20, 3, 5, 0), (4, 21, 4, 7, 1), (5, 30, 5, 5, None)]
    samples = spark.createDataFrame(data, FIELDS + ", cpu int")
    got = ranges.timestamped_ranges(samples, keys=["cpu"]).orderBy("end_sample_id").collect()
    assert [(r.cpu, r.start_sample_id, r.end_cum_cyc, r.end_offset_time) for r in got] == [
        (0, None, 5, 0),
        (1, None, 7, 0),
        (0, 1, 10, 10),
        (1, 2, 14, 10),
        (None, None, 5, 0),
    ]
    stored = ranges.stored_ranges(samples, keys=["cpu"])
    window = ipc.sliding_window(stored, 6, keys=["cpu"], rows_per_slice=2)
    apart = {
        cpu: sorted(
            r.window_end_cum_cyc
            for r in ipc.sliding_window(
                ranges.stored_ranges(samples.filter(F.col("cpu") == cpu)), 6
            ).collect()
        )
        for cpu in (0, 1)
    }
    for cpu in (0, 1):
        assert sorted(r.window_end_cum_cyc for r in window.filter(F.col("cpu") == cpu).collect()) == apart[cpu]


def test_uniform_trace_has_one_ipc(spark):
    got = spans_of(spark, [(5, 10)] * 12, 20)
    complete = [r for r in got if r["window_complete"]]
    assert complete
    assert {r["end_linear_interp_ipc"] for r in complete} == {0.5}
    # A window of two whole ranges: edges aligned with ranges leave no doubt.
    aligned = [r for r in complete if r["trailing_cyc_in_window"] == 10 or r["window_start_cum_cyc"] % 10 == 1]
    assert all(r["optimistic_ipc"] >= 0.5 >= r["conservative_ipc"] for r in aligned)


def test_range_longer_than_the_window(spark):
    got = spans_of(spark, [(1, 10), (50, 1000), (1, 10)], 20)
    inside = next(r for r in got if r["window_end_cum_cyc"] == 1010)
    assert inside["leading_insns"] == 0 and inside["interior_insns"] == 0
    assert inside["conservative_ipc"] == 0.0
    assert inside["optimistic_ipc"] == 50 / 20
    assert inside["end_linear_interp_ipc"] == 50 * (20 / 1000) / 20


def test_aliased_span_appears_once(spark):
    # With size 11 the window from the end of the first range ends exactly at the end of the second.
    stored = ranges_of(spark, [(1, 10)] * 4)
    window = ipc.sliding_window(stored, 11)
    aliased = window.filter("side = 'trailing' and is_span_aliased").count()
    assert aliased == 3
    spans = ipc.ipc_spans(window, 11).collect()
    ends = [r.window_end_cum_cyc for r in spans]
    assert len(ends) == len(set(ends)) == 4
    assert sorted(r.span_width_cyc for r in spans) == [0, 10, 10, 10]


def test_range_without_cycles_is_marked(spark):
    got = spans_of(spark, [(1, 10), (7, 0), (1, 10), (1, 10)], 15)
    assert any(r["end_linear_interp_ipc"] == ipc.UNDEFINED_IPC for r in got)


def brute_window(rows, size):
    """The definition: an as-of search per edge, the lowest id among equal ends."""
    out = []
    ordered = sorted(rows, key=lambda r: (r["end_cum_cyc"], r["end_sample_id"]))
    for own in rows:
        end = own["end_cum_cyc"]
        trail = next(r for r in ordered if r["end_cum_cyc"] > end - size)
        start = end - size + 1
        out.append(("leading", end, start, own, trail, start == trail["end_cum_cyc"]))
        lead = next((r for r in ordered if r["end_cum_cyc"] >= end + size - 1), None)
        if lead is not None:
            out.append(("trailing", end + size - 1, end, lead, own, end + size - 1 == lead["end_cum_cyc"]))
    return out


@pytest.mark.parametrize("rows_per_slice", [5, 1000])
@pytest.mark.parametrize("hot", [False, True])
def test_sliding_window_by_definition(spark, rows_per_slice, hot):
    rng = random.Random(11)
    counts = [(rng.randrange(1, 20), rng.choice([0, 1, 3, 9, 40])) for _ in range(80)]
    if hot:
        counts[30:30] = [(1, 0)] * 60
    stored = ranges_of(spark, counts)
    rows = [r.asDict() for r in stored.collect()]
    window = ipc.window_rows(ipc.sliding_window(stored, 25, rows_per_slice=rows_per_slice))
    got = sorted(
        (
            r.side,
            r.window_end_cum_cyc,
            r.window_start_cum_cyc,
            r.is_span_aliased,
            r.end_time,
            r.leading_end_cum_insns,
            r.trailing_end_cum_insns,
            r.leading_cyc_count,
            r.trailing_cyc_count,
        )
        for r in window.collect()
    )
    expected = sorted(
        (
            side,
            end,
            start,
            aliased,
            lead["end_time"],
            lead["end_cum_insns"],
            trail["end_cum_insns"],
            lead["cyc_count"],
            trail["cyc_count"],
        )
        for side, end, start, lead, trail, aliased in brute_window(rows, 25)
    )
    assert got == expected


def test_bounds_enclose_the_interpolated_ipc(spark):
    rng = random.Random(2)
    got = spans_of(spark, [(rng.randrange(40), rng.randrange(1, 60)) for _ in range(60)], 90, rows_per_slice=7)
    complete = [r for r in got if r["window_complete"]]
    assert len(complete) > 50
    for r in complete:
        assert r["conservative_ipc"] <= r["end_linear_interp_ipc"] + 1e-9
        assert r["end_linear_interp_ipc"] <= r["optimistic_ipc"] + 1e-9
    widths = sum(r["span_width_cyc"] for r in got)
    assert widths == got[-1]["window_end_cum_cyc"] - got[0]["window_end_cum_cyc"]


def test_view_and_clock(spark):
    stored = ranges_of(spark, [(1, 10)] * 10)
    samples = spark.createDataFrame([(i, i * 10, 1, 10) for i in range(1, 11)], FIELDS)
    view = ranges.middle_view(samples, 20)
    assert (view.start, view.end) == (55, 75)
    bounds = ranges.time_bounds(stored, view)
    assert sorted((r.ns, r.cyc) for r in bounds.collect()) == [(55, 60), (75, 80)]
    clock = ranges.CycleClock.from_bounds(bounds)
    assert clock.rate == 1.0
    assert stored.select(clock.time(F.lit(65)).alias("t")).first().t == 60.0
    empty = samples.filter("id < 0")
    with pytest.raises(ValueError):
        ranges.middle_view(empty)


def test_buckets_share_out_long_ranges(spark):
    stored = ranges_of(spark, [(10, 10), (20, 40)])
    got = {r.bucket: (r.cycles, r.insns) for r in overlays.ipc_buckets(stored, 20, 10).collect()}
    assert got == {0: (20, 15.0), 1: (20, 10.0), 2: (20, 10.0), 3: (20, 10.0), 4: (10, 5.0)}
    assert ranges.long_ranges(stored, 20).count() == 1
