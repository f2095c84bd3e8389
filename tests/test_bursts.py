"""Errors in bursts, and event-aligned averages against the pairs they replace."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from traceloom.plans import gaps, overlays


def test_errors_of_one_place_are_numbered_in_order_and_spread(spark):
    rows = [(7, 1, 3, ip) for ip in range(3000)] + [(t, t % 2, None, 0) for t in range(500)] + [(7, 1, 3, 5)] * 20
    errors = spark.createDataFrame(rows, "time long, cpu int, code int, ip long")
    numbered = gaps.number_errors(errors, rows_per_slice=100)
    first = sorted(tuple(r) for r in numbered.collect())
    assert [r[0] for r in first] == list(range(len(rows)))
    assert Counter(r[1:] for r in first) == Counter(rows)
    places = [(r[1], r[2], r[3] or 0) for r in first]
    assert places == sorted(places)
    assert first == sorted(tuple(r) for r in gaps.number_errors(errors.repartition(7), rows_per_slice=250).collect())


@pytest.mark.parametrize("before, after, step", [(20, 20, 5), (13, 7, 5), (0, 30, 30)])
def test_event_aligned_ipc_equals_pairs(spark, before, after, step):
    rng = random.Random(3)
    spans, events = [], []
    for cpu in (0, 1, None):
        now = 0
        for n in range(200):
            start = now + rng.choice([0, 0, 3, 40])
            now = start + rng.randint(0, 30)
            spans.append((cpu, n, start, now, rng.randint(0, 50), rng.randint(0, 90)))
        events += [(cpu, rng.randint(-50, now + 50)) for _ in range(60)] + [(cpu, 100)] * 30
    want = defaultdict(lambda: [0.0, 0.0])
    for cpu, _, start, end, insns, cycles in spans:
        for _, time in (e for e in events if e[0] == cpu and start < end):
            low, high = max(start, time - before), min(end, time + after)
            for at in range(low, high):
                found = want[(at - time) // step]
                found[0] += insns / (end - start)
                found[1] += cycles / (end - start)
    want = {k: v for k, v in want.items() if v[0] > 1e-9 or v[1] > 1e-9}
    got = overlays.event_aligned_ipc(
        spark.createDataFrame(
            spans, "cpu int, end_sample_id long, start_time long, end_time long, insn_count long, cyc_count long"
        ),
        spark.createDataFrame([*events, (0, None)], "cpu int, time long"),
        before,
        after,
        step,
        keys=["cpu"],
        rows_per_slice=50,
    ).collect()
    assert {r.offset_bucket for r in got} == set(want)
    for r in got:
        assert r.insns == pytest.approx(want[r.offset_bucket][0])
        assert r.cycles == pytest.approx(want[r.offset_bucket][1])
