"""Joining the IPC curve with events: buckets, event-aligned averages, gaps, stretches per thread."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.columns import ratio
from traceloom.operators import (
    WidthSlices,
    ancestor_chains,
    asof_join,
    chain_digests,
    join_groups,
    ordered_scan,
    overlap_join,
    overlap_totals,
    quantile_slices,
)
from traceloom.operators.slices import DEFAULT_SLICE_ROWS, group_of
from traceloom.plans.distribution import TRACE_BEGIN
from traceloom.plans.timeline import ROOT, calls_by_symbol, errors_and_ranges, following_calls
from traceloom.session import materialise

#: Bucket edges of one range that are marked together.
STRETCH_EDGES = 4096


def ipc_buckets(ranges: DataFrame, size: int, step: int, keys: Sequence[str] = ()) -> DataFrame:
    """IPC in buckets ``[i * step, i * step + size)`` of cycles, with their times; a smaller step makes them overlap.

    ``keys``, ``bucket``, ``start_cyc``, ``start_ns``, ``end_ns``, ``cycles``, ``insns``, ``ipc``. A range shares its
    instructions and its time out evenly over its cycles. Cycles are counted from 0 within a key, so a range covers
    ``[end - length, end)`` and the ranges of a key cover its axis without gaps. Times before the first sample are NULL; a bucket
    that the trace ends in ends with it. Instructions of a range without cycles count with the range before it.

    A range only marks the bucket edges inside it, with the running totals there; a bucket is the difference between its two
    edges. So ranges between edges cost nothing, overlapping buckets are not added up again, and an edge is
    shuffled once for each role it has. A range over very many edges is first cut into stretches, which are dealt to
    all tasks.
    """
    pane = math.gcd(size, step)
    end = F.col("end_cum_cyc")
    start = end - F.col("cyc_count")
    first, last = F.ceil(start / pane).cast("long"), F.floor((end - 1) / pane).cast("long")
    spans = ranges.filter("cyc_count > 0").select(
        *keys, start.alias("_s"), "cyc_count", "insn_count", (F.col("end_cum_insns") - F.col("insn_count")).alias("_insns"),
        "start_time", "end_time", first.alias("_first"), last.alias("_last"),
    ).filter("_first <= _last")
    stretch = F.explode(F.sequence(F.floor(F.col("_first") / STRETCH_EDGES), F.floor(F.col("_last") / STRETCH_EDGES)))
    short = F.col("_last") - F.col("_first") < STRETCH_EDGES
    cut = spans.filter(~short).withColumn("_stretch", stretch)
    cut = cut.repartition(F.col("_stretch")).select(
        *[c for c in spans.columns if c not in ("_first", "_last")],
        F.greatest("_first", F.col("_stretch") * STRETCH_EDGES).alias("_first"),
        F.least("_last", F.col("_stretch") * STRETCH_EDGES + (STRETCH_EDGES - 1)).alias("_last"),
    )
    edges = spans.filter(short).unionByName(cut).withColumn("_edge", F.explode(F.sequence("_first", "_last")))
    inside = F.col("_edge") * pane - F.col("_s")
    share = ratio(inside, F.col("cyc_count"))
    marks = edges.select(
        *keys,
        F.inline(F.array(
            F.struct(F.lit(True).alias("_opens"), (F.col("_edge") * pane).alias("_at")),
            F.struct(F.lit(False).alias("_opens"), (F.col("_edge") * pane - size).alias("_at")),
        )),
        "_insns",
        (F.col("insn_count") * share).alias("_part"),
        (F.col("start_time") + F.round((F.col("end_time") - F.col("start_time")) * share).cast("long")).alias("_ns"),
    ).filter((F.pmod("_at", F.lit(step)) == 0) & (F.col("_at") >= 0))
    opens, closes = F.col("_opens"), ~F.col("_opens")
    buckets = marks.groupBy(*keys, (F.expr(f"_at div {step}")).alias("bucket")).agg(
        *[F.max(F.when(side, F.col(c))).alias(f"{name}{c}") for name, side in (("open", opens), ("close", closes)) for c in ("_insns", "_part", "_ns")]
    )
    # The first edge is cycle 0, which the first range begins with; what lies past the end has its totals.
    totals = ranges.groupBy(*keys).agg(
        F.max("end_cum_cyc").alias("_cycles"), F.max("end_cum_insns").alias("_all"), F.max("end_time").alias("_end")
    )
    found = join_groups(buckets.filter("open_insns is not null"), totals, keys)
    low = F.col("bucket") * step
    inner = F.col("close_insns").isNotNull()
    whole = F.coalesce("close_insns", "_all") - F.col("open_insns")
    insns = whole + (F.coalesce("close_part", F.lit(0.0)) - F.col("open_part"))
    cycles = F.least("_cycles", low + size) - low
    return found.select(
        *keys,
        "bucket",
        low.alias("start_cyc"),
        F.col("open_ns").alias("start_ns"),
        F.when(inner, F.col("close_ns")).otherwise(F.col("_end")).alias("end_ns"),
        cycles.alias("cycles"),
        insns.alias("insns"),
        ratio(insns, cycles).alias("ipc"),
    )


def event_aligned_ipc(
    ranges: DataFrame,
    events: DataFrame,
    before: int,
    after: int,
    step: int,
    keys: Sequence[str] = (),
    rows_per_slice: int = DEFAULT_SLICE_ROWS,
) -> DataFrame:
    """Average IPC as a function of the time since an event (column ``time`` of ``events``).

    A range shares its counts out evenly over its duration. The ranges of a key must follow each other in time,
    as those of one trace do; pass a stored table. What is left to come after a time is a running total plus a
    share of the range under way, so each event asks one as-of question per bucket edge and takes differences.
    Pairs of ranges and events are never formed: the work is that of the ranges plus events times edges.
    """
    edges = sorted({-before, after, *range(-(before // step) * step, after, step)})
    spans = ranges.filter("start_time < end_time").select(
        *keys, "start_time", "end_time", "end_sample_id", "insn_count", "cyc_count", (-F.col("end_time")).alias("_back")
    )
    to_come = materialise(
        ordered_scan(
            spans,
            "_back",
            tie="end_sample_id",
            keys=keys,
            sums={"_insns": "insn_count", "_cycles": "cyc_count"},
            slices=quantile_slices(spans, "_back", rows_per_slice),
        ),
        "to_come",
    )
    asked = events.filter("time is not null").select(
        *keys, "time", F.posexplode(F.array(*[F.lit(e).cast("long") for e in edges])).alias("_edge", "_offset")
    )
    found = asof_join(
        asked.select(*keys, "_edge", (F.col("time") + F.col("_offset")).alias("_at")),
        to_come,
        left_on="_at",
        right_on="end_time",
        right_id="end_sample_id",
        columns={c: c for c in ("start_time", "end_time", "insn_count", "cyc_count", "_insns", "_cycles")},
        keys=keys,
        how="inner",
        rows_per_slice=rows_per_slice,
    )
    # Whole counts are summed exactly; only the share of the range under way is a fraction.
    under_way = F.col("_at") > F.col("start_time")
    left = ratio(F.col("end_time") - F.col("_at"), F.col("end_time") - F.col("start_time"))
    sums = []
    for count, total in (("insn_count", "_insns"), ("cyc_count", "_cycles")):
        whole = F.when(under_way, F.col(total) - F.col(count)).otherwise(F.col(total))
        sums.append(F.sum(whole.cast("decimal(20,0)")).alias(f"{total}_whole"))
        sums.append(F.sum(F.when(under_way, F.col(count) * left).otherwise(0.0)).alias(f"{total}_part"))
    # An edge begins one bucket and ends the one before.
    role = F.array(
        F.struct(F.col("_edge").alias("_from"), F.lit(1).alias("_sign")),
        F.struct((F.col("_edge") - 1).alias("_from"), F.lit(-1).alias("_sign")),
    )
    roles = found.groupBy("_edge").agg(*sums).select("*", F.inline(role))
    totals = {
        out: F.sum(F.col(f"{total}_whole") * F.col("_sign")).cast("double")
        + F.sum(F.col(f"{total}_part") * F.col("_sign"))
        for out, total in (("insns", "_insns"), ("cycles", "_cycles"))
    }
    first_edge = F.element_at(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("_from") + 1)
    return (
        roles.filter(F.col("_from").between(0, len(edges) - 2))
        .groupBy("_from")
        .agg(*[c.alias(out) for out, c in totals.items()])
        .filter("insns > 0 or cycles > 0")
        .select(
            F.floor(first_edge / step).alias("offset_bucket"),
            "insns",
            "cycles",
            ratio(F.col("insns"), F.col("cycles")).alias("ipc"),
        )
    )


def zero_fill_gaps(
    ranges: DataFrame,
    errors: DataFrame,
    rows_per_slice: int = DEFAULT_SLICE_ROWS,
    slices: WidthSlices | None = None,
) -> DataFrame:
    """Ranges with the untraced ones emptied: no instructions, cycles in proportion to their duration.

    Untraced are ranges that end with a trace begin and ranges that cover an overflow. ``ranges`` needs
    ``branch_type_name``; pass a stored table. The axis of cumulative cycles is drawn up anew, so the result can
    be stored and given to the sliding window; ``slices`` cut it by ``end_sample_id``.
    """
    covered = errors_and_ranges(errors, ranges, rows_per_slice).select("end_sample_id").distinct()
    covered = materialise(covered, "covered")
    marked = ranges.join(covered.withColumn("_lost", F.lit(True)), "end_sample_id", "left").withColumn(
        "is_gap", F.coalesce("_lost", F.lit(False)) | F.coalesce(F.col("branch_type_name") == TRACE_BEGIN, F.lit(False))
    )
    duration = F.col("end_time") - F.col("start_time")
    traced = marked.filter(~F.col("is_gap") & F.col("start_time").isNotNull())
    rate = traced.agg(ratio(F.sum("cyc_count"), F.sum(duration))).scalar()
    cycles = F.coalesce(F.round(duration * rate).cast("long"), F.col("cyc_count"))
    filled = marked.select(
        "end_sample_id",
        "start_time",
        "end_time",
        "is_gap",
        F.when(F.col("is_gap"), F.lit(0).cast("long")).otherwise(F.col("insn_count")).alias("insn_count"),
        F.when(F.col("is_gap"), cycles).otherwise(F.col("cyc_count")).alias("cyc_count"),
    )
    filled = materialise(filled, "filled")
    return ordered_scan(
        filled, "end_sample_id", sums={"end_cum_insns": "insn_count", "end_cum_cyc": "cyc_count"}, slices=slices
    )


def on_cpu_stretches(context_switches: DataFrame, rows_per_slice: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Per switch record, the stretch its incoming thread holds the CPU: until the next switch there.

    The last stretch of a CPU is open: its ``switch_out`` is NULL.
    """
    slices = quantile_slices(context_switches, "time", rows_per_slice)
    following = ordered_scan(
        context_switches.select("id", "cpu", "time", "thread_in_id"),
        "time",
        tie="id",
        keys=["cpu"],
        leads={"until": "time"},
        slices=slices,
    )
    return following.select(
        F.col("thread_in_id").alias("thread_id"),
        "cpu",
        F.col("time").alias("switch_in"),
        F.col("until").alias("switch_out"),
    )


def thread_on_cpu_calls(
    context_switches: DataFrame, calls: DataFrame, rows_per_slice: int = DEFAULT_SLICE_ROWS
) -> DataFrame:
    """Calls cut to the stretches in which their thread was on a CPU; an open stretch outlasts every call."""
    last = calls.agg(F.max("return_time")).scalar()
    stretches = on_cpu_stretches(context_switches, rows_per_slice).withColumn(
        "switch_out", F.coalesce("switch_out", F.greatest("switch_in", last))
    )
    stretches = materialise(stretches, "stretches")
    timed = calls.select("thread_id", F.col("id").alias("call_id"), "call_time", "return_time")
    return overlap_join(
        stretches,
        timed,
        a_interval=("switch_in", "switch_out"),
        b_interval=("call_time", "return_time"),
        keys=["thread_id"],
    )


def on_cpu_time(
    context_switches: DataFrame, calls: DataFrame, rows_per_slice: int = DEFAULT_SLICE_ROWS
) -> DataFrame:
    """Per call, in how many stretches its thread was on a CPU during it, and for how long in sum.

    ``thread_id``, ``id``, ``overlap_count``, ``overlap_total``: the sums of :func:`thread_on_cpu_calls`, for calls without stretches too, and
    without forming the pairs.
    """
    last = calls.agg(F.max("return_time")).scalar()
    stretches = on_cpu_stretches(context_switches, rows_per_slice).withColumn(
        "switch_out", F.coalesce("switch_out", F.greatest("switch_in", last))
    )
    return overlap_totals(
        calls, materialise(stretches, "stretches"), a_id="id", a_interval=("call_time", "return_time"),
        b_interval=("switch_in", "switch_out"), keys=["thread_id"], rows_per_slice=rows_per_slice,
    )


def perf_overhead(
    calls: DataFrame,
    call_paths: DataFrame,
    symbols: DataFrame,
    dsos: DataFrame,
    start: str = "__perf_event_task_sched_out",
    end: str = "perf_event_context_sched_out",
    rows_per_slice: int = DEFAULT_SLICE_ROWS,
) -> DataFrame:
    """Time between each call of one function and the next call of another; one row."""
    pairs = following_calls(
        calls_by_symbol(calls, call_paths, symbols, dsos, start),
        calls_by_symbol(calls, call_paths, symbols, dsos, end),
        "start",
        "end",
        rows_per_slice,
    )
    spent = F.col("end_call_time") - F.col("start_call_time")
    return pairs.agg(
        F.count(spent).alias("stretches"),
        F.sum(spent).alias("total_ns"),
        F.min(spent).alias("min_ns"),
        F.max(spent).alias("max_ns"),
    )


def transition_counts(
    samples: DataFrame, state: str, keys: Sequence[str] = ("thread_id",), at_least: int = 1
) -> DataFrame:
    """How often one state follows another within each key; rare transitions are left out."""
    narrow = samples.select(*keys, "id", state)
    scanned = ordered_scan(narrow, "id", keys=keys, lags={"from_state": state, "_previous": "id"})
    return (
        scanned.filter("_previous is not null")
        .groupBy("from_state", F.col(state).alias("to_state"))
        .agg(F.count(F.lit(1)).alias("transitions"))
        .filter(F.col("transitions") >= at_least)
    )


def self_times(calls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``_group``, ``id``, ``parent_id``, ``self_time`` of each call but the root: its time without that of its callees."""
    timed = calls.select(
        group_of(keys).alias("_group"), "id", "parent_id", (F.col("return_time") - F.col("call_time")).alias("_taken")
    )
    inner = timed.groupBy(F.col("parent_id").alias("id"), "_group").agg(F.sum("_taken").alias("_inner"))
    own = timed.filter(F.col("id") != ROOT).join(inner, ["id", "_group"], "left")
    return own.select(
        "_group", "id", "parent_id", (F.col("_taken") - F.coalesce("_inner", F.lit(0))).alias("self_time")
    )


def call_path_table(named: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The call paths of a trace as a trie: one row per distinct path, with its totals.

    ``keys``, ``path_id``, ``parent_path_id`` (NULL at the top), ``symbol`` of the last frame, ``self_time``, ``calls``.
    ``named`` are stored calls with symbols. Calls are told apart by digests of their paths; a path is
    never spelled out per call, and all that belongs to a path is added up before it gets a number.
    """
    digests = chain_digests(named, F.col("symbol"), root=ROOT, keys=keys)
    own = self_times(named, keys).join(digests, ["id", "_group"])
    paths = own.groupBy("_group", "digest").agg(
        F.sum("self_time").alias("self_time"), F.count(F.lit(1)).alias("calls"), F.min_by("parent_id", "id").alias("_parent"),
        F.min("id").alias("_example"),
    )
    paths = materialise(paths.withColumn("path_id", F.monotonically_increasing_id()), "call-paths")
    # The path above is that of the caller of any one call with this path.
    above = digests.select("_group", F.col("id").alias("_parent"), F.col("digest").alias("_above"))
    above = above.join(paths.select("_group", "_parent"), ["_parent", "_group"], "left_semi")
    numbers = paths.select("_group", F.col("digest").alias("_above"), F.col("path_id").alias("parent_path_id"))
    symbols = named.select(group_of(keys).alias("_group"), F.col("id").alias("_example"), "symbol")
    symbols = symbols.join(paths.select("_group", "_example"), ["_example", "_group"], "left_semi")
    found = paths.join(above, ["_parent", "_group"], "left").join(numbers, ["_above", "_group"], "left")
    found = found.join(symbols, ["_example", "_group"])
    return materialise(
        found.select(*[F.col("_group")[k].alias(k) for k in keys], "path_id", "parent_path_id", "symbol", "self_time", "calls"),
        "call-paths",
    )


def folded_paths(paths: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Self time and calls per path as text, from the outermost frame; from :func:`call_path_table`.

    Only distinct paths are spelled out. Frames without a symbol leave no trace in the text, so paths that differ in
    those alone are added up.
    """
    chains = ancestor_chains(paths, node="path_id", parent="parent_path_id", columns=["symbol"], root=-1, keys=keys)
    text = F.concat_ws(";", F.reverse(F.transform("chain", lambda f: f.symbol)))
    spelled = chains.select(group_of(keys).alias("_group"), F.col("id").alias("path_id"), text.alias("path"))
    return (
        paths.withColumn("_group", group_of(keys))
        .join(spelled, ["path_id", "_group"])
        .groupBy(*keys, "path")
        .agg(F.sum("self_time").alias("self_time"), F.sum("calls").alias("calls"))
    )


def folded_stacks(named: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Time spent in each call path itself, without its callees; ``named`` are stored calls with symbols."""
    return folded_paths(call_path_table(named, keys), keys)
