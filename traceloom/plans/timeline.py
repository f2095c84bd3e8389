"""System calls, context switches and trace overflows on the time axis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.columns import ends_inside, plain_label, touches
from traceloom.operators import (
    QuantileSlices,
    WidthSlices,
    ancestor_chains,
    asof_join,
    join_groups,
    nearest_marked,
    ordered_scan,
    quantile_slices,
)
from traceloom.operators.slices import DEFAULT_SLICE_ROWS, group_of
from traceloom.plans.lookups import context_switches_view, look_up
from traceloom.plans.ranges import View
from traceloom.session import materialise

KERNEL = "[kernel.kallsyms]"
ROOT = 0
# The frames between a system call's own function and the kernel entry, innermost first.
SYSCALL_SHAPE = ["x64_sys_call", "do_syscall_64", "entry_SYSCALL_64"]
ENTRY_DEPTH = 3
FRAME = ["call_time", "return_time", "symbol", "dso"]
# Kernel functions that bracket a context switch.
SWITCH_FROM = "prepare_task_switch"
SWITCH_TO = "switch_mm_irqs_off"
OVERFLOW = "Overflow packet"


def calls_with_symbols(
    calls: DataFrame, call_paths: DataFrame, symbols: DataFrame, dsos: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Calls with ``symbol`` and ``dso`` of their call path, NULL where unknown. With ``keys`` all tables have them."""
    paths = look_up(call_paths, "symbol_id", look_up(symbols, "dso_id", dsos, {"dso": "short_name"}, keys), {
        "symbol": "name",
        "dso": "dso",
    }, keys)
    return look_up(calls, "call_path_id", paths, {"symbol": "symbol", "dso": "dso"}, keys)


def calls_by_symbol(
    calls: DataFrame,
    call_paths: DataFrame,
    symbols: DataFrame,
    dsos: DataFrame,
    name: str,
    dso: str = KERNEL,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Calls of one function of one binary, found from the symbol side so that the filter comes first."""

    def of(table: DataFrame, column: str, *columns: str) -> DataFrame:
        group = [group_of(keys).alias("_group")] if keys else []
        return table.select(*group, F.col("id").alias(column), *columns)

    same = ["_group"] if keys else []
    wanted = of(symbols.filter(F.col("name") == name), "symbol_id", "dso_id").join(
        of(dsos.filter(F.col("short_name") == dso), "dso_id"), [*same, "dso_id"]
    )
    paths = of(call_paths, "call_path_id", "symbol_id").join(wanted, [*same, "symbol_id"])
    found = calls.withColumn("_group", group_of(keys)) if keys else calls
    found = found.join(paths.select(*same, "call_path_id"), [*same, "call_path_id"])
    return found.select(*keys, "id", "call_time", "return_time")


def stacks(calls: DataFrame, call_paths: DataFrame, symbols: DataFrame, dsos: DataFrame) -> DataFrame:
    """Each call with its call stack as an array of frames. Independent of any view: store and reuse it."""
    named = calls_with_symbols(calls, call_paths, symbols, dsos)
    frames = named.select("id", "parent_id", *FRAME)
    return ancestor_chains(materialise(frames, "frames"), columns=FRAME)


def calls_near(calls: DataFrame, view: View) -> DataFrame:
    """Calls with an end in view, their own or that of a frame above them, found by parent pointers.

    Stacks of these calls have the same frames in view as whole stacks, also where calls are open or outlive
    their callers: what lies between a call and its highest frame in view is below that frame too. Each round
    doubles the distance a call looks up, carrying an id and a flag only; calls that met a frame in view or
    the end of their stack leave.
    """
    inside = F.coalesce(ends_inside(F.col("call_time"), F.col("return_time"), view.start, view.end), F.lit(False))
    if not calls.filter((F.col("id") == ROOT) & inside).isEmpty():
        return calls  # the root is above nearly everything
    up = F.when(~inside & (F.col("id") != ROOT) & (F.col("parent_id") != ROOT), F.col("parent_id"))
    state = materialise(calls.select("id", inside.alias("near"), up.alias("up")), "near")
    found, pending = [state.filter("near").select("id")], state.filter("up is not null")
    # A way up meets each of these calls at most once, so more rounds than that mean a circle.
    for _ in range(pending.count().bit_length() + 1):
        if pending.isEmpty():
            return calls.join(reduce(DataFrame.unionAll, found), "id", "left_semi")
        known = reduce(DataFrame.unionAll, [f.select("id", F.lit(True), F.lit(None).cast("long")) for f in found])
        known = known.unionAll(pending.select("id", F.lit(False), "up")).toDF("up", "_near", "_up")
        grown = pending.join(known, "up", "left").select(
            "id", F.coalesce("_near", F.lit(False)).alias("near"), F.col("_up").alias("up")
        )
        grown = materialise(grown, "near")
        found.append(grown.filter("near").select("id"))
        pending = grown.filter("up is not null")
    raise ValueError("parent pointers form a cycle")


def _frames_in_view(stack: DataFrame, view: View | None) -> DataFrame:
    """Keep the frames with an end in the view; the depth of a frame is its place in the whole stack."""
    with_depth = F.transform(
        "chain",
        lambda f, i: F.struct(
            i.cast("long").alias("depth"), f.call_time.alias("call_time"), f.return_time.alias("return_time"),
            f.symbol.alias("symbol"), f.dso.alias("dso"),
        ),
    )
    if view is not None:
        with_depth = F.filter(
            with_depth, lambda f: ends_inside(f.call_time, f.return_time, view.start, view.end)
        )
    return stack.select(F.col("id").alias("group_id"), with_depth.alias("frames")).filter(F.size("frames") > 0)


def stack_summary(stack: DataFrame, view: View | None) -> DataFrame:
    """First and last frame of each stack, its symbols innermost first, and the times of its entry frame.

    With a view only frames with an end in it count, so a frame that encloses the view is missing.
    """
    first, last = F.col("frames")[0], F.element_at("frames", -1)
    entry = F.get(F.filter("frames", lambda f: f.depth == ENTRY_DEPTH), F.lit(0))
    return _frames_in_view(stack, view).select(
        "group_id",
        last.depth.alias("d"),
        *[first[p].alias(f"first_{p}") for p in FRAME],
        *[last[p].alias(f"last_{p}") for p in FRAME],
        F.transform("frames", lambda f: f.symbol).alias("symbol_list"),
        entry.call_time.alias("syscall_entry_call_time"),
        entry.return_time.alias("syscall_entry_return_time"),
    )


def full_syscalls(stack: DataFrame, view: View | None) -> DataFrame:
    """System calls: stacks whose second to fourth frame are the fixed kernel path.

    With a view the shape is tested on the frames in view; ``None`` tests whole stacks.
    """
    shape = F.array(*[F.lit(s) for s in SYSCALL_SHAPE])
    return (
        stack_summary(stack, view)
        .filter(F.slice("symbol_list", 2, len(SYSCALL_SHAPE)) == shape)
        .select(
            F.col("syscall_entry_call_time").alias("call_time"),
            F.col("syscall_entry_return_time").alias("return_time"),
            F.col("first_symbol").alias("syscall_kernel_name"),
            F.col("group_id").alias("call_id"),
        )
    )


def marked_frames(named: DataFrame, view: View | DataFrame | None, keys: Sequence[str] = ()) -> DataFrame:
    """Calls with symbols as frames, and whether they are ``seen``: have an end in view.

    ``view`` is one window, a table of a window per combination of ``keys``, or None for the whole trace.
    """
    if isinstance(view, DataFrame):
        named = join_groups(named, view, keys, "left")
        seen = ends_inside(F.col("call_time"), F.col("return_time"), F.col("view_start"), F.col("view_end"))
    elif view is not None:
        seen = ends_inside(F.col("call_time"), F.col("return_time"), view.start, view.end)
    else:
        seen = F.lit(True)
    seen = F.coalesce(seen, F.lit(False)).alias("seen")
    return materialise(named.select(*keys, "id", "parent_id", "call_time", "return_time", "symbol", seen), "frames")


def syscalls_of(frames: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """System calls among stored :func:`marked_frames`: as :func:`full_syscalls`, without stacks.

    The frames of a stack that are seen form a chain of their own by their nearest seen ancestors. The shape is
    tested link by link from the kernel entry inwards, each link an equi-join of ids on the few frames with the right
    symbol. Nothing grows with the depth of the stacks. Where all frames are seen, as in a whole trace, the nearest one above is the
    caller, and no ancestors are looked up.
    """
    rows = frames.select(group_of(keys).alias("_group"), "*")
    seen = rows.filter("seen")
    near = None
    if not frames.filter("not seen").isEmpty():
        near = nearest_marked(frames, F.col("seen"), root=ROOT, keys=keys)
        # The nearest seen frame above a seen one: of its parent, or where the parent is seen the parent itself.
        above = near.select("_group", F.col("id").alias("parent_id"), F.col("at").alias("up"))
    inner = None
    for symbol in [*reversed(SYSCALL_SHAPE), None]:
        named = seen.filter(F.col("id") != ROOT) if inner is not None else seen
        if symbol is not None:
            named = named.filter(F.col("symbol") == symbol)
        step = named.select("_group", "id", "parent_id", "symbol", "call_time", "return_time")
        if inner is None:
            # Carried inwards: the times of the entry frame, and whether no frame is missing on the way.
            times = [F.col("call_time").alias("_call"), F.col("return_time").alias("_return")]
            inner = step.select("_group", F.col("id").alias("up"), *times, F.lit(True).alias("_direct"))
            continue
        called = step.join(above, ["parent_id", "_group"]) if near is not None else step.withColumn("up", F.col("parent_id"))
        linked = called.join(inner.drop("symbol"), ["up", "_group"])
        direct = F.col("_direct") & (F.col("up") == F.col("parent_id"))
        inner = linked.select("_group", F.col("id").alias("up"), "symbol", "_call", "_return", direct.alias("_direct"))
    shown = ["_group", "id", "symbol"]
    if near is None:
        parts, bent = [inner.select("_group", F.col("up").alias("id"), "symbol", "_call", "_return")], None
    else:
        groups = near.join(inner.withColumnRenamed("up", "at"), ["at", "_group"])
        groups = materialise(groups.withColumn("_direct", F.col("_direct") & (F.col("id") == F.col("at"))), "syscalls")
        parts = [groups.filter("_direct").select(*shown, "_call", "_return")]
        bent = groups.filter("not _direct").select(*shown)
    if bent is not None and not bent.isEmpty():
        # Frames are missing in between: the entry frame is the fourth of the whole stack, if it is seen.
        links = rows.select("_group", F.col("id").alias("_at"), F.col("parent_id").alias("_next"))
        walked = bent.withColumn("_at", F.col("id"))
        for _ in range(ENTRY_DEPTH):
            walked = walked.join(links, ["_at", "_group"], "left")
            walked = walked.withColumn("_at", F.when(F.col("_at") != ROOT, F.col("_next"))).drop("_next")
        entry = seen.select("_group", F.col("id").alias("_at"), F.col("call_time").alias("_call"), F.col("return_time").alias("_return"))
        parts.append(walked.join(entry, ["_at", "_group"], "left").select(*shown, "_call", "_return"))
    return reduce(DataFrame.unionByName, parts).select(
        *[F.col("_group")[k].alias(k) for k in keys],
        F.col("_call").alias("call_time"),
        F.col("_return").alias("return_time"),
        F.col("symbol").alias("syscall_kernel_name"),
        F.col("id").alias("call_id"),
    )


def following_calls(
    first: DataFrame,
    second: DataFrame,
    first_prefix: str,
    second_prefix: str,
    rows_per_slice: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Pair each call of ``first`` with the next call of ``second`` that starts strictly later."""
    second = materialise(second, "calls-of-one")
    left = materialise(first, "calls-of-one").select(
        *keys,
        F.col("id").alias(f"{first_prefix}_call_id"),
        F.col("call_time").alias(f"{first_prefix}_call_time"),
        F.col("return_time").alias(f"{first_prefix}_call_return_time"),
    )
    return asof_join(
        left,
        second,
        left_on=f"{first_prefix}_call_time",
        right_on="call_time",
        right_id="id",
        columns={
            f"{second_prefix}_call_id": "id",
            f"{second_prefix}_call_time": "call_time",
            f"{second_prefix}_call_return_time": "return_time",
        },
        keys=keys,
        how="left",
        rows_per_slice=rows_per_slice,
    )


def kernel_context_switches(
    calls: DataFrame,
    call_paths: DataFrame,
    symbols: DataFrame,
    dsos: DataFrame,
    rows_per_slice: int = DEFAULT_SLICE_ROWS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Context switches seen through kernel calls, for traces without switch records."""
    leaving = calls_by_symbol(calls, call_paths, symbols, dsos, SWITCH_FROM, keys=keys)
    entering = calls_by_symbol(calls, call_paths, symbols, dsos, SWITCH_TO, keys=keys)
    return following_calls(leaving, entering, "pts", "smio", rows_per_slice, keys)


def switches_in_view(switches: DataFrame, view: View | DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    if isinstance(view, DataFrame):
        switches, bounds = join_groups(switches, view, keys), (F.col("view_start"), F.col("view_end"))
    else:
        bounds = (view.start, view.end)
    return switches.filter(F.col("smio_call_time").between(*bounds)).select(*keys, F.col("smio_call_time").alias("time"))


def timeline_marks(
    switches: DataFrame, syscalls: DataFrame, view: View | DataFrame, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Points where on-CPU stretches can start and end: switches, and calls or returns."""
    switch = switches_in_view(switches, view, keys).select(
        *keys, "time", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("call_id")
    )

    def marks(column: str) -> DataFrame:
        point = syscalls.select(*keys, F.col(column).alias("time"), F.col("syscall_kernel_name").alias("name"), "call_id")
        return switch.unionByName(point)

    return marks("call_time"), marks("return_time")


def on_cpu_syscalls(
    switches: DataFrame,
    syscalls: DataFrame,
    view: View | DataFrame,
    rows_per_slice: int = DEFAULT_SLICE_ROWS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Stretches of a system call on the CPU: each start with the earliest strictly later end.

    Among ends at the same time a return wins over a switch, then the lowest call id.
    """
    starts, ends = timeline_marks(switches, syscalls, view, keys)
    starts = starts.select(*keys, *[F.col(c).alias(f"starts_{c}") for c in ("time", "name", "call_id")])
    ends = ends.withColumn("_rank", F.coalesce("call_id", F.lit((1 << 63) - 1)))
    return asof_join(
        starts,
        ends,
        left_on="starts_time",
        right_on="time",
        right_id="_rank",
        columns={"ends_time": "time", "ends_name": "name", "ends_call_id": "call_id"},
        keys=keys,
        how="inner",
        rows_per_slice=rows_per_slice,
    )


def in_view(on_cpu: DataFrame, view: View) -> DataFrame:
    return on_cpu.filter(ends_inside(F.col("starts_time"), F.col("ends_time"), view.start, view.end))


def on_cpu_violations(on_cpu: DataFrame, view: View) -> DataFrame:
    """Stretches that belong to no call, or start in one call and end in another; none in a sound trace."""
    start, end = F.col("starts_call_id"), F.col("ends_call_id")
    return in_view(on_cpu, view).filter((start.isNull() & end.isNull()) | (start != end))


def on_cpu_labels(on_cpu: DataFrame, view: View) -> DataFrame:
    """Stretches in view with the name of their call."""
    name = F.coalesce("starts_name", "ends_name")
    return in_view(on_cpu, view).select("starts_time", "ends_time", name.alias("name"))


def spans_by_label(spans: DataFrame, start: str = "starts_time", end: str = "ends_time") -> DataFrame:
    """Number and total length of the stretches of each label."""
    return (
        spans.select(plain_label(F.col("name")).alias("label"), F.col(start).alias("s"), F.col(end).alias("e"))
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("spans"),
            F.sum(F.col("e") - F.col("s")).alias("total_duration"),
            F.min("s").alias("first_start"),
            F.max("e").alias("last_end"),
        )
    )


def errors_and_ranges(
    errors: DataFrame, ranges: DataFrame, rows_per_slice: int = DEFAULT_SLICE_ROWS, message: str = OVERFLOW
) -> DataFrame:
    """Trace errors with one message, each with the range that covers it."""
    chosen = errors.filter(F.col("msg") == message).select("time")
    found = asof_join(
        chosen,
        ranges,
        left_on="time",
        right_on="end_time",
        right_id="end_sample_id",
        columns={c: c for c in ("end_sample_id", "start_time", "start_cum_cyc", "end_time", "end_cum_cyc", "cyc_count")},
        how="left",
        rows_per_slice=rows_per_slice,
    )
    return found.withColumn("duration_ns", F.col("end_time") - F.col("start_time"))


def overflow_in_view(covered: DataFrame, view: View) -> DataFrame:
    """Overflow ranges that touch the view, also those that enclose it."""
    return covered.filter(touches(F.col("start_time"), F.col("end_time"), view.start, view.end)).select(
        "start_time", "end_time"
    )


def switch_timeline(
    context_switches: DataFrame, threads: DataFrame, comms: DataFrame, view: View
) -> DataFrame:
    """Recorded switches in view; the window is cut before the names are looked up."""
    cut = context_switches.filter(F.col("time").between(view.start, view.end))
    return context_switches_view(cut, threads, comms).select("time", "tid_in", "flags")


def iteration_latency(
    syscalls: DataFrame,
    names: Sequence[str],
    slices: QuantileSlices | WidthSlices | None = None,
    rows_per_slice: int = DEFAULT_SLICE_ROWS,
) -> DataFrame:
    """Time from one return of the named system calls to the next. ``syscalls`` should be stored."""
    chosen = syscalls.filter(F.col("syscall_kernel_name").isin(list(names)))
    if slices is None:
        slices = quantile_slices(chosen, "return_time", rows_per_slice)
    scanned = ordered_scan(
        chosen, "return_time", tie="call_id", lags={"lag_return_time": "return_time"}, slices=slices
    )
    latency: Column = F.col("return_time") - F.col("lag_return_time")
    return scanned.filter(F.col("lag_return_time").isNotNull()).select(
        "return_time", "lag_return_time", latency.alias("latency_ns"), "syscall_kernel_name"
    )
