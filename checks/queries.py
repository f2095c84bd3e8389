"""Every registered query: a plan of the library over whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixture import DAY, LONG_LIMIT, SLICE_ROWS, WINDOW, Fixture, Trials
from traceloom.functions.columns import ratio
from traceloom.operators import WidthSlices, ancestor_pairs, asof_join, ordered_scan, overlap_join, slice_directory
from traceloom.plans import distribution, gaps, ipc, loglines, lookups, overlays, ranges, timeline, trials
from traceloom.session import materialise, shared_folder
from traceloom.sources import packets, published, schemas, tables
from traceloom.sources.ordered_files import read_ordered, write_ordered
from traceloom.streaming.normalise import normalise_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WIDTH = WidthSlices(SLICE_ROWS)
LATENCY_CALLS = ["__x64_sys_view"]


def query(name: str) -> Callable[[Callable[[Fixture], DataFrame]], Callable[[Fixture], DataFrame]]:
    def register(build: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Fixture(spark, sf_dir))
        return build

    return register


def fixture_ranges(f: Fixture) -> DataFrame:
    """Stored ranges on the fixture, without names."""
    return ranges.stored_ranges(f.samples, slices=WIDTH)


def counted_samples(f: Fixture) -> DataFrame:
    """Counted samples, whose counts are those of the range each ends, with the branch type name."""
    return ranges.timestamped_samples(f.sample_names())


def named_ranges(f: Fixture, store: bool = True) -> DataFrame:
    """Ranges with the branch type name."""
    plain = ranges.timestamped_ranges(f.samples, names=["branch_type"], slices=WIDTH)
    named = lookups.look_up(plain, "branch_type", f.branch_types, {"branch_type_name": "name"})
    return materialise(named, "ranges") if store else named


def view(f: Fixture) -> ranges.View:
    return ranges.middle_view(f.samples, DAY)


def call_stacks(f: Fixture) -> DataFrame:
    return timeline.stacks(f.calls, f.call_paths, f.symbols, f.dsos)


def stored_syscalls(f: Fixture, v: ranges.View) -> DataFrame:
    """System calls in view."""
    return materialise(timeline.syscalls_of(timeline.marked_frames(named_calls(f), v)), "syscalls")


def named_calls(f: Fixture) -> DataFrame:
    return timeline.calls_with_symbols(f.calls, f.call_paths, f.symbols, f.dsos)


def whole_syscalls(f: Fixture) -> DataFrame:
    """System calls of the whole trace; four frames decide, so the stacks need not be complete."""
    return timeline.syscalls_of(timeline.marked_frames(named_calls(f), None))


def kernel_switches(f: Fixture) -> DataFrame:
    return timeline.kernel_context_switches(f.calls, f.call_paths, f.symbols, f.dsos, SLICE_ROWS)


def on_cpu(f: Fixture, v: ranges.View) -> DataFrame:
    return timeline.on_cpu_syscalls(
        materialise(kernel_switches(f), "switches"), stored_syscalls(f, v), v, SLICE_ROWS
    )


# Sources and packets -------------------------------------------------------------------------------------


@query("trace_tables")
def _(f: Fixture) -> DataFrame:
    path = f"{shared_folder(f.spark).rstrip('/')}/traceloom/trace-{uuid.uuid4().hex}"
    made = {"samples": f.samples, "threads": f.threads, "comms": f.comms, "symbols": f.symbols, "cbr": packets.decode_cbr(f.packets)}
    tables.write_trace(made, path, "async")
    counts = None
    for table in [*made, "ptwrite"]:
        rows = tables.read_table(f.spark, path, table, trial="async").agg(
            F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
            F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum"),
        )
        counts = rows if counts is None else counts.unionByName(rows)
    return counts


def new_folder(f: Fixture, name: str) -> str:
    return f"{shared_folder(f.spark).rstrip('/')}/traceloom/{name}-{uuid.uuid4().hex}"


def contents(df: DataFrame, table: str, count: Column | None = None) -> DataFrame:
    """Number of rows and the sum of a digest of each, over all columns in their declared order."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c.name).cast("string"), F.lit("~")) for c in schemas.schema_of(table)])
    digest = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
    return df.agg(
        F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.sum(digest).alias("content")
    )


@query("published_tables")
def _(f: Fixture) -> DataFrame:
    folder = new_folder(f, "published")
    published.publish_trial(f.tables, folder, "async")
    read = [contents(published.read_published(f.spark, folder, t, "async"), t) for t in f.tables]
    return reduce(DataFrame.unionAll, read)


@query("published_branches_layout")
def _(f: Fixture) -> DataFrame:
    folder = new_folder(f, "published")
    published.publish_trial({"samples": schemas.to_branches_layout(f.samples)}, folder, "a/b c", layout="branches")
    return contents(published.read_published(f.spark, folder, "samples"), "samples")


@query("publish_replace_recover")
def _(f: Fixture) -> DataFrame:
    folder, steps = new_folder(f, "published"), []

    def step(name: str, threads: DataFrame, replace: bool = False) -> None:
        try:
            published.publish_trial({"comms": f.comms, "threads": threads}, folder, "sync", replace=replace)
            outcome = "ok"
        except FileExistsError:
            outcome = "refused"
        except Exception:  # whatever stops a job: a lost disk, a broken row
            outcome = "failed"
        rows = published.read_published(f.spark, folder, "threads").agg(F.count(F.lit(1)).alias("row_count"))
        steps.append(materialise(rows, "step").select(F.lit(name).alias("step"), "row_count", F.lit(outcome).alias("outcome")))

    step("first", f.threads)
    step("again", f.threads.limit(1))
    step("broken", f.threads.withColumn("pid", F.when(F.col("id") >= 0, F.raise_error(F.lit("broken row"))).cast("int")), True)
    step("replaced", f.threads.filter(F.col("id") % 2 == 0), True)
    return reduce(DataFrame.unionAll, steps)


@query("samples_branches")
def _(f: Fixture) -> DataFrame:
    return schemas.to_branches_layout(f.samples)


@query("dim_sentinel")
def _(f: Fixture) -> DataFrame:
    return f.threads


for _kind, _decode in packets.DECODERS.items():
    QUERIES[f"decode_{_kind}"] = lambda spark, sf_dir, decode=_decode: decode(Fixture(spark, sf_dir).packets)


@query("packet_dispatch")
def _(f: Fixture) -> DataFrame:
    return packets.with_kind(f.packets).groupBy("kind", "config").agg(
        F.count(F.lit(1)).alias("packets"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query("packet_rejects")
def _(f: Fixture) -> DataFrame:
    return packets.reject_counts(f.packets)


@query("trial_flags")
def _(f: Fixture) -> DataFrame:
    names = f.connections.select("trial").distinct()
    return names.select("trial", *[c.alias(n) for n, c in tables.trial_flags(F.col("trial")).items()])


# Lookup views --------------------------------------------------------------------------------------------


@query("v_machines")
def _(f: Fixture) -> DataFrame:
    return lookups.machines_view(f.machines)


@query("v_dsos")
def _(f: Fixture) -> DataFrame:
    return lookups.dsos_view(f.dsos, f.machines)


@query("v_symbols")
def _(f: Fixture) -> DataFrame:
    return lookups.symbols_view(f.symbols, f.dsos)


@query("v_threads")
def _(f: Fixture) -> DataFrame:
    return lookups.threads_view(f.threads, f.machines)


@query("v_comm_threads")
def _(f: Fixture) -> DataFrame:
    return lookups.comm_threads_view(f.comm_threads, f.comms, f.threads)


@query("v_call_paths")
def _(f: Fixture) -> DataFrame:
    return lookups.call_paths_view(f.call_paths, f.symbols, f.dsos)


@query("v_calls")
def _(f: Fixture) -> DataFrame:
    return lookups.calls_view(f.calls, f.call_paths, f.symbols, f.threads, f.comms)


@query("v_samples")
def _(f: Fixture) -> DataFrame:
    return lookups.samples_view(
        f.samples, f.selected_events, f.symbols, f.branch_types, f.dsos, f.threads, f.comms
    )


@query("v_ptwrite")
def _(f: Fixture) -> DataFrame:
    return lookups.ptwrite_view(packets.decode_ptwrite(f.packets), f.samples)


@query("v_cbr")
def _(f: Fixture) -> DataFrame:
    return lookups.cbr_view(packets.decode_cbr(f.packets), f.samples)


@query("v_mwait")
def _(f: Fixture) -> DataFrame:
    return lookups.mwait_view(packets.decode_mwait(f.packets), f.samples)


@query("v_pwre")
def _(f: Fixture) -> DataFrame:
    return lookups.pwre_view(packets.decode_pwre(f.packets), f.samples)


@query("v_exstop")
def _(f: Fixture) -> DataFrame:
    return lookups.exstop_view(packets.decode_exstop(f.packets), f.samples)


@query("v_pwrx")
def _(f: Fixture) -> DataFrame:
    return lookups.pwrx_view(packets.decode_pwrx(f.packets), f.samples)


@query("v_power_events")
def _(f: Fixture) -> DataFrame:
    p = f.packets
    return lookups.power_events_view(
        f.samples,
        f.selected_events,
        packets.decode_cbr(p),
        packets.decode_mwait(p),
        packets.decode_pwre(p),
        packets.decode_exstop(p),
        packets.decode_pwrx(p),
    )


@query("v_context_switches")
def _(f: Fixture) -> DataFrame:
    return lookups.context_switches_view(f.context_switches, f.threads, f.comms)


@query("v_auxtrace_errors")
def _(f: Fixture) -> DataFrame:
    return lookups.auxtrace_errors_view(gaps.number_errors(f.auxtrace_errors, SLICE_ROWS))


# Ranges and IPC ------------------------------------------------------------------------------------------


@query("timestamped_samples")
def _(f: Fixture) -> DataFrame:
    return ranges.timestamped_samples(f.samples).select("id", "time", "insn_count", "cyc_count")


@query("trace_extent")
def _(f: Fixture) -> DataFrame:
    return ranges.trace_extent(f.samples)


@query("prefix_sums")
def _(f: Fixture) -> DataFrame:
    return ordered_scan(
        ranges.timestamped_samples(f.samples).select("id", "cpu", "insn_count", "cyc_count"),
        "id",
        keys=["cpu"],
        sums={"cum_insns": "insn_count", "cum_cyc": "cyc_count"},
        row_number="row_number",
        slices=WIDTH,
    )


@query("timestamped_ranges")
def _(f: Fixture) -> DataFrame:
    plain = ranges.timestamped_ranges(
        f.samples, names=["evsel_id", "symbol_id", "to_symbol_id", "branch_type"], slices=WIDTH
    )
    named = lookups.sample_names(plain, f.selected_events, f.symbols, f.branch_types)
    return named.drop("evsel_id", "symbol_id", "to_symbol_id", "branch_type")


@query("time_bounds")
def _(f: Fixture) -> DataFrame:
    return ranges.time_bounds(ranges.timestamped_ranges(f.samples, slices=WIDTH), view(f))


@query("view_window_filter")
def _(f: Fixture) -> DataFrame:
    v = view(f)
    return ranges.timestamped_ranges(f.samples, slices=WIDTH).filter(
        F.col("end_time").between(v.start, v.end)
    ).select("end_sample_id", "end_time", "end_cum_cyc")


def _clocked(f: Fixture) -> tuple[DataFrame, ranges.CycleClock]:
    stored = fixture_ranges(f)
    return stored, ranges.CycleClock.from_bounds(ranges.time_bounds(stored, view(f)))


@query("raw_ipc")
def _(f: Fixture) -> DataFrame:
    stored, clock = _clocked(f)
    return ranges.raw_ipc(ranges.in_cycles(stored, clock))


@query("long_ranges")
def _(f: Fixture) -> DataFrame:
    stored, clock = _clocked(f)
    return ranges.long_ranges(ranges.raw_ipc(ranges.in_cycles(stored, clock)), LONG_LIMIT)


@query("cycle_to_ns")
def _(f: Fixture) -> DataFrame:
    stored, clock = _clocked(f)
    return stored.select(
        "end_sample_id",
        clock.time(F.col("end_cum_cyc")).alias("end_ns"),
        clock.duration(F.col("cyc_count")).alias("duration_ns"),
    )


@query("asof_forward_left")
def _(f: Fixture) -> DataFrame:
    stored = fixture_ranges(f)
    edges = stored.select("end_sample_id", (F.col("end_cum_cyc") - WINDOW).alias("edge_cyc"))
    return asof_join(
        edges,
        stored,
        left_on="edge_cyc",
        right_on="end_cum_cyc",
        right_id="end_sample_id",
        columns={"trailing_sample_id": "end_sample_id", "trailing_end_cum_cyc": "end_cum_cyc"},
        how="left",
        rows_per_slice=SLICE_ROWS,
    )


@query("asof_forward_inner_ge")
def _(f: Fixture) -> DataFrame:
    stored = fixture_ranges(f)
    edges = stored.select("end_sample_id", (F.col("end_cum_cyc") + (WINDOW - 1)).alias("edge_cyc"))
    return asof_join(
        edges,
        stored,
        left_on="edge_cyc",
        right_on="end_cum_cyc",
        right_id="end_sample_id",
        columns={"leading_sample_id": "end_sample_id", "leading_end_cum_cyc": "end_cum_cyc"},
        allow_equal=True,
        how="inner",
        rows_per_slice=SLICE_ROWS,
    )


@query("sliding_window")
def _(f: Fixture) -> DataFrame:
    return ipc.window_rows(ipc.sliding_window(fixture_ranges(f), WINDOW, rows_per_slice=SLICE_ROWS))


@query("ipc_spans")
def ipc_spans(f: Fixture) -> DataFrame:
    window = ipc.sliding_window(fixture_ranges(f), WINDOW, rows_per_slice=SLICE_ROWS)
    return ipc.ipc_spans(window, WINDOW)


@query("ipc_spans_ordered")
def _(f: Fixture) -> DataFrame:
    """Spans written in order to several files, and numbered by reading these."""
    path = new_folder(f, "ordered")
    write_ordered(materialise(ipc_spans(f), "spans"), path, ["window_end_cum_cyc"], SLICE_ROWS)
    columns = ["window_end_cum_cyc", "window_start_cum_cyc", "interior_insns", "span_width_cyc"]
    return read_ordered(f.spark, path).select("place", *columns)


# Calls and the event timeline ----------------------------------------------------------------------------


@query("calls_by_symbol")
def _(f: Fixture) -> DataFrame:
    return timeline.calls_by_symbol(f.calls, f.call_paths, f.symbols, f.dsos, "do_syscall_64")


@query("ancestor_walk")
def _(f: Fixture) -> DataFrame:
    return ancestor_pairs(f.calls, columns=["call_path_id", "call_time", "return_time"])


@query("stack_summary")
def _(f: Fixture) -> DataFrame:
    summary = timeline.stack_summary(call_stacks(f), view(f))
    return summary.withColumn("symbol_list", F.concat_ws(",", "symbol_list"))


@query("full_syscalls")
def _(f: Fixture) -> DataFrame:
    return timeline.syscalls_of(timeline.marked_frames(named_calls(f), view(f)))


@query("full_syscalls_near_view")
def _(f: Fixture) -> DataFrame:
    """From the stacks near the view, as whole chains of frames."""
    v = view(f)
    near = timeline.calls_near(f.calls, v)
    return timeline.full_syscalls(timeline.stacks(near, f.call_paths, f.symbols, f.dsos), v)


@query("whole_syscalls")
def _(f: Fixture) -> DataFrame:
    return whole_syscalls(f)


@query("kernel_context_switches")
def _(f: Fixture) -> DataFrame:
    return kernel_switches(f)


@query("next_switch")
def _(f: Fixture) -> DataFrame:
    raw = f.context_switches.select("id", "cpu", "time")
    later = raw.select("id", "cpu", F.col("time").alias("next_time"))
    return asof_join(
        raw,
        later,
        left_on="time",
        right_on="next_time",
        right_id="id",
        columns={"next_id": "id", "next_time": "next_time"},
        keys=["cpu"],
        how="left",
        rows_per_slice=SLICE_ROWS,
    )


@query("start_end_pairing")
def _(f: Fixture) -> DataFrame:
    syscalls = materialise(whole_syscalls(f), "syscalls")
    starts = syscalls.select(F.col("call_id").alias("start_id"), F.col("call_time").alias("start_time"))
    return asof_join(
        starts,
        syscalls,
        left_on="start_time",
        right_on="return_time",
        right_id="call_id",
        columns={"end_time": "return_time"},
        how="inner",
        rows_per_slice=SLICE_ROWS,
    )


@query("union_events")
def _(f: Fixture) -> DataFrame:
    v = view(f)
    starts, ends = timeline.timeline_marks(kernel_switches(f), stored_syscalls(f, v), v)
    return starts.withColumn("side", F.lit("start")).unionByName(ends.withColumn("side", F.lit("end")))


@query("on_cpu_syscalls")
def _(f: Fixture) -> DataFrame:
    return on_cpu(f, view(f))


@query("on_cpu_violations")
def _(f: Fixture) -> DataFrame:
    v = view(f)
    return timeline.on_cpu_violations(on_cpu(f, v), v)


@query("endpoint_in_view")
def _(f: Fixture) -> DataFrame:
    v = view(f)
    return timeline.on_cpu_labels(on_cpu(f, v), v)


@query("spans_by_label")
def _(f: Fixture) -> DataFrame:
    named = stored_syscalls(f, view(f)).withColumnRenamed("syscall_kernel_name", "name")
    return timeline.spans_by_label(named, "call_time", "return_time")


@query("errors_and_ranges")
def _(f: Fixture) -> DataFrame:
    return timeline.errors_and_ranges(f.auxtrace_errors, fixture_ranges(f), SLICE_ROWS)


@query("overflow_in_view")
def _(f: Fixture) -> DataFrame:
    covered = timeline.errors_and_ranges(f.auxtrace_errors, fixture_ranges(f), SLICE_ROWS)
    return timeline.overflow_in_view(covered, view(f))


@query("interval_in_view")
def _(f: Fixture) -> DataFrame:
    v = view(f)
    whole = timeline.touches(F.col("call_time"), F.col("return_time"), v.start, v.end)
    return f.calls.filter(whole).select("id", "call_time", "return_time")


@query("switch_timeline")
def _(f: Fixture) -> DataFrame:
    return timeline.switch_timeline(f.context_switches, f.threads, f.comms, view(f))


def latencies(f: Fixture) -> DataFrame:
    return timeline.iteration_latency(materialise(whole_syscalls(f), "syscalls"), LATENCY_CALLS, rows_per_slice=SLICE_ROWS)


@query("iteration_latency")
def _(f: Fixture) -> DataFrame:
    return latencies(f)


@query("log_histogram")
def _(f: Fixture) -> DataFrame:
    return rounded_edges(distribution.latency_histogram(materialise(latencies(f), "latency")))


def rounded_edges(histogram: DataFrame) -> DataFrame:
    return histogram.withColumns({c: F.round(c, 3) for c in ("lower_edge", "upper_edge")})


@query("interval_overlap_join")
def _(f: Fixture) -> DataFrame:
    hour = 3_600_000_000
    a = f.ev.select(
        "user_id", F.col("id").alias("a_id"), F.col("time").alias("a_start"), (F.col("time") + 6 * hour).alias("a_end")
    )
    b = f.ev.select(
        "user_id", F.col("id").alias("b_id"), F.col("time").alias("b_start"), (F.col("time") + 4 * hour).alias("b_end")
    )
    pairs = overlap_join(
        a, b, a_interval=("a_start", "a_end"), b_interval=("b_start", "b_end"), keys=["user_id"]
    )
    return pairs.select("a_id", "b_id", "overlap_start", "overlap_end")


# Distributions -------------------------------------------------------------------------------------------


@query("samples_for_cdf")
def _(f: Fixture) -> DataFrame:
    return distribution.samples_for_cdf(counted_samples(f), width=SLICE_ROWS)


@query("range_cdf")
def _(f: Fixture) -> DataFrame:
    return distribution.range_cdf(counted_samples(f), width=SLICE_ROWS)


@query("cdf_tail")
def _(f: Fixture) -> DataFrame:
    return distribution.cdf_tail(distribution.range_cdf(counted_samples(f), width=SLICE_ROWS))


@query("insn_class_share")
def _(f: Fixture) -> DataFrame:
    return distribution.insn_class_share(counted_samples(f), width=SLICE_ROWS)


@query("log_histogram_weighted")
def _(f: Fixture) -> DataFrame:
    shares = materialise(distribution.insn_class_share(counted_samples(f), width=SLICE_ROWS), "shares")
    found = rounded_edges(distribution.weighted_histogram(shares))
    weights = [c for c in found.columns if c.startswith("weighted_insn_count_")]
    return found.withColumns({c: F.round(c, 9) for c in weights})


# Errors and gaps -----------------------------------------------------------------------------------------


@query("error_gaps")
def _(f: Fixture) -> DataFrame:
    errors = gaps.number_errors(f.auxtrace_errors, SLICE_ROWS)
    return gaps.error_gaps(errors, f.sample_names(), SLICE_ROWS)


@query("errors_begin_one_to_one")
def _(f: Fixture) -> DataFrame:
    errors = gaps.number_errors(f.begin_errors, SLICE_ROWS).select("id", "time")
    return gaps.errors_begin_one_to_one(errors, f.sample_names())


@query("error_free_ranges")
def _(f: Fixture) -> DataFrame:
    return gaps.error_free_ranges(f.sample_names(), SLICE_ROWS)


@query("top_error_free_ranges")
def _(f: Fixture) -> DataFrame:
    return gaps.top_error_free_ranges(gaps.error_free_ranges(f.sample_names(), SLICE_ROWS))


# Trials --------------------------------------------------------------------------------------------------


def statistics(f: Fixture) -> DataFrame:
    found = trials.connection_statistics(f.connections)
    return found.withColumns({c: F.round(c, 6) for c in ("averageCount", "StdDevCount")})


@query("connection_statistics")
def _(f: Fixture) -> DataFrame:
    return statistics(f)


@query("total_iterations")
def _(f: Fixture) -> DataFrame:
    return trials.total_iterations(f.connections)


@query("trial_metrics_json")
def _(f: Fixture) -> DataFrame:
    path = f"{shared_folder(f.spark).rstrip('/')}/traceloom/metrics-{uuid.uuid4().hex}"
    trials.write_metrics(trials.metrics_json(statistics(f)), path)
    return trials.read_metrics(f.spark, path)


def configs(f: Fixture) -> DataFrame:
    """One configuration per trial, as JSON text, made from the clients seen in it."""
    clients = f.connections.groupBy("trial").agg(F.count(F.lit(1)).alias("clients"))
    config = F.struct(
        F.concat(F.lit("driver-"), "trial").alias("server_driver"),
        F.lit(20).alias("server_sleep_duration_millis"),
        F.lit("go").alias("client_driver"),
        F.col("clients").alias("client_num_clients"),
        F.lit(10).alias("test_duration_secs"),
    )
    return clients.select("trial", F.to_json(config).alias("config"))


@query("trial_results")
def _(f: Fixture) -> DataFrame:
    return trials.trial_results(configs(f), statistics(f))


@query("throughput_report")
def _(f: Fixture) -> DataFrame:
    per_trial = f.connections.groupBy("trial").agg(F.sum("count").alias("iterations"))
    flags = tables.trial_flags(F.col("trial"))
    measured = per_trial.select(
        "trial", flags["mode"].alias("mode"), "iterations", F.lit(10).cast("long").alias("seconds")
    )
    return trials.throughput_report(measured, F.col("trial") == F.col("mode"))


# Logs ----------------------------------------------------------------------------------------------------

STREAM_KEYS = ["conv_id", "command_index", "output_stream_name"]


def line_time() -> Column:
    return (F.col("conv_id") * 1000 + F.col("line_no")).cast("string")


@query("log_lines")
def _(f: Fixture) -> DataFrame:
    return loglines.split_lines(f.driver("documents"), "text", ["doc_id"])


@query("log_wrap")
def _(f: Fixture) -> DataFrame:
    return loglines.wrap(f.log_lines, line_time()).select("conv_id", "line_no", "record")


@query("log_normalize")
def _(f: Fixture) -> DataFrame:
    done = loglines.normalise(f.log_lines, STREAM_KEYS, line_time())
    return done.select("conv_id", "line_no", "passes", "output")


@query("log_normalize_stream")
def _(f: Fixture) -> DataFrame:
    folder = f"{shared_folder(f.spark).rstrip('/')}/traceloom/stream-{uuid.uuid4().hex}"
    lines = f.log_lines
    lines.repartition(4, "conv_id").write.parquet(f"{folder}/input")
    arriving = f.spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/input")
    normalise_stream(arriving, folder, keys=STREAM_KEYS, time=line_time()).awaitTermination()
    return f.spark.read.parquet(f"{folder}/output").select("conv_id", "line_no", "passes", "output")


@query("log_attrs")
def _(f: Fixture) -> DataFrame:
    config = F.to_json(
        F.struct(
            F.col("output_stream_name").alias("server_driver"),
            (F.col("conv_id") % 50).alias("server_sleep_duration_millis"),
            F.lit("go").alias("client_driver"),
            F.col("line_no").alias("client_num_clients"),
            F.lit(10).alias("test_duration_secs"),
        )
    )
    attributed = loglines.with_attributes(f.log_lines, "supervisor", config, trials.CONFIG_DDL)
    return attributed.select("conv_id", "line_no", "app", "trial_config.*")


@query("log_errors")
def _(f: Fixture) -> DataFrame:
    found = loglines.alerts(loglines.parse_records(f.record_lines))
    return found.select("time", "level", "msg", "command_index", "output_stream_name", "line")


@query("command_events")
def _(f: Fixture) -> DataFrame:
    return loglines.command_events(loglines.parse_records(f.record_lines))


@query("command_output")
def _(f: Fixture) -> DataFrame:
    return loglines.command_output(loglines.parse_records(f.record_lines), 0, "stdout")


@query("command_output_ordered")
def _(f: Fixture) -> DataFrame:
    found = loglines.command_output(loglines.parse_records(f.record_lines), 0, "stdout")
    path = new_folder(f, "ordered")
    timed = materialise(found.withColumn("at", F.col("time").cast("long")), "output")
    write_ordered(timed, path, ["at", "line"], SLICE_ROWS)
    return read_ordered(f.spark, path).select("place", "time", "line")


@query("log_normalize_files")
def _(f: Fixture) -> DataFrame:
    """Lines of text files that are read in splits of 16 KB."""
    folder, setting = f.line_files(new_folder(f, "lines")), "spark.sql.files.maxPartitionBytes"
    before = f.spark.conf.get(setting)
    f.spark.conf.set(setting, str(1 << 14))
    try:
        lines = loglines.numbered_lines(f.spark, f"{folder}/*")
    finally:
        f.spark.conf.set(setting, before)
    quarter = F.regexp_extract("file", r"quarter=(\d+)", 1).cast("long")
    named = lines.select(
        quarter.alias("quarter"), "line_no", "line", F.lit(0).alias("command_index"), F.lit("stdout").alias("output_stream_name")
    )
    done = loglines.normalise(named, ["quarter"], F.col("line_no").cast("string"))
    return done.select("quarter", "line_no", "passes", "output")


# Overlays ------------------------------------------------------------------------------------------------


@query("ipc_buckets")
def _(f: Fixture) -> DataFrame:
    buckets = overlays.ipc_buckets(ranges.timestamped_ranges(f.samples, slices=WIDTH), 2 * WINDOW, WINDOW)
    return buckets.withColumns({c: F.round(c, 6) for c in ("insns", "ipc")})


@query("event_aligned_ipc")
def _(f: Fixture) -> DataFrame:
    minute = 60_000_000
    aligned = overlays.event_aligned_ipc(
        fixture_ranges(f), f.context_switches.select("time"), 60 * minute, 60 * minute, 5 * minute,
        rows_per_slice=SLICE_ROWS,
    )
    return aligned.withColumns({c: F.round(c, 2) for c in ("insns", "cycles", "ipc")})


@query("zero_fill_gaps")
def _(f: Fixture) -> DataFrame:
    return overlays.zero_fill_gaps(named_ranges(f), f.auxtrace_errors, SLICE_ROWS, WIDTH)


@query("thread_on_cpu_calls")
def _(f: Fixture) -> DataFrame:
    found = overlays.thread_on_cpu_calls(f.context_switches, f.calls, SLICE_ROWS)
    return found.select("thread_id", "cpu", "call_id", "overlap_start", "overlap_end")


@query("on_cpu_time")
def _(f: Fixture) -> DataFrame:
    return overlays.on_cpu_time(f.context_switches, f.calls, SLICE_ROWS)


@query("perf_overhead")
def _(f: Fixture) -> DataFrame:
    return overlays.perf_overhead(
        f.calls,
        f.call_paths,
        f.symbols,
        f.dsos,
        rows_per_slice=SLICE_ROWS,
    )


@query("transition_counts")
def _(f: Fixture) -> DataFrame:
    return overlays.transition_counts(f.sample_names(), "branch_type_name", at_least=10)


@query("folded_stacks")
def _(f: Fixture) -> DataFrame:
    return overlays.folded_stacks(materialise(named_calls(f), "frames"))


# Several trials and CPUs in one plan ---------------------------------------------------------------------

PLACES = ["trial", "cpu"]


def trials_query(name: str) -> Callable[[Callable[[Trials], DataFrame]], Callable[[Trials], DataFrame]]:
    def register(build: Callable[[Trials], DataFrame]) -> Callable[[Trials], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Trials(spark, sf_dir))
        return build

    return register


def trial_ranges(t: Trials) -> DataFrame:
    """Ranges of each CPU of each trial, on axes of their own."""
    samples = materialise(t.of(lambda f: f.sample_names()), "samples")
    places = slice_directory(ranges.timestamped_samples(samples), "id", keys=PLACES, rows_per_slice=SLICE_ROWS)
    return ranges.stored_ranges(samples, keys=PLACES, names=["branch_type_name"], slices=places)


def trial_clocks(t: Trials, stored: DataFrame) -> DataFrame:
    views = ranges.middle_views(t.of(lambda f: f.samples), PLACES, DAY)
    return materialise(ranges.clocks(stored, views, PLACES), "clocks")


@trials_query("trials_ranges")
def _(t: Trials) -> DataFrame:
    return trial_ranges(t)


@trials_query("trials_clocks")
def _(t: Trials) -> DataFrame:
    return trial_clocks(t, trial_ranges(t))


@trials_query("trials_view_ipc")
def _(t: Trials) -> DataFrame:
    stored = trial_ranges(t)
    timed = ranges.on_clocks(stored, trial_clocks(t, stored), PLACES).filter("in_view")
    return timed.select(*PLACES, "end_sample_id", ratio(F.col("insn_count"), F.col("cyc_count")).alias("ipc"), "end_ns", "duration_ns")


@trials_query("trials_ipc_spans")
def _(t: Trials) -> DataFrame:
    stored = trial_ranges(t)
    window = ipc.sliding_window(stored, WINDOW, keys=PLACES, rows_per_slice=SLICE_ROWS)
    return ipc.ipc_spans(window, WINDOW, keys=PLACES)


@trials_query("trials_ipc_buckets")
def _(t: Trials) -> DataFrame:
    buckets = overlays.ipc_buckets(trial_ranges(t), 2 * WINDOW, WINDOW, PLACES)
    return buckets.withColumns({c: F.round(c, 6) for c in ("insns", "ipc")})


@trials_query("trials_range_cdf")
def _(t: Trials) -> DataFrame:
    return distribution.range_cdf(t.of(counted_samples), width=SLICE_ROWS, keys=["trial"])


@trials_query("trials_insn_class_share")
def _(t: Trials) -> DataFrame:
    return distribution.insn_class_share(t.of(counted_samples), width=SLICE_ROWS, keys=["trial"])


@trials_query("trials_error_gaps")
def _(t: Trials) -> DataFrame:
    errors = gaps.number_errors(t.of(lambda f: f.auxtrace_errors), SLICE_ROWS, keys=["trial"])
    return gaps.error_gaps(errors, t.of(lambda f: f.sample_names()), SLICE_ROWS, keys=["trial"])


def trial_views(t: Trials) -> DataFrame:
    return materialise(ranges.middle_views(t.of(lambda f: f.samples), ["trial"], DAY), "views")


def trial_dims(t: Trials) -> list[DataFrame]:
    return [t.of(lambda f: f.call_paths), t.of(lambda f: f.symbols), t.of(lambda f: f.dsos)]


def trial_syscalls(t: Trials, views: DataFrame) -> DataFrame:
    named = timeline.calls_with_symbols(t.of(lambda f: f.calls), *trial_dims(t), keys=["trial"])
    return timeline.syscalls_of(timeline.marked_frames(named, views, ["trial"]), ["trial"])


@trials_query("trials_full_syscalls")
def _(t: Trials) -> DataFrame:
    return trial_syscalls(t, trial_views(t))


@trials_query("trials_on_cpu_syscalls")
def _(t: Trials) -> DataFrame:
    views = trial_views(t)
    switches = timeline.kernel_context_switches(t.of(lambda f: f.calls), *trial_dims(t), SLICE_ROWS, keys=["trial"])
    return timeline.on_cpu_syscalls(
        materialise(switches, "switches"), materialise(trial_syscalls(t, views), "syscalls"), views, SLICE_ROWS, keys=["trial"]
    )


@trials_query("trials_ancestor_walk")
def _(t: Trials) -> DataFrame:
    columns = ["call_path_id", "call_time", "return_time"]
    return ancestor_pairs(materialise(t.of(lambda f: f.calls), "calls"), columns=columns, keys=["trial"])


@trials_query("trials_folded_stacks")
def _(t: Trials) -> DataFrame:
    named = timeline.calls_with_symbols(t.of(lambda f: f.calls), *trial_dims(t), keys=["trial"])
    return overlays.folded_stacks(materialise(named, "frames"), keys=["trial"])
