"""The expected result of each registered query as SQL over the driver tables."""

from __future__ import annotations

from checks.fixture import LONG_LIMIT, WINDOW
from checks.fixture_sql import per_trial, with_ctes
from traceloom.sources.schemas import TABLE_DDL

BODIES: dict[str, str] = {}

RANGE_COLUMNS = (
    "start_sample_id, start_time, start_offset_time, start_cum_insns, start_cum_cyc, end_sample_id, end_time, "
    "end_offset_time, end_cum_insns, end_cum_cyc, end_sample_row_number, insn_count, cyc_count"
)
IPC = "case when cyc_count = 0 then 0.0::double else ((200 * insn_count + cyc_count) // (2 * cyc_count)) / 100.0::double end"
HOST = "case when m.id = 0 then 'unknown' when m.pid = -1 then 'host' when m.id is not null then 'guest' end"


def _hex(column: str) -> str:
    return f"lower(to_hex({column}))"


def _truth(column: str) -> str:
    return f"case when {column} = 0 then 'False' else 'True' end"


def _histogram(rows: str, value: str, bins: int, measures: str, outputs: str, low: str, high: str) -> str:
    extent = f"(select log10(min({value}) * {low}) as low, log10(max({value}) * {high}) as high from {rows})"
    zeros = ", ".join(f"coalesce({c}, 0) as {c}" for c in outputs.split(", "))
    return f"""
select b.bin, round(pow(10.0::double, low + b.bin * ((high - low) / {bins})), 3) as lower_edge,
  round(pow(10.0::double, low + (b.bin + 1) * ((high - low) / {bins})), 3) as upper_edge, {zeros}
from (select unnest(range({bins})) as bin) as b cross join {extent} as x left join (select bin as filled, {measures} from (
    select *, cast(greatest(0, least({bins - 1}, floor(
      (log10(cast({value} as double)) - low) / (high - low) * {bins}))) as bigint) as bin
    from {rows}, {extent} as x)
  group by bin) on filled = b.bin
where high > low or (b.bin = 0 and low is not null)
"""


BODIES["trace_tables"] = """
select 'samples' as table_name, count(*) as row_count, cast(sum(id) as bigint) as id_sum from samples
union all select 'threads', count(*), cast(sum(id) as bigint) from threads
union all select 'comms', count(*), cast(sum(id) as bigint) from comms
union all select 'symbols', count(*), cast(sum(id) as bigint) from symbols
union all select 'cbr', count(*), cast(sum(id) as bigint) from cbr
union all select 'ptwrite', 0, 0
"""
def columns_of(table: str) -> list[str]:
    return [column.split()[0] for column in TABLE_DDL[table].split(", ")]


_TEXT = "coalesce(cast({} as varchar), '~')"


def _contents(table: str, count: str = "count(*)") -> str:
    """Number of rows and the sum of a digest of each, over all columns in their declared order."""
    row = " || '|' || ".join(_TEXT.format(f) for f in columns_of(table))
    digest = f"('0x' || substr(md5({row}), 1, 8))::bigint"
    return f"select '{table}' as table_name, {count} as row_count, cast(sum({digest}) as bigint) as content from {table}"


BODIES["published_tables"] = " union all ".join(_contents(table) for table in TABLE_DDL)
BODIES["published_branches_layout"] = _contents("samples").replace("from samples", """
from (select * replace (null as period, null as weight, null as transaction_, null as data_src) from samples)""")
BODIES["publish_replace_recover"] = """
select 'first' as step, (select count(*) from threads) as row_count, 'ok' as outcome
union all select 'again', (select count(*) from threads), 'refused'
union all select 'broken', (select count(*) from threads), 'failed'
union all select 'replaced', (select count(*) from threads where id % 2 = 0), 'ok'
"""
BODIES["ipc_spans_ordered"] = f"""
select row_number() over (order by window_end_cum_cyc) - 1 as place, window_end_cum_cyc, window_start_cum_cyc,
  interior_insns, span_width_cyc from spans
"""
BODIES["samples_branches"] = "select * exclude (period, weight, transaction_, data_src) from samples"
BODIES["dim_sentinel"] = "select * from threads"
for _kind in ("ptwrite", "mwait", "pwre", "exstop", "pwrx", "cbr"):
    BODIES[f"decode_{_kind}"] = f"select * from {_kind}"
KIND = (
    "case config when 0 then 'ptwrite' when 1 then 'mwait' when 2 then 'pwre' when 3 then 'exstop' when 4 then 'pwrx' "
    "when 5 then 'cbr' else 'unhandled' end"
)
BODIES["packet_dispatch"] = f"""
select {KIND} as kind, config, count(*) as packets, min(id) as first_id, max(id) as last_id from packets group by config
"""
BODIES["packet_rejects"] = f"select {KIND} as kind, count(*) as packets from packets group by 1"
BODIES["trial_flags"] = """
select trial, split_part(trial, '_', 1) as mode,
  list_contains(string_split(trial, '_'), 'retcomp') as retcomp,
  list_contains(string_split(trial, '_'), 'kernelonly') as kernelonly,
  list_contains(string_split(trial, '_'), 'noswitchevents') as noswitchevents
from (select distinct trial from connections)
"""

BODIES["v_machines"] = f"select id, pid, root_dir, {HOST} as host_or_guest from machines as m"
BODIES["v_dsos"] = f"""
select d.id, machine_id, {HOST} as host_or_guest, short_name, long_name, build_id
from dsos as d left join machines as m on m.id = d.machine_id
"""
BODIES["v_symbols"] = """
select s.id, s.name, d.short_name as dso, dso_id, sym_start, sym_end,
  case binding when 0 then 'local' when 1 then 'global' else 'weak' end as binding
from symbols as s left join dsos as d on d.id = s.dso_id
"""
BODIES["v_threads"] = f"""
select t.id, machine_id, {HOST} as host_or_guest, process_id, t.pid, tid
from threads as t left join machines as m on m.id = t.machine_id
"""
BODIES["v_comm_threads"] = """
select comm_id, c.comm as command, thread_id, t.pid, t.tid
from comm_threads as x left join comms as c on c.id = x.comm_id left join threads as t on t.id = x.thread_id
"""
BODIES["v_call_paths"] = f"""
select c.id, {_hex('c.ip')} as ip, c.symbol_id, s.name as symbol, s.dso_id, d.short_name as dso_short_name,
  c.parent_id, {_hex('p.ip')} as parent_ip, p.symbol_id as parent_symbol_id, ps.name as parent_symbol,
  ps.dso_id as parent_dso_id, pd.short_name as parent_dso_short_name
from call_paths as c join call_paths as p on p.id = c.parent_id
  left join symbols as s on s.id = c.symbol_id left join dsos as d on d.id = s.dso_id
  left join symbols as ps on ps.id = p.symbol_id left join dsos as pd on pd.id = ps.dso_id
"""
BODIES["v_calls"] = f"""
select c.id, thread_id, t.pid, t.tid, m.comm as command, call_path_id, {_hex('p.ip')} as ip, p.symbol_id,
  s.name as symbol, call_time, return_time, return_time - call_time as elapsed_time, branch_count, insn_count, cyc_count,
  {IPC} as "IPC", call_id, return_id,
  case flags when 0 then '' when 1 then 'no call' when 2 then 'no return' when 3 then 'no call/return' when 6 then 'jump'
    else cast(flags as varchar) end as flags, parent_call_path_id, c.parent_id
from calls as c join call_paths as p on p.id = c.call_path_id left join threads as t on t.id = c.thread_id
  left join comms as m on m.id = c.comm_id left join symbols as s on s.id = p.symbol_id
"""
BODIES["v_samples"] = f"""
select n.id, time, cpu, t.pid, t.tid, m.comm as command, event, {_hex('ip')} as ip_hex, symbol, sym_offset,
  d.short_name as dso_short_name, {_hex('to_ip')} as to_ip_hex, to_symbol, to_sym_offset,
  e.short_name as to_dso_short_name, branch_type_name, in_tx, insn_count, cyc_count, {IPC} as "IPC", flags
from named as n left join threads as t on t.id = n.thread_id left join comms as m on m.id = n.comm_id
  left join dsos as d on d.id = n.dso_id left join dsos as e on e.id = n.to_dso_id
"""
WAKE = (
    "case wake_reason when 1 then 'Interrupt' when 2 then 'Timer Deadline' when 4 then 'Monitored Address' "
    "when 8 then 'HW' else cast(wake_reason as varchar) end"
)
for _name, _columns in {
    "ptwrite": f"{_hex('payload')} as payload_hex, {_truth('exact_ip')} as exact_ip",
    "cbr": "cbr, mhz, percent",
    "mwait": f"{_hex('hints')} as hints_hex, {_hex('extensions')} as extensions_hex",
    "pwre": f"cstate, subcstate, {_truth('hw')} as hw",
    "exstop": f"{_truth('exact_ip')} as exact_ip",
    "pwrx": f"deepest_cstate, last_cstate, {WAKE} as wake_reason",
}.items():
    BODIES[f"v_{_name}"] = f"select id, time, samples.cpu, {_columns} from {_name} join samples using (id)"
BODIES["v_power_events"] = f"""
select s.id, time, cpu, e.name as event, c.cbr, c.mhz, c.percent, {_hex('m.hints')} as hints_hex,
  {_hex('m.extensions')} as extensions_hex, p.cstate, p.subcstate, p.hw, x.exact_ip, w.deepest_cstate, w.last_cstate,
  case when w.id is not null then {WAKE} end as wake_reason
from samples as s join selected_events as e on e.id = s.evsel_id
  left join cbr as c on c.id = s.id and e.name = 'cbr' left join mwait as m on m.id = s.id and e.name = 'mwait'
  left join pwre as p on p.id = s.id and e.name = 'pwre' left join exstop as x on x.id = s.id and e.name = 'exstop'
  left join pwrx as w on w.id = s.id and e.name = 'pwrx'
where e.name in ('cbr', 'mwait', 'exstop', 'pwre', 'pwrx')
"""
BODIES["v_context_switches"] = """
select c.id, c.machine_id, time, cpu, o.pid as pid_out, o.tid as tid_out, co.comm as comm_out, i.pid as pid_in,
  i.tid as tid_in, ci.comm as comm_in,
  case flags when 0 then 'in' when 1 then 'out' when 3 then 'out preempt' else cast(flags as varchar) end as flags
from context_switches as c join threads as o on o.id = thread_out_id join threads as i on i.id = thread_in_id
  join comms as co on co.id = comm_out_id join comms as ci on ci.id = comm_in_id
"""
BODIES["v_auxtrace_errors"] = f"""
select id, time, cpu, pid, tid, case type when 1 then 'ITRACE' when 2 then 'MAX' else cast(type as varchar) end as type,
  ['NOMEM', 'INTERN', 'BADPKT', 'NODATA', 'NOINSN', 'MISMAT', 'OVR', 'LOST', 'UNK', 'NELOOP', 'EPTW', 'MAX'][code] as code,
  {_hex('ip')} as ip_hex, msg, cpumode, machine_pid, vcpu from error_rows
"""

BODIES["timestamped_samples"] = "select id, time, insn_count, cyc_count from counted"
BODIES["trace_extent"] = """
select min(time) filter (where time > 0) as first_time, max(time) as last_time,
  cast(sum(insn_count) as bigint) as total_insns, cast(sum(cyc_count) as bigint) as total_cyc from counted
"""
BODIES["prefix_sums"] = """
select id, cpu, insn_count, cyc_count, cast(sum(insn_count) over w as bigint) as cum_insns,
  cast(sum(cyc_count) over w as bigint) as cum_cyc, row_number() over w as row_number
from samples where insn_count > 0 or cyc_count > 0 window w as (partition by cpu order by id)
"""
BODIES["timestamped_ranges"] = f"select {RANGE_COLUMNS}, event, symbol, to_symbol, branch_type_name from ranges"
BODIES["time_bounds"] = "select ns, cyc from bounds"
BODIES["view_window_filter"] = """
select end_sample_id, end_time, end_cum_cyc from ranges, view_ where end_time between low and high
"""
_RAW = """
select start_cum_cyc, end_cum_cyc, cast(insn_count as double) / nullif(cyc_count, 0) as ipc, cyc_count from ranges
where end_cum_cyc between (select min(cyc) from bounds) and (select max(cyc) from bounds)
"""
BODIES["raw_ipc"] = _RAW
BODIES["long_ranges"] = f"select * from ({_RAW}) where cyc_count > {LONG_LIMIT}"
BODIES["cycle_to_ns"] = """
select end_sample_id, start_ns + (end_cum_cyc - start_cyc) * rate as end_ns, cyc_count * rate as duration_ns
from ranges, clock
"""
BODIES["asof_forward_left"] = f"""
select l.end_sample_id, edge_cyc, t.end_sample_id as trailing_sample_id, t.end_cum_cyc as trailing_end_cum_cyc
from (select end_sample_id, end_cum_cyc - {WINDOW} as edge_cyc from ranges) as l
  asof left join ranges as t on t.end_cum_cyc > l.edge_cyc
"""
BODIES["asof_forward_inner_ge"] = f"""
select t.end_sample_id, edge_cyc, l.end_sample_id as leading_sample_id, l.end_cum_cyc as leading_end_cum_cyc
from (select end_sample_id, end_cum_cyc + {WINDOW} - 1 as edge_cyc from ranges) as t
  asof join ranges as l on l.end_cum_cyc >= t.edge_cyc
"""
BODIES["sliding_window"] = "select * exclude (_before_leading_cyc, _before_leading_insns) from both_sides"
BODIES["ipc_spans"] = f"""
select window_end_cum_cyc, window_start_cum_cyc, end_time, cast(interior_insns as double) / {WINDOW} as conservative_ipc,
  cast(trailing_insns + leading_insns + interior_insns as double) / {WINDOW} as optimistic_ipc,
  coalesce((trailing_insns * (cast(trailing_cyc_in_window as double) / nullif(trailing_cyc_count, 0))
    + leading_insns * (cast(leading_cyc_in_window as double) / nullif(leading_cyc_count, 0)) + interior_insns)
    / {WINDOW}::double, 10000.0::double) as end_linear_interp_ipc,
  span_width_cyc, window_end_cum_cyc - span_width_cyc as span_start_cyc, window_start_cum_cyc > 0 as window_complete,
  leading_cyc_in_window, leading_insns, trailing_cyc_in_window, trailing_insns, interior_cyc, interior_insns,
  leading_end_cum_cyc, leading_cyc_count, leading_end_cum_insns, leading_insn_count,
  trailing_end_cum_cyc, trailing_cyc_count, trailing_end_cum_insns, trailing_insn_count
from spans
"""

BODIES["calls_by_symbol"] = """
select c.id, call_time, return_time from calls as c join call_paths as p on p.id = c.call_path_id
  join symbols as s on s.id = p.symbol_id join dsos as d on d.id = s.dso_id
where s.name = 'do_syscall_64' and d.short_name = '[kernel.kallsyms]'
"""
BODIES["ancestor_walk"] = "select group_id, id, parent_id, depth, call_path_id, call_time, return_time from closure"
BODIES["stack_summary"] = """
select * replace (array_to_string(symbol_list, ',') as symbol_list) from summary
"""
BODIES["full_syscalls"] = "select * from syscalls"
BODIES["full_syscalls_near_view"] = "select * from syscalls"
BODIES["whole_syscalls"] = "select * from whole_syscalls"
BODIES["kernel_context_switches"] = "select * from switches"
BODIES["next_switch"] = """
select a.id, a.cpu, a.time, b.id as next_id, b.time as next_time
from context_switches as a asof left join context_switches as b on a.cpu = b.cpu and a.time < b.time
"""
BODIES["start_end_pairing"] = """
select s.call_id as start_id, s.call_time as start_time, e.return_time as end_time
from whole_syscalls as s asof join whole_syscalls as e on e.return_time > s.call_time
"""
BODIES["union_events"] = """
select time, name, call_id, 'start' as side from starts union all select time, name, call_id, 'end' from ends
"""
BODIES["on_cpu_syscalls"] = "select * from on_cpu"
BODIES["on_cpu_violations"] = """
select on_cpu.* from on_cpu, view_ where (starts_time between low and high or ends_time between low and high)
  and ((starts_call_id is null and ends_call_id is null) or starts_call_id <> ends_call_id)
"""
BODIES["endpoint_in_view"] = """
select starts_time, ends_time, coalesce(starts_name, ends_name) as name from on_cpu, view_
where starts_time between low and high or ends_time between low and high
"""
BODIES["spans_by_label"] = """
select ltrim(syscall_kernel_name, '_') as label, count(*) as spans,
  cast(sum(return_time - call_time) as bigint) as total_duration, min(call_time) as first_start,
  max(return_time) as last_end from syscalls group by 1
"""
BODIES["errors_and_ranges"] = "select * from covered"
BODIES["overflow_in_view"] = """
select start_time, end_time from covered, view_ where (start_time <= low and end_time >= high)
  or start_time between low and high or end_time between low and high
"""
BODIES["interval_in_view"] = """
select id, call_time, return_time from calls, view_ where (call_time <= low and return_time >= high)
  or call_time between low and high or return_time between low and high
"""
BODIES["switch_timeline"] = """
select time, i.tid as tid_in,
  case flags when 0 then 'in' when 1 then 'out' when 3 then 'out preempt' else cast(flags as varchar) end as flags
from context_switches as c join threads as o on o.id = thread_out_id join threads as i on i.id = thread_in_id
  join comms as co on co.id = comm_out_id join comms as ci on ci.id = comm_in_id, view_
where time between low and high
"""
BODIES["iteration_latency"] = "select * from latency"
BODIES["log_histogram"] = _histogram("latency", "latency_ns", 49, "count(*) as n", "n", "0.99::double", "1.01::double")
BODIES["interval_overlap_join"] = """
select a.id as a_id, b.id as b_id, greatest(a.time, b.time) as overlap_start,
  least(a.time + 21600000000, b.time + 14400000000) as overlap_end
from ev as a join ev as b on a.user_id = b.user_id and a.time < b.time + 14400000000 and b.time < a.time + 21600000000
"""

BODIES["samples_for_cdf"] = "select * from for_cdf"
BODIES["range_cdf"] = "select * from cdf"
BODIES["cdf_tail"] = "select * from cdf where cdf > 0.95"
BODIES["insn_class_share"] = "select * from shares"
BODIES["log_histogram_weighted"] = _histogram(
    "shares",
    "cyc_count",
    29,
    ", ".join(f"round(sum(weighted_insn_count_{i}), 9) as weighted_insn_count_{i}" for i in range(3)),
    ", ".join(f"weighted_insn_count_{i}" for i in range(3)),
    "1.0::double",
    "1.0::double",
)

BODIES["error_gaps"] = """
select e.id, e.time, e.code, e.msg, e.next_sample_time - e.time as next_gap_duration,
  e.time - e.prev_sample_time as prev_gap_duration, e.next_sample_time, n.id as next_sample_id,
  n.branch_type_name as next_branch_type, e.prev_sample_time, p.id as prev_sample_id,
  p.branch_type_name as prev_branch_type, e.matching_sample_time, m.id as matching_sample_id,
  m.branch_type_name as matching_branch_type
from (select x.*, a.time as next_sample_time, b.time as prev_sample_time, c.time as matching_sample_time
  from error_rows as x asof left join (select distinct time from samples) as a on x.time < a.time
    asof left join (select distinct time from samples) as b on x.time > b.time
    left join (select distinct time from samples) as c on x.time = c.time) as e
  left join counted as n on n.time = e.next_sample_time left join counted as p on p.time = e.prev_sample_time
  left join counted as m on m.time = e.matching_sample_time
"""
BODIES["errors_begin_one_to_one"] = """
select e.time as err_time, s.time as sample_time, e.id as err_id, s.id as sample_id
from begin_error_rows as e full outer join (select * from named where branch_type_name = 'trace begin') as s
  on e.time = s.time where e.time is null or s.time is null
"""
BODIES["error_free_ranges"] = "select * from free_ranges"
BODIES["top_error_free_ranges"] = "select * from free_ranges order by duration desc nulls last, start_time limit 10"

_STATISTICS = """
select trial, cast(sum(count) as bigint) as count, min(count) as "minCount", max(count) as "maxCount",
  round(avg(count), 6) as "averageCount", round(stddev_pop(count), 6) as "StdDevCount" from connections group by trial
"""
BODIES["connection_statistics"] = _STATISTICS
BODIES["total_iterations"] = "select cast(sum(count) as bigint) as total_iterations from connections"
BODIES["trial_metrics_json"] = _STATISTICS
BODIES["trial_results"] = f"""
select trial, 'driver-' || trial as server_driver, cast(20 as bigint) as server_sleep_duration_millis,
  'go' as client_driver, (select count(*) from connections as c where c.trial = s.trial) as client_num_clients,
  cast(10 as bigint) as test_duration_secs, count, "minCount", "maxCount", "averageCount", "StdDevCount"
from ({_STATISTICS}) as s
"""
BODIES["throughput_report"] = """
with totals as (select trial, split_part(trial, '_', 1) as mode, cast(sum(count) as bigint) as iterations
  from connections group by trial),
rates as (select *, iterations / 10.0::double as per_second, 10000000.0::double / iterations as us_per_iteration,
  10000000.0::double / (iterations * 2) as us_per_syscall from totals)
select r.*, r.per_second / b.per_second as relative_rate, 1.0::double - r.per_second / b.per_second as slowdown,
  (select per_second from rates where trial = 'async') / (select per_second from rates where trial = 'sync') as mode_factor
from rates as r left join rates as b on b.trial = r.mode
"""

BODIES["log_lines"] = r"""
select doc_id, i - 1 as line_no, regexp_replace(parts[i], '\r$', '') as line
from (select doc_id, case when right(text, 1) = chr(10) then string_split(left(text, -1), chr(10))
    when text = '' then [] else string_split(text, chr(10)) end as parts from documents),
  unnest(range(1, len(parts) + 1)) as t(i)
"""
_WRAPPED = r"""json_object('time', cast(conv_id * 1000 + line_no as varchar), 'level', 'INFO', 'msg', 'command output',
  'command_index', command_index, 'output_stream_name', output_stream_name,
  'line', regexp_replace(line, '[\r\n]+$', ''))::varchar"""
BODIES["log_wrap"] = f"select conv_id, line_no, {_WRAPPED} as record from log_lines"
_NORMAL = f"""
select conv_id, line_no, passes, case when passes then line else {_WRAPPED} end as output
from (select *, coalesce(json_valid(first) and list_has_all(json_keys(case when json_valid(first) then first end),
    ['time', 'level', 'msg']), false) as passes
  from (select *, first_value(line) over (partition by conv_id, command_index, output_stream_name order by line_no)
    as first from log_lines))
"""
BODIES["log_normalize"] = _NORMAL
BODIES["log_normalize_stream"] = _NORMAL
BODIES["log_normalize_files"] = r"""
select quarter, line_no, quarter < 2 as passes, case when quarter < 2 then line else json_object('time',
  cast(line_no as varchar), 'level', 'INFO', 'msg', 'command output', 'command_index', 0, 'output_stream_name', 'stdout',
  'line', regexp_replace(line, '[\r\n]+$', ''))::varchar end as output from file_lines
"""
BODIES["command_output_ordered"] = """
select row_number() over (order by cast(time as bigint), line) - 1 as place, time, line
from records where msg = 'command output' and command_index = 0 and output_stream_name = 'stdout'
"""
BODIES["log_attrs"] = """
select conv_id, line_no, 'supervisor' as app, output_stream_name as server_driver,
  conv_id % 50 as server_sleep_duration_millis, 'go' as client_driver, line_no as client_num_clients,
  cast(10 as bigint) as test_duration_secs from log_lines
"""
BODIES["log_errors"] = """
select time, level, msg, command_index, output_stream_name, line from records where level in ('WARN', 'ERROR')
"""
BODIES["command_events"] = "select event, command_index, pid from records where msg = 'command event'"
BODIES["command_output"] = """
select time, line from records where msg = 'command output' and command_index = 0 and output_stream_name = 'stdout'
"""

_BUCKETS = f"""
with shared_out as (select bucket, bucket * {WINDOW} as start_cyc, cast(sum(cyc) as bigint) as cycles, round(sum(insns), 6) as insns,
    round(sum(insns) / sum(cyc), 6) as ipc
  from (select bucket, cyc, cast(insn_count * cyc as double) / cyc_count as insns
    from (select *, least(e, (bucket + 2) * {WINDOW}) - greatest(s, bucket * {WINDOW}) as cyc
      from (select end_cum_cyc - cyc_count as s, end_cum_cyc as e, insn_count, cyc_count from ranges where cyc_count > 0),
        unnest(range(greatest(0, cast(floor((s - 2.0 * {WINDOW}) / {WINDOW}) as bigint) + 1), (e - 1) // {WINDOW} + 1))
          as t(bucket)))
  group by bucket),
clocked as (select end_cum_cyc - cyc_count as s, cyc_count, start_time, end_time, end_time - start_time as lasts from ranges
  where cyc_count > 0)
select b.*, x.start_time + cast(round(x.lasts * (cast(b.start_cyc - x.s as double) / x.cyc_count)) as bigint) as start_ns,
  case when b.start_cyc + 2 * {WINDOW} >= (select max(end_cum_cyc) from ranges) then (select max(end_time) from ranges)
    else y.start_time + cast(round(y.lasts * (cast(b.start_cyc + 2 * {WINDOW} - y.s as double) / y.cyc_count)) as bigint)
    end as end_ns
from shared_out as b asof join clocked as x on x.s <= b.start_cyc asof join clocked as y on y.s <= b.start_cyc + 2 * {WINDOW}
"""
BODIES["ipc_buckets"] = _BUCKETS
BODIES["event_aligned_ipc"] = """
select offset_bucket, round(sum(insn_count * share), 2) as insns, round(sum(cyc_count * share), 2) as cycles,
  round(sum(insn_count * share) / sum(cyc_count * share), 2) as ipc
from (select b as offset_bucket, insn_count, cyc_count,
    cast(least(r.end_time, c.time + (b + 1) * 300000000) - greatest(r.start_time, c.time + b * 300000000) as double)
      / (r.end_time - r.start_time) as share
  from ranges as r join context_switches as c
      on r.start_time < c.time + 3600000000 and c.time - 3600000000 < r.end_time
    join (select unnest(range(-12, 12)) as b) as t
      on r.start_time < c.time + (b + 1) * 300000000 and c.time + b * 300000000 < r.end_time
  where r.start_time < r.end_time)
group by offset_bucket
"""
BODIES["zero_fill_gaps"] = """
with marked as (select r.*, coalesce(branch_type_name = 'trace begin', false)
    or end_sample_id in (select end_sample_id from covered where end_sample_id is not null) as is_gap from ranges as r),
rate as (select cast(sum(cyc_count) as double) / sum(end_time - start_time) as r from marked
  where not is_gap and start_time is not null)
select end_sample_id, start_time, end_time, is_gap, case when is_gap then 0 else insn_count end as insn_count,
  filled as cyc_count, cast(sum(case when is_gap then 0 else insn_count end) over w as bigint) as end_cum_insns,
  cast(sum(filled) over w as bigint) as end_cum_cyc
from (select *, case when is_gap then coalesce(cast(round((end_time - start_time) * r) as bigint), cyc_count)
  else cyc_count end as filled from marked, rate)
window w as (order by end_sample_id)
"""
BODIES["thread_on_cpu_calls"] = """
select c.thread_id, s.cpu, c.id as call_id, greatest(s.time, c.call_time) as overlap_start,
  least(coalesce(s.until, c.return_time), c.return_time) as overlap_end
from (select *, lead(time) over (partition by cpu order by time, id) as until from context_switches) as s
  join calls as c on c.thread_id = s.thread_in_id and s.time < c.return_time
    and (s.until is null or c.call_time < s.until)
"""
BODIES["on_cpu_time"] = """
select c.thread_id, c.id, count(s.time) as overlap_count,
  cast(coalesce(sum(least(coalesce(s.until, c.return_time), c.return_time) - greatest(s.time, c.call_time))
    filter (where s.time is not null), 0) as bigint) as overlap_total
from calls as c left join (select *, lead(time) over (partition by cpu order by time, id) as until from context_switches) as s
  on c.thread_id = s.thread_in_id and s.time < c.return_time and (s.until is null or c.call_time < s.until)
group by c.thread_id, c.id
"""
BODIES["perf_overhead"] = """
with leaves as (select call_time from calls join symbols on symbols.id = call_path_id
  where name = '__perf_event_task_sched_out'),
done as (select call_time from calls join symbols on symbols.id = call_path_id where name = 'perf_event_context_sched_out')
select count(spent) as stretches, cast(sum(spent) as bigint) as total_ns, min(spent) as min_ns, max(spent) as max_ns
from (select d.call_time - l.call_time as spent from leaves as l asof left join done as d on d.call_time > l.call_time)
"""
BODIES["transition_counts"] = """
select from_state, branch_type_name as to_state, count(*) as transitions
from (select branch_type_name, lag(branch_type_name) over w as from_state, lag(id) over w as before from named
  window w as (partition by thread_id order by id)) where before is not null
group by from_state, branch_type_name having count(*) >= 10
"""
BODIES["folded_stacks"] = """
with own as (select c.id, c.return_time - c.call_time - coalesce(sum(k.return_time - k.call_time), 0) as self_time
  from calls as c left join calls as k on k.parent_id = c.id where c.id <> 0 group by c.id, c.return_time, c.call_time),
paths as (select group_id as id, string_agg(symbol, ';' order by depth desc) as path from closure_names where id <> 0
  group by group_id)
select path, cast(sum(self_time) as bigint) as self_time, count(*) as calls from own join paths using (id) group by path
"""


#: Queries over two trials at once; their SQL is that of one trace, on each trial (and CPU) alone.
TRIALS = {
    "trials_ranges": (f"select {RANGE_COLUMNS}, branch_type_name from ranges", True),
    "trials_clocks": ("""
select min(ns) as start_ns, min(cyc) as start_cyc, max(ns) as end_ns, max(cyc) as end_cyc,
  cast(max(ns) - min(ns) as double) / (max(cyc) - min(cyc)) as rate from bounds""", True),
    "trials_view_ipc": ("""
select end_sample_id, cast(insn_count as double) / nullif(cyc_count, 0) as ipc,
  start_ns + (end_cum_cyc - start_cyc) * rate as end_ns, cyc_count * rate as duration_ns from ranges, clock
where end_cum_cyc between (select min(cyc) from bounds) and (select max(cyc) from bounds)""", True),
    "trials_ipc_spans": (BODIES["ipc_spans"], True),
    "trials_ipc_buckets": (_BUCKETS, True),
    "trials_range_cdf": (BODIES["range_cdf"], False),
    "trials_insn_class_share": (BODIES["insn_class_share"], False),
    "trials_error_gaps": (BODIES["error_gaps"], False),
    "trials_full_syscalls": (BODIES["full_syscalls"], False),
    "trials_on_cpu_syscalls": (BODIES["on_cpu_syscalls"], False),
    "trials_ancestor_walk": (BODIES["ancestor_walk"], False),
    "trials_folded_stacks": ("""
select path, cast(sum(self_time) as bigint) as self_time, count(*) as calls from (
  select c.id, c.return_time - c.call_time - coalesce(sum(k.return_time - k.call_time), 0) as self_time
  from calls as c left join calls as k on k.parent_id = c.id where c.id <> 0 group by c.id, c.return_time, c.call_time)
join (select group_id as id, string_agg(symbol, ';' order by depth desc) as path from closure_names where id <> 0
  group by group_id) using (id) group by path""", False),
}


def oracle_sql() -> dict[str, str]:
    found = {name: per_trial(body, cpus) for name, (body, cpus) in TRIALS.items()}
    return found | {name: with_ctes(body) for name, body in BODIES.items()}
