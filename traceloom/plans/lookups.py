"""Readable views of the raw tables: dimension names, decoded flags, hexadecimal addresses.

Every name comes from a left join on the unique ``id`` of a dimension. No side is hinted: Spark broadcasts
a dimension when its size is below the session's threshold, and otherwise shuffles, where adaptive
execution splits a hot key. Callers should filter the fact table first; the joins keep its row count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.columns import code_text, hex_text, hex_text_unsigned, ipc, truth_text
from traceloom.operators.slices import group_of

# Texts of the numeric codes in the trace tables.
BINDINGS = {0: "local", 1: "global"}
CALL_FLAGS = {0: "", 1: "no call", 2: "no return", 3: "no call/return", 6: "jump"}
WAKE_REASONS = {1: "Interrupt", 2: "Timer Deadline", 4: "Monitored Address", 8: "HW"}
SWITCH_FLAGS = {0: "in", 1: "out", 3: "out preempt"}
ERROR_TYPES = {1: "ITRACE", 2: "MAX"}
ERROR_CODES = {
    1: "NOMEM",
    2: "INTERN",
    3: "BADPKT",
    4: "NODATA",
    5: "NOINSN",
    6: "MISMAT",
    7: "OVR",
    8: "LOST",
    9: "UNK",
    10: "NELOOP",
    11: "EPTW",
    12: "MAX",
}
POWER_EVENTS = ["cbr", "mwait", "exstop", "pwre", "pwrx"]


def look_up(
    df: DataFrame, key: str, dimension: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``columns`` (new name -> dimension column) of the dimension row whose id is ``key``.

    With ``keys`` both sides have them, as tables of many trials do, and ids count within equal ones.
    """
    named = [F.col(src).alias(out) for out, src in columns.items()]
    if keys:
        right = dimension.select(group_of(keys).alias("_group"), F.col("id").alias("_id"), *named)
        left = df.withColumn("_group", group_of(keys))
        return left.join(right, (left["_group"] == right["_group"]) & (F.col(key) == F.col("_id")), "left").drop("_id", "_group")
    return df.join(dimension.select(F.col("id").alias("_id"), *named), F.col(key) == F.col("_id"), "left").drop(
        "_id"
    )


def machines_view(machines: DataFrame) -> DataFrame:
    origin = F.when(F.col("id") == 0, "unknown").when(F.col("pid") == -1, "host").otherwise("guest")
    return machines.select("id", "pid", "root_dir", origin.alias("host_or_guest"))


def dsos_view(dsos: DataFrame, machines: DataFrame) -> DataFrame:
    hosted = look_up(dsos, "machine_id", machines_view(machines), {"host_or_guest": "host_or_guest"})
    return hosted.select("id", "machine_id", "host_or_guest", "short_name", "long_name", "build_id")


def symbols_view(symbols: DataFrame, dsos: DataFrame) -> DataFrame:
    binding = F.when(F.col("binding").isin(list(BINDINGS)), code_text(F.col("binding"), BINDINGS))
    return look_up(symbols, "dso_id", dsos, {"dso": "short_name"}).select(
        "id", "name", "dso", "dso_id", "sym_start", "sym_end", binding.otherwise("weak").alias("binding")
    )


def threads_view(threads: DataFrame, machines: DataFrame) -> DataFrame:
    hosted = look_up(threads, "machine_id", machines_view(machines), {"host_or_guest": "host_or_guest"})
    return hosted.select("id", "machine_id", "host_or_guest", "process_id", "pid", "tid")


def comm_threads_view(comm_threads: DataFrame, comms: DataFrame, threads: DataFrame) -> DataFrame:
    named = look_up(comm_threads, "comm_id", comms, {"command": "comm"})
    named = look_up(named, "thread_id", threads, {"pid": "pid", "tid": "tid"})
    return named.select("comm_id", "command", "thread_id", "pid", "tid")


def call_paths_view(call_paths: DataFrame, symbols: DataFrame, dsos: DataFrame) -> DataFrame:
    """Each call path with its parent; a path whose parent is missing is dropped."""
    named = look_up(symbols, "dso_id", dsos, {"dso": "short_name"})
    full = look_up(
        call_paths, "symbol_id", named, {"symbol": "name", "dso_id": "dso_id", "dso_short_name": "dso"}
    ).withColumn("ip", hex_text(F.col("ip")))
    parents = full.select(
        F.col("id").alias("parent_id"),
        *[F.col(c).alias(f"parent_{c}") for c in ("ip", "symbol_id", "symbol", "dso_id", "dso_short_name")],
    )
    return full.join(parents, "parent_id").select(
        "id",
        "ip",
        "symbol_id",
        "symbol",
        "dso_id",
        "dso_short_name",
        "parent_id",
        "parent_ip",
        "parent_symbol_id",
        "parent_symbol",
        "parent_dso_id",
        "parent_dso_short_name",
    )


def calls_view(
    calls: DataFrame, call_paths: DataFrame, symbols: DataFrame, threads: DataFrame, comms: DataFrame
) -> DataFrame:
    """Each call whose call path is known."""
    paths = call_paths.select(F.col("id").alias("call_path_id"), "symbol_id", hex_text(F.col("ip")).alias("ip"))
    df = calls.join(look_up(paths, "symbol_id", symbols, {"symbol": "name"}), "call_path_id")
    df = look_up(df, "thread_id", threads, {"pid": "pid", "tid": "tid"})
    df = look_up(df, "comm_id", comms, {"command": "comm"})
    return df.select(
        "id",
        "thread_id",
        "pid",
        "tid",
        "command",
        "call_path_id",
        "ip",
        "symbol_id",
        "symbol",
        "call_time",
        "return_time",
        (F.col("return_time") - F.col("call_time")).alias("elapsed_time"),
        "branch_count",
        "insn_count",
        "cyc_count",
        ipc(F.col("insn_count"), F.col("cyc_count")).alias("IPC"),
        "call_id",
        "return_id",
        code_text(F.col("flags"), CALL_FLAGS).alias("flags"),
        "parent_call_path_id",
        "parent_id",
    )


def sample_names(
    samples: DataFrame, selected_events: DataFrame, symbols: DataFrame, branch_types: DataFrame
) -> DataFrame:
    """Add event, symbol, target symbol and branch type names to samples."""
    df = look_up(samples, "evsel_id", selected_events, {"event": "name"})
    df = look_up(df, "symbol_id", symbols, {"symbol": "name"})
    df = look_up(df, "to_symbol_id", symbols, {"to_symbol": "name"})
    return look_up(df, "branch_type", branch_types, {"branch_type_name": "name"})


def samples_view(
    samples: DataFrame,
    selected_events: DataFrame,
    symbols: DataFrame,
    branch_types: DataFrame,
    dsos: DataFrame,
    threads: DataFrame,
    comms: DataFrame,
) -> DataFrame:
    df = sample_names(samples, selected_events, symbols, branch_types)
    df = look_up(df, "thread_id", threads, {"pid": "pid", "tid": "tid"})
    df = look_up(df, "comm_id", comms, {"command": "comm"})
    df = look_up(df, "dso_id", dsos, {"dso_short_name": "short_name"})
    df = look_up(df, "to_dso_id", dsos, {"to_dso_short_name": "short_name"})
    return df.select(
        "id",
        "time",
        "cpu",
        "pid",
        "tid",
        "command",
        "event",
        hex_text(F.col("ip")).alias("ip_hex"),
        "symbol",
        "sym_offset",
        "dso_short_name",
        hex_text(F.col("to_ip")).alias("to_ip_hex"),
        "to_symbol",
        "to_sym_offset",
        "to_dso_short_name",
        "branch_type_name",
        "in_tx",
        "insn_count",
        "cyc_count",
        ipc(F.col("insn_count"), F.col("cyc_count")).alias("IPC"),
        "flags",
    )


def _at_sample(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Add time and cpu of the sample with the same id; rows without a sample are dropped."""
    return df.join(samples.select("id", "time", "cpu"), "id")


def ptwrite_view(ptwrite: DataFrame, samples: DataFrame) -> DataFrame:
    return _at_sample(ptwrite, samples).select(
        "id",
        "time",
        "cpu",
        hex_text(F.col("payload")).alias("payload_hex"),
        truth_text(F.col("exact_ip")).alias("exact_ip"),
    )


def cbr_view(cbr: DataFrame, samples: DataFrame) -> DataFrame:
    return _at_sample(cbr, samples).select("id", "time", "cpu", "cbr", "mhz", "percent")


def mwait_view(mwait: DataFrame, samples: DataFrame) -> DataFrame:
    return _at_sample(mwait, samples).select(
        "id",
        "time",
        "cpu",
        hex_text(F.col("hints")).alias("hints_hex"),
        hex_text(F.col("extensions")).alias("extensions_hex"),
    )


def pwre_view(pwre: DataFrame, samples: DataFrame) -> DataFrame:
    hw = truth_text(F.col("hw")).alias("hw")
    return _at_sample(pwre, samples).select("id", "time", "cpu", "cstate", "subcstate", hw)


def exstop_view(exstop: DataFrame, samples: DataFrame) -> DataFrame:
    return _at_sample(exstop, samples).select(
        "id", "time", "cpu", truth_text(F.col("exact_ip")).alias("exact_ip")
    )


def pwrx_view(pwrx: DataFrame, samples: DataFrame) -> DataFrame:
    reason = code_text(F.col("wake_reason"), WAKE_REASONS).alias("wake_reason")
    return _at_sample(pwrx, samples).select("id", "time", "cpu", "deepest_cstate", "last_cstate", reason)


def power_events_view(
    samples: DataFrame,
    selected_events: DataFrame,
    cbr: DataFrame,
    mwait: DataFrame,
    pwre: DataFrame,
    exstop: DataFrame,
    pwrx: DataFrame,
) -> DataFrame:
    """One wide row per power-event sample; columns of the other events are NULL.

    The five tables hold disjoint columns, so they are stacked and joined to the samples once instead of
    being joined one after the other.
    """
    details = {
        "cbr": cbr.select("id", "cbr", "mhz", "percent"),
        "mwait": mwait.select(
            "id",
            hex_text(F.col("hints")).alias("hints_hex"),
            hex_text(F.col("extensions")).alias("extensions_hex"),
        ),
        "pwre": pwre.select("id", "cstate", "subcstate", "hw"),
        "exstop": exstop.select("id", "exact_ip"),
        "pwrx": pwrx.select(
            "id",
            "deepest_cstate",
            "last_cstate",
            code_text(F.col("wake_reason"), WAKE_REASONS).alias("wake_reason"),
        ),
    }
    stacked = None
    for event, df in details.items():
        df = df.withColumn("event", F.lit(event))
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    names = selected_events.filter(F.col("name").isin(POWER_EVENTS)).select(
        F.col("id").alias("evsel_id"), F.col("name").alias("event")
    )
    chosen = samples.select("id", "time", "cpu", "evsel_id").join(names, "evsel_id").drop("evsel_id")
    return chosen.join(stacked, ["id", "event"], "left").select(
        "id",
        "time",
        "cpu",
        "event",
        "cbr",
        "mhz",
        "percent",
        "hints_hex",
        "extensions_hex",
        "cstate",
        "subcstate",
        "hw",
        "exact_ip",
        "deepest_cstate",
        "last_cstate",
        "wake_reason",
    )


def context_switches_view(context_switches: DataFrame, threads: DataFrame, comms: DataFrame) -> DataFrame:
    """Raw switch records with both threads and commands; a record lacking one of the four is dropped."""
    df = context_switches
    for side in ("out", "in"):
        who = threads.select(
            F.col("id").cast("long").alias(f"thread_{side}_id"),
            F.col("pid").alias(f"pid_{side}"),
            F.col("tid").alias(f"tid_{side}"),
        )
        what = comms.select(
            F.col("id").cast("long").alias(f"comm_{side}_id"), F.col("comm").alias(f"comm_{side}")
        )
        df = df.join(who, f"thread_{side}_id").join(what, f"comm_{side}_id")
    return df.select(
        "id",
        "machine_id",
        "time",
        "cpu",
        "pid_out",
        "tid_out",
        "comm_out",
        "pid_in",
        "tid_in",
        "comm_in",
        code_text(F.col("flags"), SWITCH_FLAGS).alias("flags"),
    )


def auxtrace_errors_view(errors: DataFrame) -> DataFrame:
    """Trace errors with texts. Their ``id`` is made by the caller's :func:`number_errors`."""
    return errors.select(
        "id",
        "time",
        "cpu",
        "pid",
        "tid",
        code_text(F.col("type"), ERROR_TYPES).alias("type"),
        code_text(F.col("code"), ERROR_CODES).alias("code"),
        hex_text_unsigned(F.col("ip")).alias("ip_hex"),
        "msg",
        "cpumode",
        "machine_pid",
        "vcpu",
    )
