"""Declared schemas of the trace tables, their optional variants and their "unknown" rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column lists of the trace tables, as DDL. Identifiers of facts are longs so that they do
# not overflow on long traces; the unsigned 64-bit address of an error is a decimal.
TABLE_DDL = {
    "selected_events": "id INT, name STRING",
    "machines": "id INT, pid INT, root_dir STRING",
    "threads": "id INT, machine_id BIGINT, process_id BIGINT, pid INT, tid INT",
    "comms": "id INT, comm STRING, c_thread_id BIGINT, c_time BIGINT, exec_flag BOOLEAN",
    "comm_threads": "id INT, comm_id BIGINT, thread_id BIGINT",
    "dsos": "id INT, machine_id BIGINT, short_name STRING, long_name STRING, build_id STRING",
    "symbols": "id INT, dso_id BIGINT, sym_start BIGINT, sym_end BIGINT, binding INT, name STRING",
    "branch_types": "id INT, name STRING",
    "samples": (
        "id BIGINT, evsel_id BIGINT, machine_id BIGINT, thread_id BIGINT, comm_id BIGINT, dso_id BIGINT, "
        "symbol_id BIGINT, sym_offset BIGINT, ip BIGINT, time BIGINT, cpu INT, to_dso_id BIGINT, "
        "to_symbol_id BIGINT, to_sym_offset BIGINT, to_ip BIGINT, period BIGINT, weight BIGINT, "
        "transaction_ BIGINT, data_src BIGINT, branch_type INT, in_tx BOOLEAN, call_path_id BIGINT, "
        "insn_count BIGINT, cyc_count BIGINT, flags INT"
    ),
    "call_paths": "id BIGINT, parent_id BIGINT, symbol_id BIGINT, ip BIGINT",
    "calls": (
        "id BIGINT, thread_id BIGINT, comm_id BIGINT, call_path_id BIGINT, call_time BIGINT, "
        "return_time BIGINT, branch_count BIGINT, call_id BIGINT, return_id BIGINT, "
        "parent_call_path_id BIGINT, flags INT, parent_id BIGINT, insn_count BIGINT, cyc_count BIGINT"
    ),
    "ptwrite": "id BIGINT, payload BIGINT, exact_ip INT",
    "cbr": "id BIGINT, cbr INT, mhz INT, percent INT",
    "mwait": "id BIGINT, hints INT, extensions INT",
    "pwre": "id BIGINT, cstate INT, subcstate INT, hw INT",
    "exstop": "id BIGINT, exact_ip INT",
    "pwrx": "id BIGINT, deepest_cstate INT, last_cstate INT, wake_reason INT",
    "context_switches": (
        "id BIGINT, machine_id BIGINT, time BIGINT, cpu INT, thread_out_id BIGINT, comm_out_id BIGINT, "
        "thread_in_id BIGINT, comm_in_id BIGINT, flags INT"
    ),
    "auxtrace_errors": (
        "type INT, code INT, cpu INT, pid INT, tid INT, ip DECIMAL(20,0), time BIGINT, msg STRING, "
        "cpumode INT, machine_pid INT, vcpu INT"
    ),
}

# Columns that only the "all" layout of the samples table has.
ALL_LAYOUT_ONLY = ["period", "weight", "transaction_", "data_src"]

# The row with id 0 that stands for "unknown" in each dimension; other columns are 0.
UNKNOWN_ROWS = {
    "selected_events": {"name": "unknown"},
    "machines": {"root_dir": "unknown"},
    "threads": {"pid": -1, "tid": -1},
    "comms": {"comm": "unknown", "exec_flag": False},
    "dsos": {"short_name": "unknown", "long_name": "unknown", "build_id": ""},
    "symbols": {"name": "unknown"},
}

# Tables that a trace may lack.
OPTIONAL_TABLES = [
    "call_paths",
    "calls",
    "ptwrite",
    "cbr",
    "mwait",
    "pwre",
    "exstop",
    "pwrx",
    "context_switches",
    "auxtrace_errors",
]


def schema_of(table: str, layout: str = "all") -> T.StructType:
    """Declared schema; the ``branches`` layout of ``samples`` lacks four columns."""
    schema = T.StructType.fromDDL(TABLE_DDL[table])
    if layout not in ("all", "branches"):
        raise ValueError(f"unknown layout {layout!r}")
    if table == "samples" and layout == "branches":
        schema = T.StructType([f for f in schema if f.name not in ALL_LAYOUT_ONLY])
    return schema


def conform(df: DataFrame, table: str, layout: str = "all") -> DataFrame:
    """Cast ``df`` to the declared columns; missing or additional columns are an error."""
    schema = schema_of(table, layout)
    if set(df.columns) != set(schema.fieldNames()):
        wrong = sorted(set(df.columns) ^ set(schema.fieldNames()))
        raise ValueError(f"columns of {table} do not match its schema: {wrong}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    """A table of the declared schema without rows."""
    return spark.createDataFrame([], schema_of(table))


def to_branches_layout(samples: DataFrame) -> DataFrame:
    """The samples table without the columns of the ``all`` layout."""
    return samples.drop(*ALL_LAYOUT_ONLY)


def with_unknown(df: DataFrame, table: str) -> DataFrame:
    """Add the "unknown" row to a dimension. Facts refer to it by id 0 and do not store one."""
    texts = UNKNOWN_ROWS[table]
    row = df.sparkSession.range(1).select(
        *[F.lit(texts.get(f.name, 0)).cast(f.dataType).alias(f.name) for f in schema_of(table)]
    )
    return df.unionByName(row)
