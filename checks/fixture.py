"""Trace tables derived from the driver tables, so that every plan runs on whole given tables.

The same derivation is written as SQL in :mod:`checks.fixture_sql`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.plans.lookups import look_up
from traceloom.session import materialise
from traceloom.sources.packets import DECODERS
from traceloom.sources.schemas import conform, with_unknown

KERNEL_DSO = 26
DAY = 86_400_000_000
WINDOW = 20_000
LONG_LIMIT = 10_000
SLICE_ROWS = 4_000
EVENT_KINDS = {1: "ptwrite", 2: "mwait", 3: "pwre", 4: "exstop", 5: "pwrx", 6: "cbr", 7: "branches"}
BRANCH_TYPES = {1: "call", 2: "return", 3: "conditional jump", 4: "trace begin"}
BRANCH_OF_EVENT = {"click": 1, "view": 2, "purchase": 3, "signup": 4}
SWITCH_CALLS = (
    "prepare_task_switch", "switch_mm_irqs_off", "__perf_event_task_sched_out", "perf_event_context_sched_out"
)
TRIAL_OF_EVENT = {
    "signup": "async",
    "click": "async_retcomp",
    "view": "sync",
    "purchase": "sync_retcomp",
    "error": "sync_retcomp_kernelonly_noswitchevents",
}


def chosen(column: Column, values: dict) -> Column:
    out = F.lit(None)
    for key, value in values.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def inline_rows(spark: SparkSession, rows: list[tuple], *columns: str) -> DataFrame:
    """Constant rows as a VALUES relation, whose size the optimizer knows."""
    texts = ", ".join("(" + ", ".join(repr(value) for value in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {texts} AS t({', '.join(columns)})")


class Fixture:
    """Trace tables over the driver tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def driver(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        n = F.col("event_id") + 1
        idle = n % 5 == 0
        counter = F.get_json_object("props", "$.k").cast("long")
        return self.driver("events").select(
            n.alias("id"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("time"),
            "user_id",
            "event_type",
            counter.alias("k"),
            F.when(idle, F.lit(0).cast("long")).otherwise(counter).alias("insn_count"),
            F.when(idle, F.lit(0).cast("long"))
            .otherwise(F.round(F.col("value") * 100).cast("long") + 1)
            .alias("cyc_count"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        n = F.col("id")
        return conform(
            self.ev.select(
                n,
                (n % 7 + 1).alias("evsel_id"),
                F.lit(1).alias("machine_id"),
                F.col("user_id").alias("thread_id"),
                (F.col("user_id") + 1).alias("comm_id"),
                (n % 26 + 1).alias("dso_id"),
                (n % 11).alias("symbol_id"),
                (n % 256).alias("sym_offset"),
                ((n % 100_000 + 1) * -4096).alias("ip"),
                "time",
                (F.col("user_id") % 4).alias("cpu"),
                (n * 3 % 26 + 1).alias("to_dso_id"),
                (n * 3 % 11).alias("to_symbol_id"),
                (n % 128).alias("to_sym_offset"),
                (n * 16 + 4_194_304).alias("to_ip"),
                F.lit(1).alias("period"),
                F.lit(0).alias("weight"),
                F.lit(0).alias("transaction_"),
                F.lit(0).alias("data_src"),
                chosen(F.col("event_type"), BRANCH_OF_EVENT).alias("branch_type"),
                (n % 50 == 0).alias("in_tx"),
                (n % 11).alias("call_path_id"),
                "insn_count",
                "cyc_count",
                (n % 8).alias("flags"),
            ),
            "samples",
        )

    def _numbered(self, names: dict[int, str], table: str) -> DataFrame:
        rows = inline_rows(self.spark, list(names.items()), "id", "name")
        return with_unknown(rows, table) if table == "selected_events" else rows

    @cached_property
    def selected_events(self) -> DataFrame:
        return self._numbered(EVENT_KINDS, "selected_events")

    @cached_property
    def branch_types(self) -> DataFrame:
        return self._numbered(BRANCH_TYPES, "branch_types")

    @cached_property
    def machines(self) -> DataFrame:
        n = F.col("r_regionkey") + 1
        rows = self.driver("region").select(
            n.alias("id"),
            F.when(n % 2 == 0, -1).otherwise(n * 100).alias("pid"),
            F.col("r_name").alias("root_dir"),
        )
        return with_unknown(conform(rows, "machines"), "machines")

    @cached_property
    def dsos(self) -> DataFrame:
        rows = self.driver("nation").select(
            (F.col("n_nationkey") + 1).alias("id"),
            (F.col("n_regionkey") + 1).alias("machine_id"),
            F.col("n_name").alias("short_name"),
            F.concat(F.lit("/lib/"), F.col("n_name")).alias("long_name"),
            F.concat(F.lit("b"), F.col("n_nationkey")).alias("build_id"),
        )
        kernel = self.spark.range(1).select(
            F.lit(KERNEL_DSO).alias("id"),
            F.lit(2).alias("machine_id"),
            F.lit("[kernel.kallsyms]").alias("short_name"),
            F.lit("[kernel.kallsyms]").alias("long_name"),
            F.lit("k").alias("build_id"),
        )
        return with_unknown(conform(rows.unionByName(kernel), "dsos"), "dsos")

    @cached_property
    def threads(self) -> DataFrame:
        key = F.col("s_suppkey")
        rows = self.driver("supplier").select(
            (key + 1).alias("id"),
            (F.col("s_nationkey") % 5 + 1).alias("machine_id"),
            (key + 1).alias("process_id"),
            (key + 1000).alias("pid"),
            (key + 2000).alias("tid"),
        )
        return with_unknown(conform(rows, "threads"), "threads")

    @cached_property
    def comms(self) -> DataFrame:
        key = F.col("c_custkey")
        rows = self.driver("customer").select(
            (key + 1).alias("id"),
            F.col("c_name").alias("comm"),
            (key % 100 + 1).alias("c_thread_id"),
            (key * 1000).alias("c_time"),
            (key % 2 == 0).alias("exec_flag"),
        )
        return with_unknown(conform(rows, "comms"), "comms")

    @cached_property
    def comm_threads(self) -> DataFrame:
        key = F.col("o_orderkey")
        rows = self.driver("orders").select(
            (key + 1).alias("id"), (F.col("o_custkey") + 1).alias("comm_id"), (key % 120 + 1).alias("thread_id")
        )
        return conform(rows, "comm_threads")

    @cached_property
    def frames(self) -> DataFrame:
        """Calls with the name of their function, before symbols are numbered."""
        n, t, length = F.col("id"), F.col("time"), (F.col("id") % 997 + 10) * 1000

        def frame(number: Column, parent: Column, start: Column, end: Column, name: Column, level: int) -> Column:
            return F.struct(
                number.alias("id"),
                parent.cast("long").alias("parent_id"),
                start.alias("call_time"),
                end.alias("return_time"),
                name.alias("name"),
                F.lit(level).cast("long").alias("branch_count"),
            )

        names = [
            F.concat(F.lit("__x64_sys_"), F.col("event_type")),
            F.lit("x64_sys_call"),
            F.lit("do_syscall_64"),
            F.lit("entry_SYSCALL_64"),
        ]
        stack = [
            frame(n * 4 + i, n * 4 + i + 1 if i < 3 else F.lit(0), t - i, t + length + i, name, i)
            for i, name in enumerate(names)
        ]
        switch = [
            frame(n * 4 + 10_000_000_000 + i, F.lit(0), t + 500 * i, t + 500 * i + 400, F.lit(name), 0)
            for i, name in enumerate(SWITCH_CALLS)
        ]
        made = F.when(F.col("event_type") == "purchase", F.array(*switch)).otherwise(F.array(*stack))
        return self.ev.select(n.alias("sample_id"), "user_id", "k", F.inline(made))

    @cached_property
    def symbols(self) -> DataFrame:
        types = self.ev.filter(F.col("event_type") != "purchase").select("event_type").distinct()
        called = types.select(F.concat(F.lit("__x64_sys_"), F.col("event_type")).alias("name"))
        fixed = ["do_syscall_64", "entry_SYSCALL_64", "x64_sys_call", *SWITCH_CALLS]
        names = called.unionByName(inline_rows(self.spark, [(name,) for name in fixed], "name"))
        # One row per event type: the numbering runs over a handful of rows.
        rows = names.agg(F.sort_array(F.collect_set("name")).alias("names")).select(
            F.posexplode("names").alias("at", "name")
        )
        n = F.col("at") + 1
        rows = rows.select(
            n.alias("id"),
            F.lit(KERNEL_DSO).alias("dso_id"),
            (n * 4096).alias("sym_start"),
            (n * 4112).alias("sym_end"),
            (n % 3).alias("binding"),
            "name",
        )
        # Stored, as the raw tables of a trace are; the plans read them several times.
        return materialise(with_unknown(conform(rows, "symbols"), "symbols"), "symbols")

    @cached_property
    def call_paths(self) -> DataFrame:
        return self.symbols.select(
            F.col("id").cast("long").alias("id"),
            F.expr("cast(id div 2 as bigint)").alias("parent_id"),
            F.col("id").cast("long").alias("symbol_id"),
            F.col("sym_start").alias("ip"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        numbered = self.frames.join(
            self.symbols.select(F.col("id").alias("call_path_id"), "name"), "name"
        ).select(
            "id",
            F.col("user_id").alias("thread_id"),
            (F.col("user_id") + 1).alias("comm_id"),
            "call_path_id",
            "call_time",
            "return_time",
            "branch_count",
            F.col("sample_id").alias("call_id"),
            (F.col("sample_id") + 1).alias("return_id"),
            F.lit(0).alias("parent_call_path_id"),
            (F.col("id") % 8).alias("flags"),
            "parent_id",
            F.col("k").alias("insn_count"),
            (F.col("id") % 5).alias("cyc_count"),
        )
        root = self.spark.range(1).select(*[F.lit(0).alias(c) for c in numbered.columns])
        return materialise(conform(numbered.unionByName(root), "calls"), "calls")

    @cached_property
    def packets(self) -> DataFrame:
        """Raw packets of twelve bytes: a 32-bit flag word and a 64-bit payload."""
        n = F.col("id")
        flags = n * 40503 % (1 << 32)
        payload = (n % (1 << 31)) * 2654435761 % (1 << 40)

        def little(value: Column, size: int) -> list[Column]:
            return [
                F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)
            ]

        raw = F.unhex(F.concat(*little(flags, 4), *little(payload, 8)))
        return self.ev.select(n, (n % 7).cast("int").alias("config"), raw.alias("raw"))

    @cached_property
    def context_switches(self) -> DataFrame:
        n, user = F.col("id"), F.col("user_id")
        rows = self.ev.filter(F.col("event_type") == "purchase").select(
            n,
            F.lit(1).alias("machine_id"),
            "time",
            (user % 4).alias("cpu"),
            user.alias("thread_out_id"),
            (user + 1).alias("comm_out_id"),
            (n % 120).alias("thread_in_id"),
            (n % 1600).alias("comm_in_id"),
            (n % 4).alias("flags"),
        )
        return conform(rows, "context_switches")

    def _errors(self, rows: DataFrame) -> DataFrame:
        n = F.col("id")
        return conform(
            rows.select(
                F.lit(1).alias("type"),
                (n % 12 + 1).alias("code"),
                (F.col("user_id") % 4).alias("cpu"),
                (F.col("user_id") + 1000).alias("pid"),
                (F.col("user_id") + 2000).alias("tid"),
                (F.lit("18446744073709551615").cast("decimal(20,0)") - n.cast("decimal(20,0)")).alias("ip"),
                "time",
                F.lit("Overflow packet").alias("msg"),
                F.lit(1).alias("cpumode"),
                F.lit(0).alias("machine_pid"),
                F.lit(-1).alias("vcpu"),
            ),
            "auxtrace_errors",
        )

    @cached_property
    def auxtrace_errors(self) -> DataFrame:
        return self._errors(self.ev.filter(F.col("event_type") == "error"))

    @cached_property
    def begin_errors(self) -> DataFrame:
        """The errors above and one at nine in ten trace begins."""
        begins = (F.col("event_type") == "signup") & (F.col("id") % 10 != 0)
        return self._errors(self.ev.filter((F.col("event_type") == "error") | begins))

    @cached_property
    def connections(self) -> DataFrame:
        return self.ev.groupBy(
            chosen(F.col("event_type"), TRIAL_OF_EVENT).alias("trial"), F.col("user_id").alias("connection_id")
        ).agg(F.count(F.lit(1)).alias("count"))

    @cached_property
    def log_lines(self) -> DataFrame:
        """Lines of one stream per conversation; even ones start with a JSON line."""
        conv, turn = F.col("conv_id"), F.col("turn")
        start = F.when(conv % 10 == 0, '{"level":"INFO","msg":"m"}').otherwise(
            '{"time":"t","level":"INFO","msg":"m"}'
        )
        return self.driver("conversations").select(
            conv,
            turn.alias("line_no"),
            (conv % 3).cast("int").alias("command_index"),
            F.when(conv % 2 == 0, "stdout").otherwise("stderr").alias("output_stream_name"),
            F.when((conv % 2 == 0) & (turn == 0), start).otherwise(F.col("text")).alias("line"),
        )

    @cached_property
    def record_lines(self) -> DataFrame:
        """Log records as JSON text, one per event."""
        kind = F.col("event_type")
        record = F.struct(
            F.col("time").cast("string").alias("time"),
            F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias("level"),
            F.when(kind == "view", "command event").otherwise("command output").alias("msg"),
            (F.col("id") % 3).cast("int").alias("command_index"),
            F.when(F.col("user_id") % 2 == 0, "stdout").otherwise("stderr").alias("output_stream_name"),
            F.concat(F.lit("line "), F.col("id")).alias("line"),
            F.when(kind == "view", F.when(F.col("k") < 50, "starting").otherwise("started")).alias("event"),
            F.when((kind == "view") & (F.col("k") >= 50), F.col("user_id")).alias("pid"),
        )
        return self.ev.select(F.to_json(record).alias("line"))

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        """All tables of the trace."""
        names = (
            "selected_events machines threads comms comm_threads dsos symbols branch_types samples call_paths calls "
            "context_switches auxtrace_errors"
        )
        decoded = {kind: decode(self.packets) for kind, decode in DECODERS.items()}
        return {name: getattr(self, name) for name in names.split()} | decoded

    def line_files(self, folder: str) -> str:
        """The log lines as text files, one per quarter of the conversations; two start with a record."""
        conv, line = F.col("conv_id"), F.concat_ws(" ", "conv_id", "line_no", F.regexp_replace("line", "\n", " "))
        line = F.when((conv < 2) & (F.col("line_no") == 0), '{"time":"t","level":"INFO","msg":"m"}').otherwise(line)
        rows = self.log_lines.select("conv_id", "line_no", (conv % 4).alias("quarter"), line.alias("line"))
        rows = rows.repartition(4, "quarter").sortWithinPartitions("quarter", "conv_id", "line_no")
        rows.select("quarter", "line").write.partitionBy("quarter").text(folder)
        return folder

    def sample_names(self) -> DataFrame:
        return look_up(self.samples, "branch_type", self.branch_types, {"branch_type_name": "name"})


class SecondFixture(Fixture):
    """A shorter, later trace over the same tables: a quarter of the events, with the ids they have in the first."""

    @cached_property
    def ev(self) -> DataFrame:
        first = Fixture(self.spark, self.sf_dir).ev
        return first.filter(F.col("id") % 4 == 1).withColumn("time", F.col("time") + 7 * DAY)


class Trials:
    """Both traces in one set of tables, told apart by ``trial``."""

    NAMES = ("async", "sync")

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.traces = dict(zip(self.NAMES, (Fixture(spark, sf_dir), SecondFixture(spark, sf_dir))))

    def of(self, table: Callable[[Fixture], DataFrame]) -> DataFrame:
        """A table of each trace as one."""
        parts = [table(f).withColumn("trial", F.lit(name)) for name, f in self.traces.items()]
        return parts[0].unionByName(parts[1])
