"""Tables, packets, trials and logs."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from traceloom.functions.columns import hex_text, ipc, plain_label
from traceloom.plans import gaps, loglines, lookups, trials
from traceloom.session import materialise, shared_folder
from traceloom.sources import packets, schemas, tables
from traceloom.streaming.normalise import normalise_stream


def test_schemas(spark):
    assert len(schemas.TABLE_DDL) == 19
    assert len(schemas.schema_of("samples")) == 25
    assert len(schemas.schema_of("samples", "branches")) == 21
    with pytest.raises(ValueError):
        schemas.schema_of("samples", "other")
    comms = schemas.with_unknown(schemas.empty_table(spark, "comms"), "comms").collect()
    assert [tuple(r) for r in comms] == [(0, "unknown", 0, 0, False)]
    threads = schemas.with_unknown(schemas.empty_table(spark, "threads"), "threads").collect()
    assert [tuple(r) for r in threads] == [(0, 0, 0, -1, -1)]
    with pytest.raises(ValueError):
        schemas.conform(spark.range(1), "comms")


def test_trace_round_trip(spark, tmp_path):
    folder = str(tmp_path / "traces")
    threads = spark.createDataFrame([(1, 1, 1, 7, 8)], schemas.schema_of("threads"))
    empty = schemas.empty_table(spark, "ptwrite")
    assert tables.write_trace({"threads": threads, "ptwrite": empty}, folder, "async") == ["threads"]
    with pytest.raises(FileExistsError):
        tables.write_trace({"threads": threads}, folder, "async")
    tables.write_trace({"threads": threads}, folder, "sync_retcomp")
    assert tables.read_table(spark, folder, "threads").count() == 2
    one = tables.read_table(spark, folder, "threads", trial="async")
    assert [(r.tid, r.trial) for r in one.collect()] == [(8, "async")]
    assert "PartitionFilters: [isnotnull(trial" in one._jdf.queryExecution().toString()
    assert tables.read_table(spark, folder, "ptwrite").count() == 0
    with pytest.raises(Exception):
        tables.read_table(spark, folder, "symbols").count()
    for value in (1, 2):
        saved = tables.save_derived(spark.range(value), folder, "derived", "async")
    assert saved.count() == 2


def test_trial_flags(spark):
    names = spark.createDataFrame([("async",), ("sync_retcomp_kernelonly_noswitchevents",)], "trial string")
    got = names.select(*[c.alias(n) for n, c in tables.trial_flags(F.col("trial")).items()]).collect()
    assert [tuple(r) for r in got] == [("async", False, False, False), ("sync", True, True, True)]


def test_packets(spark):
    payload = 0x8000000300000000 | 0xABC9
    raws = [
        (1, 0, struct.pack("<IQ", 0x80000001, 0xFFFFFFFFFFFFFFFE)),
        (2, 1, struct.pack("<IQ", 0, payload)),
        (3, 2, struct.pack("<IQ", 0, payload)),
        (4, 3, struct.pack("<I", 3)),
        (5, 4, struct.pack("<IQ", 0, payload)),
        (6, 5, struct.pack("<BBBBII", 20, 0, 40, 0, 1_997_500, 0)),
        (7, 5, struct.pack("<BBBBII", 20, 0, 0, 0, 499, 0)),
        (8, 9, b""),
    ]
    df = spark.createDataFrame([(i, c, bytearray(r)) for i, c, r in raws], "id long, config int, raw binary")
    got = {k: [tuple(r) for r in d(df).orderBy("id").collect()] for k, d in packets.DECODERS.items()}
    assert got == {
        "ptwrite": [(1, -2, 1)],
        "mwait": [(2, 0xC9, 3)],
        "pwre": [(3, 0xA, 0xB, 1)],
        "exstop": [(4, 1)],
        "pwrx": [(5, 0x9, 0xC, 0xB)],
        "cbr": [(6, 20, 1998, 50), (7, 20, 0, None)],
    }
    counts = {r.kind: r.packets for r in packets.reject_counts(df).collect()}
    assert counts["unhandled"] == 1 and counts["cbr"] == 2


def test_column_functions(spark):
    df = spark.createDataFrame([(-1, 57, 200, "__x"), (255, 1, 0, "y_")], "a long, i long, c long, s string")
    got = df.select(hex_text(F.col("a")), ipc(F.col("i"), F.col("c")), plain_label(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("ffffffffffffffff", 0.29, "x"), ("ff", 0.0, "y_")]


def test_error_texts(spark):
    rows = [(1, 7, 0, 1, 1, None, 5, "m", 0, 0, 0), (9, 99, 0, 1, 1, 2**64 - 1, 4, "m", 0, 0, 0)]
    errors = spark.createDataFrame(
        [(*r[:5], None if r[5] is None else str(r[5]), *r[6:]) for r in rows],
        "type int, code int, cpu int, pid int, tid int, ip string, time long, msg string, cpumode int, "
        "machine_pid int, vcpu int",
    )
    errors = schemas.conform(errors, "auxtrace_errors")
    got = lookups.auxtrace_errors_view(gaps.number_errors(errors, 1)).orderBy("id").collect()
    assert [(r.id, r.type, r.code, r.ip_hex) for r in got] == [
        (0, "9", "99", "ffffffffffffffff"),
        (1, "ITRACE", "OVR", None),
    ]


def test_connection_statistics(spark):
    clients, iterations = 512, 1000
    counts = [("t", i, iterations - i % 2) for i in range(2 * clients)]
    df = spark.createDataFrame(counts, "trial string, connection_id long, count long")
    got = trials.connection_statistics(df).first()
    assert got["count"] == clients * iterations + clients * (iterations - 1) == 1_023_488
    assert (got.minCount, got.maxCount, got.averageCount) == (999, 1000, 999.5)
    assert got.StdDevCount == pytest.approx(0.5, abs=1e-12)
    nothing = trials.connection_statistics(df.filter("count < 0"), keys=()).first()
    assert tuple(nothing) == (None, None, None, None, None)
    assert trials.total_iterations(df.filter("count < 0")).first()[0] == 0


def test_metrics_json(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7)], "trial string, connection_id long, count long")
    statistics = trials.connection_statistics(df)
    text = trials.metrics_json(statistics)
    assert set(json.loads(text.first().metrics)) == {"count", "minCount", "maxCount", "averageCount", "StdDevCount"}
    assert trials.parse_metrics(text).first()["count"] == 12
    trials.write_metrics(text, str(tmp_path / "m"))
    assert trials.read_metrics(spark, str(tmp_path / "m")).first().averageCount == 6.0


def test_throughput_report(spark):
    # Published counts of seven ten-second trials.
    measured = [
        ("async", "async", 3_133_534),
        ("async_traced", "async", 2_444_146),
        ("async_retcomp", "async", 2_944_186),
        ("sync", "sync", 1_446_123),
        ("sync_traced", "sync", 966_484),
        ("sync_retcomp", "sync", 958_426),
        ("sync_retcomp_kernelonly_noswitchevents", "sync", 1_376_355),
    ]
    df = spark.createDataFrame([(*m, 10) for m in measured], "trial string, mode string, iterations long, seconds long")
    got = {r.trial: r for r in trials.throughput_report(df, F.col("trial") == F.col("mode")).collect()}
    relative = {t: round(100 * r.relative_rate) for t, r in got.items()}
    assert relative == dict(zip((m[0] for m in measured), (100, 78, 94, 100, 67, 66, 95)))
    assert round(got["async"].us_per_iteration, 2) == 3.19
    assert round(got["sync_traced"].us_per_syscall, 2) == 5.17
    assert round(got["sync"].mode_factor, 2) == round(3_133_534 / 1_446_123, 2)


@pytest.mark.parametrize(
    "text, lines",
    [
        ("asdf", ["asdf"]),
        ("", []),
        ("asdf\nqwer\n\n", ["asdf", "qwer", ""]),
        ("a\r\nb\r", ["a", "b"]),
        ("a\rb\n", ["a\rb"]),
    ],
)
def test_lines(spark, tmp_path, text, lines):
    df = spark.createDataFrame([(1, text)], "stream long, content string")
    got = loglines.split_lines(df, "content", ["stream"]).orderBy("line_no").collect()
    assert [r.line for r in got] == lines
    (tmp_path / "log").write_bytes(text.encode())
    assert [r.line for r in loglines.read_lines(spark, str(tmp_path / "log")).collect()] == lines


FULL = '{"time":"t","level":"INFO","msg":"m"}'


@pytest.mark.parametrize(
    "line, expected",
    [
        (FULL, True),
        ('{"level":"INFO","msg":"m"}', False),
        ('{"time":null,"level":{"a":1},"msg":[1]}', True),
        (f"[{FULL}]", False),
        (FULL + " x", False),
        (FULL + "] x", False),
        (FULL + "} x", False),
        (FULL + "," + FULL, False),
        ("null", False),
        ("time level msg", False),
        ("", False),
    ],
)
def test_is_record(spark, line, expected):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(loglines.is_record(F.col("line"))).first()[0] is expected


def test_normalise(spark):
    rows = [(1, 0, FULL), (1, 1, "b"), (2, 1, FULL), (2, 0, "asdf\n")]
    df = spark.createDataFrame(rows, "stream long, line_no long, line string").withColumns(
        {"command_index": F.lit(0), "output_stream_name": F.lit("stdout")}
    )
    done = loglines.normalise(df, ["stream"], F.lit("now"))
    got = {(r.stream, r.line_no): r.output for r in done.collect()}
    assert got[(1, 0)] == FULL and got[(1, 1)] == "b"
    assert json.loads(got[(2, 0)]) == {
        "time": "now",
        "level": "INFO",
        "msg": "command output",
        "command_index": 0,
        "output_stream_name": "stdout",
        "line": "asdf",
    }
    assert json.loads(got[(2, 1)])["line"] == FULL
    back = loglines.parse_records(done.filter("stream = 2").select(F.col("output").alias("line")))
    assert loglines.command_output(back, 0, "stdout").count() == 2
    assert loglines.alerts(back).count() == 0


def test_first_batch_decides_for_later_ones(spark, tmp_path):
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    ddl = "stream long, line_no long, command_index int, output_stream_name string, line string"
    batches = [
        [(1, 1, 0, "stdout", "late"), (1, 0, 0, "stdout", FULL), (2, 0, 0, "stdout", "plain")],
        [(1, 2, 0, "stdout", "more"), (2, 1, 0, "stdout", FULL), (3, 0, 0, "stdout", FULL)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
        lines = spark.readStream.schema(ddl).parquet(source)
        normalise_stream(lines, folder, keys=["stream"], time=F.lit("now")).awaitTermination()
    got = {(r.stream, r.line_no): r.passes for r in spark.read.parquet(f"{folder}/output").collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): True, (2, 0): False, (2, 1): False, (3, 0): True}


def test_decisions_stick_over_many_batches_and_restarts(spark, tmp_path):
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    ddl = "stream string, line_no long, command_index int, output_stream_name string, line string"

    def arrive(batch):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)

    def run():
        lines = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
        normalise_stream(lines, folder, keys=["stream"], time=F.lit("now")).awaitTermination()

    arrive([("a", 50, 0, "stdout", "plain"), (None, 9, 0, "stdout", FULL), (None, 8, 0, "stdout", None)])
    run()
    for n in range(6):  # lines that would decide otherwise, with lower numbers, in batches of their own
        arrive([("a", 40 - n, 0, "stdout", FULL), (None, 7 - n, 0, "stdout", FULL), (f"s{n}", 0, 0, "stdout", FULL if n % 2 else "x")])
    run()
    arrive([("s1", -1, 0, "stdout", "x"), ("s2", -1, 0, "stdout", FULL), ("hot", 0, 0, "stdout", FULL)] + [("hot", i, 0, "stdout", "y") for i in range(1, 300)])
    run()
    got = spark.read.parquet(f"{folder}/output").collect()
    assert len(got) == 3 + 18 + 302 and len({r.batch for r in got}) == 8
    passes = {}
    for r in got:
        passes.setdefault(r.stream, set()).add(r.passes)
    assert passes == {"a": {False}, None: {False}, "hot": {True}} | {f"s{n}": {bool(n % 2)} for n in range(6)}


class Session:
    """A stand-in for a session, to see which folder is chosen."""

    def __init__(self, setting, master, directory=None):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext = self
        self.master = master
        self.directory = directory

    def getCheckpointDir(self):
        return self.directory

    def setCheckpointDir(self, directory):
        self.directory = directory


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(Session("hdfs://shared", "yarn")) == "hdfs://shared"
    assert shared_folder(Session(None, "yarn", "hdfs://set")) == "hdfs://set"
    with pytest.raises(RuntimeError):
        shared_folder(Session(None, "yarn"))
    local = Session(None, "local[2]")
    assert shared_folder(local) == shared_folder(local)
    assert materialise(spark.range(3)).count() == 3


def test_lines_without_a_stream_key_are_a_stream(spark):
    rows = [(0, None, 1, "plain"), (0, None, 2, "more"), (0, "a", 1, "x")]
    lines = spark.createDataFrame(rows, "command_index long, output_stream_name string, line_no long, line string")
    done = loglines.normalise(lines, ["command_index", "output_stream_name"], F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert sorted(r.line for r in done.collect()) == ["more", "plain", "x"]


def test_records_and_rejected_lines_are_all_lines(spark):
    lines = spark.createDataFrame([("no",), ("{} tail",), (None,), ("[1]",)], "line string")
    assert loglines.parse_records(lines).count() == 0
    assert loglines.rejected_lines(lines).count() == 4
