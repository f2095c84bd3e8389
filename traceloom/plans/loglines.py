"""Process output as log records: splitting, wrapping, passing through and selecting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators import WidthSlices, ordered_scan
from traceloom.session import materialise

# Fields every log record has, and the texts the harness writes.
REQUIRED = ["time", "level", "msg"]
OUTPUT_LEVEL = "INFO"
OUTPUT_MESSAGE = "command output"
EVENT_MESSAGE = "command event"
ALERT_LEVELS = ["WARN", "ERROR"]
RECORD_DDL = (
    "time STRING, level STRING, msg STRING, app STRING, trial_config MAP<STRING, STRING>, "
    "command_index INT, output_stream_name STRING, line STRING, event STRING, path STRING, "
    "args ARRAY<STRING>, pid BIGINT"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, split at newlines only; one carriage return before the newline is dropped."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(_without_return(F.col("value")).alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_no`` and ``line`` of text files: lines as in :func:`read_lines`, numbered from 0 within each file.

    Large files are read in several splits, each by a task that does not know how many lines come before. Within a
    split a line's number follows from the order of reading; the numbers of the splits before it are counts per split, added up along
    the offsets of the splits. Lines are stored once, with those numbers, and never shuffled.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        _without_return(F.col("value")).alias("line"),
    )
    stored = materialise(read, "lines")
    splits = stored.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    splits = materialise(splits, "splits")
    upto = ordered_scan(splits, "_split", keys=["file"], sums={"_upto": "_lines"}, slices=WidthSlices(1 << 33))
    base = upto.select("file", "_split", (F.col("_upto") - F.col("_lines") - F.col("_first")).alias("_base"))
    return stored.join(base, ["file", "_split"]).select("file", (F.col("_at") + F.col("_base")).alias("line_no"), "line")


def _without_return(line: Column) -> Column:
    return F.when(F.endswith(line, F.lit("\r")), F.expr("substring(value, 1, length(value) - 1)")).otherwise(line)


def split_lines(streams: DataFrame, content: str, keys: Sequence[str]) -> DataFrame:
    """Lines of whole texts, numbered from 0. Empty lines stay; an empty text has none."""
    parts = F.split(F.col(content), "\n", -1)
    ended = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return (
        streams.select(*keys, F.posexplode(ended).alias("line_no", "value"))
        .select(*keys, F.col("line_no").cast("long").alias("line_no"), _without_return(F.col("value")).alias("line"))
    )


def wrap(lines: DataFrame, time: Column) -> DataFrame:
    """Add ``record``: the line as a JSON log record. Needs ``command_index``, ``output_stream_name``, ``line``."""
    return lines.withColumn("record", wrapped(time))


def wrapped(time: Column) -> Column:
    return F.to_json(
        F.struct(
            time.alias("time"),
            F.lit(OUTPUT_LEVEL).alias("level"),
            F.lit(OUTPUT_MESSAGE).alias("msg"),
            "command_index",
            "output_stream_name",
            F.regexp_replace("line", "[\\r\\n]+$", "").alias("line"),
        )
    )


def is_record(line: Column) -> Column:
    """Whether a line is a JSON object with all required fields."""
    # The JSON functions ignore what follows the first value. Inside an array and inside an object nothing
    # can follow unnoticed.
    alone = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1
    sound = F.json_object_keys(F.concat(F.lit('{"r":'), line, F.lit("}"))).isNotNull()
    keys = F.json_object_keys(line)
    required = F.array(*[F.lit(name) for name in REQUIRED])
    has_all = F.size(F.array_intersect(keys, required)) == len(REQUIRED)
    return F.coalesce(alone & sound & has_all, F.lit(False))


def stream_modes(lines: DataFrame, keys: Sequence[str], line_no: str = "line_no") -> DataFrame:
    """Per stream, whether its lowest-numbered line is already a log record (``passes``)."""
    first = lines.groupBy(*keys).agg(F.min_by("line", line_no).alias("_first"))
    return first.select(*keys, is_record(F.col("_first")).alias("passes"))


def same_keys(right: DataFrame, left: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """``right`` with renamed keys, and the condition that joins it to ``left`` with NULL equal to NULL."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return renamed, condition


def apply_modes(lines: DataFrame, modes: DataFrame, keys: Sequence[str], time: Column) -> DataFrame:
    """Lines of passing streams unchanged, all others wrapped, as ``output``. A NULL key is a stream of its own."""
    decided = lines.join(*same_keys(modes, lines, keys)).select(*lines.columns, "passes")
    return decided.withColumn("output", F.when(F.col("passes"), F.col("line")).otherwise(wrapped(time)))


def normalise(lines: DataFrame, keys: Sequence[str], time: Column, line_no: str = "line_no") -> DataFrame:
    """The first line of each stream decides how the whole stream is written."""
    return apply_modes(lines, stream_modes(lines, keys, line_no), keys, time)


def with_attributes(records: DataFrame, app: str, config: Column, config_ddl: str) -> DataFrame:
    """Attach the program name and the parsed trial configuration."""
    return records.withColumns({"app": F.lit(app), "trial_config": F.from_json(config, config_ddl)})


def parse_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Log records from the lines that are records; ``rejected_lines`` has the others."""
    parsed = F.from_json(F.col(line), RECORD_DDL)
    return lines.filter(is_record(F.col(line))).select(parsed.alias("_r")).select("_r.*")


def rejected_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines that ``parse_records`` leaves out, NULL lines among them."""
    return lines.filter(~is_record(F.col(line)))


def alerts(records: DataFrame) -> DataFrame:
    return records.filter(F.col("level").isin(ALERT_LEVELS))


def command_events(records: DataFrame) -> DataFrame:
    chosen = records.filter(F.col("msg") == EVENT_MESSAGE)
    return chosen.select("event", "command_index", "pid")


def command_output(records: DataFrame, command: int, stream: str) -> DataFrame:
    """The lines one command wrote to one stream."""
    return records.filter(
        (F.col("msg") == OUTPUT_MESSAGE)
        & (F.col("command_index") == command)
        & (F.col("output_stream_name") == stream)
    ).select("time", "line")
