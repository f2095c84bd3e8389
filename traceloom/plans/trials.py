"""Counters of the traced programs: statistics per trial and comparison of trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.columns import ratio

CONFIG_DDL = (
    "server_driver STRING, server_sleep_duration_millis BIGINT, client_driver STRING, "
    "client_num_clients BIGINT, test_duration_secs BIGINT"
)
METRICS_DDL = "count BIGINT, minCount BIGINT, maxCount BIGINT, averageCount DOUBLE, StdDevCount DOUBLE"
SYSCALLS_PER_ITERATION = 2


def connection_statistics(connections: DataFrame, keys: Sequence[str] = ("trial",)) -> DataFrame:
    """Sum, extremes, mean and population deviation of the counts of the connections of each trial."""
    return connections.groupBy(*keys).agg(
        F.sum("count").alias("count"),
        F.min("count").alias("minCount"),
        F.max("count").alias("maxCount"),
        F.avg("count").alias("averageCount"),
        F.stddev_pop("count").alias("StdDevCount"),
    )


def total_iterations(per_thread: DataFrame, count: str = "count") -> DataFrame:
    """Iterations of all threads together; one row."""
    return per_thread.agg(F.coalesce(F.sum(count), F.lit(0)).alias("total_iterations"))


def metrics_json(statistics: DataFrame, keys: Sequence[str] = ("trial",)) -> DataFrame:
    """One JSON object of metrics per trial."""
    fields = [c for c in statistics.columns if c not in keys]
    return statistics.select(*keys, F.to_json(F.struct(*fields)).alias("metrics"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Write metrics as text files of one JSON object per line, one folder per trial."""
    metrics.select("trial", F.col("metrics").alias("value")).write.partitionBy("trial").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Read what :func:`write_metrics`, or a client's standard output, left behind."""
    return spark.read.schema(f"{METRICS_DDL}, trial STRING").json(path)


def parse_metrics(metrics: DataFrame) -> DataFrame:
    parsed = F.from_json("metrics", METRICS_DDL)
    return metrics.select("trial", parsed.alias("_m")).select("trial", "_m.*")


def trial_results(configs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per trial: its configuration, parsed from JSON, and its metrics."""
    parsed = configs.select("trial", F.from_json("config", CONFIG_DDL).alias("_c")).select("trial", "_c.*")
    return parsed.join(metrics, "trial")


def throughput_report(
    trials: DataFrame, is_baseline: Column, compare: tuple[str, str] = ("async", "sync")
) -> DataFrame:
    """Rates and costs per iteration, relative to the baseline of the same mode and between modes.

    ``trials`` has ``trial``, ``mode``, ``iterations`` and ``seconds``. ``mode_factor`` is how much faster the
    baseline of the first mode of ``compare`` is than that of the second.
    """
    rates = trials.select(
        "trial",
        "mode",
        "iterations",
        is_baseline.alias("_base"),
        ratio(F.col("iterations"), F.col("seconds")).alias("per_second"),
        ratio(F.col("seconds") * 1_000_000, F.col("iterations")).alias("us_per_iteration"),
        ratio(F.col("seconds") * 1_000_000, F.col("iterations") * SYSCALLS_PER_ITERATION).alias(
            "us_per_syscall"
        ),
    )
    base = rates.filter("_base").groupBy("mode").agg(F.max("per_second").alias("_rate"))
    fast, slow = (
        rates.filter(F.col("_base") & (F.col("mode") == mode)).agg(F.max("per_second")).scalar()
        for mode in compare
    )
    relative = ratio(F.col("per_second"), F.col("_rate"))
    return rates.join(base, "mode", "left").select(
        "trial",
        "mode",
        "iterations",
        "per_second",
        "us_per_iteration",
        "us_per_syscall",
        relative.alias("relative_rate"),
        (F.lit(1.0) - relative).alias("slowdown"),
        ratio(fast, slow).alias("mode_factor"),
    )
