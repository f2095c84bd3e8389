"""Reading and writing trace tables, one folder per table, partitioned by trial."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.sources.schemas import OPTIONAL_TABLES, conform, schema_of

FLAGS = ["retcomp", "kernelonly", "noswitchevents"]


def read_table(
    spark: SparkSession, folder: str, table: str, layout: str = "all", trial: str | None = None
) -> DataFrame:
    """One trace table under its declared schema, with a ``trial`` column.

    ``trial`` restricts the scan to that partition. An optional table that was never written is returned
    empty, so no reader has to ask whether it exists.
    """
    schema = T.StructType([*schema_of(table, layout), T.StructField("trial", T.StringType())])
    try:
        df = spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{table}")
    except AnalysisException as error:
        if table in OPTIONAL_TABLES and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    return df if trial is None else df.filter(F.col("trial") == trial)


def append_table(df: DataFrame, folder: str, table: str, trial: str, layout: str = "all") -> None:
    """Append rows of one trial to a table."""
    rows = conform(df, table, layout).withColumn("trial", F.lit(trial))
    rows.write.mode("append").partitionBy("trial").parquet(f"{folder.rstrip('/')}/{table}")


def write_trace(tables: Mapping[str, DataFrame], folder: str, trial: str, layout: str = "all") -> list[str]:
    """Write the tables of a new trial and return the names written.

    A trial that is already there is refused. Empty optional tables are not written.
    """
    spark = next(iter(tables.values())).sparkSession
    if any(has_trial(spark, folder, table, layout, trial) for table in tables):
        raise FileExistsError(f"trial {trial} exists in {folder}")
    written = []
    for table, df in tables.items():
        if table in OPTIONAL_TABLES and df.isEmpty():
            continue
        append_table(df, folder, table, trial, layout)
        written.append(table)
    return written


def has_trial(spark: SparkSession, folder: str, table: str, layout: str, trial: str) -> bool:
    """Whether rows of ``trial`` are stored in ``table``."""
    try:
        return not read_table(spark, folder, table, layout, trial).isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def save_derived(df: DataFrame, folder: str, name: str, trial: str) -> DataFrame:
    """Replace one trial of a derived table and return the stored rows."""
    path = f"{folder.rstrip('/')}/{name}/trial={trial}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trial_flags(trial: Column) -> dict[str, Column]:
    """Configuration coded in a trial name such as ``sync_retcomp_kernelonly``."""
    words = F.split(trial, "_")
    flags: dict[str, Column] = {"mode": F.element_at(words, 1)}
    for flag in FLAGS:
        flags[flag] = F.array_contains(words, flag)
    return flags
