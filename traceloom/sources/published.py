"""Trials that appear whole or not at all: staged tables and a manifest that readers follow.

A trial is written to a folder of its own, table by table, where no reader looks. The last step adds one manifest file
that names these folders; it becomes visible as a whole. A write that fails before leaves nothing to be seen and can be
repeated. A trial is replaced in the same way: the newest manifest of a trial counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.sources.schemas import OPTIONAL_TABLES, TABLE_DDL, conform, schema_of

MANIFEST = "trial STRING, number BIGINT, table_name STRING, folder STRING, layout STRING, row_count BIGINT"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of the newest version of each published trial."""
    schema = T.StructType.fromDDL(MANIFEST)
    try:
        entries = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder.rstrip('/')}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    newest = entries.groupBy("trial").agg(F.max("number").alias("number"))
    return entries.join(newest, ["trial", "number"])


def is_published(spark: SparkSession, folder: str, trial: str) -> bool:
    return not manifest(spark, folder).filter(F.col("trial") == trial).isEmpty()


def publish_trial(
    tables: Mapping[str, DataFrame], folder: str, trial: str, *, layout: str = "all", replace: bool = False
) -> int:
    """Write the tables of a trial and publish them together; returns the number of the version.

    A trial that is there is refused unless it is to be ``replace``d. Tables that a trace may lack are written where they
    have rows. Two writers of the same version cannot both publish: the second finds the manifest path taken.
    """
    unknown = set(tables) - set(TABLE_DDL)
    if unknown:
        raise ValueError(f"no trace tables: {sorted(unknown)}")
    spark = next(iter(tables.values())).sparkSession
    root = folder.rstrip("/")
    before = manifest(spark, root).filter(F.col("trial") == trial).agg(F.max("number")).first()[0]
    if before is not None and not replace:
        raise FileExistsError(f"trial {trial} exists in {folder}")
    number = 0 if before is None else before + 1
    stage = f"data/{quote(trial, safe='')}/{number}-{uuid.uuid4().hex}"
    entries = []
    for name, df in tables.items():
        rows = conform(df, name, layout).withColumn("trial", F.lit(trial))
        rows.write.mode("errorifexists").parquet(f"{root}/{stage}/{name}")
        stored = spark.read.schema(rows.schema).parquet(f"{root}/{stage}/{name}").count()
        if stored or name not in OPTIONAL_TABLES:
            entries.append((trial, number, name, f"{stage}/{name}", layout, stored))
    # One task writes one file, which is moved in place when it is complete.
    place = f"{root}/manifest/{quote(trial, safe='')}/{number}"
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(place)
    return number


def read_published(spark: SparkSession, folder: str, table: str, trial: str | None = None) -> DataFrame:
    """A table of all published trials, or of one, with the column ``trial``.

    A trial without the table contributes no rows; columns that a trial's layout lacks are NULL. What is named here is the
    folders of the trials that have the table, a few words for each.
    """
    entries = manifest(spark, folder).filter(F.col("table_name") == table)
    if trial is not None:
        entries = entries.filter(F.col("trial") == trial)
    layouts: dict[str, list[str]] = {}
    for row in entries.select("layout", "folder").collect():
        layouts.setdefault(row.layout, []).append(f"{folder.rstrip('/')}/{row.folder}")
    whole = T.StructType([*schema_of(table), T.StructField("trial", T.StringType())])
    parts = []
    for layout, folders in sorted(layouts.items()):
        schema = T.StructType([*schema_of(table, layout), T.StructField("trial", T.StringType())])
        parts.append(spark.read.schema(schema).parquet(*sorted(folders)))
    if not parts:
        return spark.createDataFrame([], whole)
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = [f for f in whole if f.name not in found.columns]
    found = found.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else found
    return found.select(*whole.fieldNames())
