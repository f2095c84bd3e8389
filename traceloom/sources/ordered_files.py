"""Tables whose files follow one another in order, so that reading them file by file is reading them in order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators.ordered import ordered_scan
from traceloom.operators.slices import WidthSlices
from traceloom.session import materialise

ROWS_PER_FILE = 1 << 20


def write_ordered(df: DataFrame, path: str, order: Sequence[str], rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``df`` in order of ``order`` (NULLs first), about ``rows_per_file`` rows in each file.

    Rows are dealt to files by ranges of the order and sorted within; no task sees more than its file. ``order`` should be unique:
    equal rows stay together but in any order. ``df`` is read more than once: pass a stored table.
    """
    files = max(1, math.ceil(df.count() / rows_per_file))
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(path)


def read_ordered(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """What :func:`write_ordered` wrote, with the number of each row in the whole order, from 0.

    A row's number is that of its file's first row plus its place in the file. Only the number of rows per file is
    counted and added up; the rows themselves are not shuffled.
    """
    named = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at")
    )
    number = [F.regexp_extract("_file", r"part-(\d+)-.*?-c(\d+)", i).cast("long") for i in (1, 2)]
    counts = named.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    counts = materialise(counts.withColumn("_number", number[0] * 100_000 + number[1]), "file-rows")
    upto = ordered_scan(counts, "_number", sums={"_upto": "_rows"}, slices=WidthSlices())
    first = upto.select("_file", (F.col("_upto") - F.col("_rows")).alias("_first"))
    found = named.join(first, "_file").withColumn(place, F.col("_first") + F.col("_at"))
    return found.drop("_file", "_at", "_first")
