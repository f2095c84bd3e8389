"""Histograms over logarithmically spaced bins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_histogram(
    df: DataFrame,
    value: str,
    *,
    edges: int,
    measures: Mapping[str, Column],
    low_factor: float = 1.0,
    high_factor: float = 1.0,
) -> DataFrame:
    """Aggregate ``measures`` per bin of ``value``.

    ``edges`` points spaced evenly in log10 between the smallest value times ``low_factor`` and the largest
    times ``high_factor`` give ``edges - 1`` bins; each includes its lower edge and the last one also its
    upper edge. All bins are returned, empty ones with measures of 0. If all values are equal there is one bin,
    of no width; without values there is none.
    """
    bins = edges - 1
    extent = df.agg(
        F.struct(
            F.log10(F.min(value) * low_factor).alias("low"), F.log10(F.max(value) * high_factor).alias("high")
        )
    ).scalar()
    place = (F.log10(F.col(value).cast("double")) - F.col("_x.low")) / (F.col("_x.high") - F.col("_x.low"))
    number = F.when(F.col("_x.high") > F.col("_x.low"), F.floor(place * bins)).otherwise(0)
    binned = df.withColumn("_x", extent).withColumn(
        "bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), number)).cast("long")
    )
    step = (F.col("_x.high") - F.col("_x.low")) / bins
    filled = binned.groupBy("bin").agg(*[m.alias(name) for name, m in measures.items()])
    return (
        df.sparkSession.range(bins)
        .withColumnRenamed("id", "bin")
        .withColumn("_x", extent)
        .filter((F.col("_x.high") > F.col("_x.low")) | (F.col("bin") == 0) & F.col("_x.low").isNotNull())
        .join(filled, "bin", "left")
        .select(
            "bin",
            F.pow(F.lit(10.0), F.col("_x.low") + F.col("bin") * step).alias("lower_edge"),
            F.pow(F.lit(10.0), F.col("_x.low") + (F.col("bin") + 1) * step).alias("upper_edge"),
            *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in measures],
        )
    )
