"""How long ranges are, and how many instructions they hold.

A range has the counts and the branch type of the sample it ends with, so ``ranges`` may be counted samples as
well: the distribution needs no order, and so no ordered scan and no stored ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.columns import ratio
from traceloom.operators import WidthSlices, join_groups, log_histogram, ordered_scan
from traceloom.session import materialise

DISCARD_SHARE = 0.01
TRACE_BEGIN = "trace begin"
# Instruction limits of the classes in the range distribution and in the cycle shares.
RANGE_CLASSES = (1, 20, 100)
SHARE_CLASSES = (35, 100)
CDF_TAIL = 0.95


def _with_total(df: DataFrame, totals: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """Rows with sums over all of them, or over those with equal ``keys``, as further columns."""
    if keys:
        return join_groups(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()]), keys)
    whole = df.agg(F.struct(*[c.alias(n) for n, c in totals.items()])).scalar()
    return df.withColumn("_all", whole).select(*df.columns, *[F.col("_all")[n].alias(n) for n in totals])


def per_length(ranges: DataFrame, classes: Sequence[int] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Ranges per ``keys`` and ``cyc_count``, in total and with at most each number of instructions.

    Everything about the distribution follows from this small table, so the ranges are shuffled only as
    partial counts. Ranges that begin a trace, or whose branch type is unknown, are left out.
    """
    counted = ranges.filter(F.col("branch_type_name") != TRACE_BEGIN)
    return counted.groupBy(*keys, "cyc_count").agg(
        F.count(F.lit(1)).alias("c"),
        *[F.count_if(F.col("insn_count") <= limit).alias(f"c_insns_{limit}") for limit in classes],
    )


def kept_lengths(lengths: DataFrame, discard: float, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Lengths that remain when the longest ranges are discarded up to a share of all cycles.

    ``cum_cycles`` are the cycles in ranges at least as long, so equal lengths share one value. Both the
    counts and the result are stored, so the ranges behind them are scanned once.
    """
    cycles = materialise(lengths, "lengths").withColumns(
        {"_cycles": F.col("c") * F.col("cyc_count"), "_order": -F.col("cyc_count")}
    )
    cycles = _with_total(cycles, {"_total": F.sum("_cycles")}, keys)
    ranked = ordered_scan(cycles, "_order", keys=keys, sums={"cum_cycles": "_cycles"}, slices=WidthSlices(width))
    share = ratio(F.col("cum_cycles"), F.col("_total"))
    kept = ranked.withColumn("cum_cycles_perc", share).filter(F.col("cum_cycles_perc") > discard)
    return materialise(kept.drop("_cycles", "_order", "_total"), "kept")


def samples_for_cdf(
    ranges: DataFrame, discard: float = DISCARD_SHARE, width: int = 1 << 16
) -> DataFrame:
    """Ranges without the longest ones, with their rank in cycles."""
    kept = kept_lengths(per_length(ranges), discard, width).drop("c")
    counted = ranges.filter(F.col("branch_type_name") != TRACE_BEGIN).select("insn_count", "cyc_count")
    return counted.join(kept, "cyc_count").select("insn_count", "cyc_count", "cum_cycles", "cum_cycles_perc")


def range_cdf(
    ranges: DataFrame,
    discard: float = DISCARD_SHARE,
    classes: Sequence[int] = RANGE_CLASSES,
    width: int = 1 << 16,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Per length: the CDF by number and by cycles, and the stacked shares of the instruction classes."""
    kept = kept_lengths(per_length(ranges, classes, keys), discard, width, keys).withColumn(
        "weighted_c", F.col("c") * F.col("cyc_count")
    )
    kept = _with_total(kept, {"_count": F.sum("c"), "_weight": F.sum("weighted_c")}, keys)
    summed = ordered_scan(
        kept,
        "cyc_count",
        keys=keys,
        sums={"_cdf": "c", "_weighted": "weighted_c"},
        slices=WidthSlices(width),
    )
    shares = [ratio(F.col(f"c_insns_{limit}"), F.col("c")) for limit in classes]
    stacked = [shares[0], *[high - low for low, high in zip(shares, shares[1:])]]
    return summed.select(
        *keys,
        "cyc_count",
        ratio(F.col("_cdf"), F.col("_count")).alias("cdf"),
        ratio(F.col("_weighted"), F.col("_weight")).alias("weighted_cdf"),
        *[s.alias(f"perc_insns_{limit}_stacked") for s, limit in zip(stacked, classes)],
        (F.lit(1.0) - shares[-1]).alias(f"perc_insns_{classes[-1]}_plus_stacked"),
    )


def cdf_tail(cdf: DataFrame, above: float = CDF_TAIL) -> DataFrame:
    """The upper end of the distribution."""
    return cdf.filter(F.col("cdf") > above)


def insn_class_share(
    ranges: DataFrame,
    discard: float = DISCARD_SHARE,
    classes: Sequence[int] = SHARE_CLASSES,
    tail: float = CDF_TAIL,
    width: int = 1 << 16,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Share of all kept cycles per length and instruction class, for lengths in the CDF tail."""
    kept = kept_lengths(per_length(ranges, classes, keys), discard, width, keys)
    kept = _with_total(kept, {"_count": F.sum("c"), "_cycles": F.sum(F.col("c") * F.col("cyc_count"))}, keys)
    summed = ordered_scan(kept, "cyc_count", keys=keys, sums={"_cdf": "c"}, slices=WidthSlices(width))
    at_most = [F.col(f"c_insns_{limit}") for limit in classes] + [F.col("c")]
    counts: list[Column] = [at_most[0], *[high - low for low, high in zip(at_most, at_most[1:])]]
    return summed.filter(ratio(F.col("_cdf"), F.col("_count")) > tail).select(
        *keys,
        "cyc_count",
        *[
            ratio(count * F.col("cyc_count"), F.col("_cycles")).alias(f"weighted_insn_count_{i}")
            for i, count in enumerate(counts)
        ],
    )


def weighted_histogram(shares: DataFrame, edges: int = 30) -> DataFrame:
    """The shares of :func:`insn_class_share` summed over log-spaced lengths."""
    weights = [c for c in shares.columns if c.startswith("weighted_insn_count_")]
    return log_histogram(shares, "cyc_count", edges=edges, measures={w: F.sum(w) for w in weights})


def latency_histogram(latency: DataFrame, value: str = "latency_ns", edges: int = 50) -> DataFrame:
    """Counts over log-spaced bins from 1 % below the shortest to 1 % above the longest value."""
    return log_histogram(
        latency, value, edges=edges, measures={"n": F.count(F.lit(1))}, low_factor=0.99, high_factor=1.01
    )
