"""Samples to ranges on a time axis and on the finer axis of cumulative cycles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.columns import ratio
from traceloom.operators import QuantileSlices, SliceDirectory, WidthSlices, join_groups, ordered_scan
from traceloom.session import materialise

VIEW_DURATION = 15_000
LONG_RANGE_CYCLES = 500


def timestamped_samples(samples: DataFrame) -> DataFrame:
    """Samples that carry an instruction or cycle count, and with it a new timestamp."""
    return samples.filter((F.col("insn_count") > 0) | (F.col("cyc_count") > 0))


def timestamped_ranges(
    samples: DataFrame,
    *,
    keys: Sequence[str] = (),
    names: Sequence[str] = (),
    slices: WidthSlices | QuantileSlices | SliceDirectory | None = None,
) -> DataFrame:
    """Each counted sample as the range since the previous one, in order of ``id`` within ``keys``.

    A range excludes its start and includes its end. The first range has no start. ``names`` are further
    sample columns to keep, such as ids or names of events and symbols.
    """
    kept = timestamped_samples(samples).select(
        *keys, "id", "time", "insn_count", "cyc_count", *[n for n in names if n not in keys]
    )
    scanned = ordered_scan(
        kept,
        "id",
        keys=keys,
        sums={"end_cum_insns": "insn_count", "end_cum_cyc": "cyc_count"},
        lags={"start_sample_id": "id", "start_time": "time"},
        lows={"_first": "time"},
        row_number="end_sample_row_number",
        slices=slices,
    )
    started = F.col("end_sample_row_number") > 1
    return scanned.select(
        *keys,
        "start_sample_id",
        "start_time",
        (F.col("start_time") - F.col("_first")).alias("start_offset_time"),
        F.when(started, F.col("end_cum_insns") - F.col("insn_count")).alias("start_cum_insns"),
        F.when(started, F.col("end_cum_cyc") - F.col("cyc_count")).alias("start_cum_cyc"),
        F.col("id").alias("end_sample_id"),
        F.col("time").alias("end_time"),
        (F.col("time") - F.col("_first")).alias("end_offset_time"),
        "end_cum_insns",
        "end_cum_cyc",
        "end_sample_row_number",
        "insn_count",
        "cyc_count",
        *[n for n in names if n not in keys],
    )


@dataclass(frozen=True)
class View:
    """A closed time window, as parameters that filters can push down to the scan."""

    start: int
    end: int


def trace_extent(samples: DataFrame) -> DataFrame:
    """First and last time of the counted samples, and their total counts; one row."""
    return timestamped_samples(samples).agg(
        F.min(F.when(F.col("time") > 0, F.col("time"))).alias("first_time"),
        F.max("time").alias("last_time"),
        F.sum("insn_count").alias("total_insns"),
        F.sum("cyc_count").alias("total_cyc"),
    )


def middle_view(samples: DataFrame, duration: int = VIEW_DURATION) -> View:
    """A window of ``duration`` that starts in the middle of the trace."""
    extent = trace_extent(samples).first()
    if extent.first_time is None:
        raise ValueError("the trace has no counted samples")
    start = extent.first_time + (extent.last_time - extent.first_time) // 2
    return View(start, start + duration)


def middle_views(samples: DataFrame, keys: Sequence[str], duration: int = VIEW_DURATION) -> DataFrame:
    """:func:`middle_view` of each combination of ``keys``, as a table: ``keys``, ``view_start``, ``view_end``."""
    extent = timestamped_samples(samples).groupBy(*keys).agg(
        F.min(F.when(F.col("time") > 0, F.col("time"))).alias("_first"), F.max("time").alias("_last")
    )
    start = F.col("_first") + F.expr("(_last - _first) div 2")
    return extent.filter("_first is not null").select(
        *keys, start.alias("view_start"), (start + F.lit(duration)).alias("view_end")
    )


def clocks(ranges: DataFrame, views: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The linear map from cycles to ns through both ends of each view, as a table; see :class:`CycleClock`.

    ``keys``, ``start_ns``, ``start_cyc``, ``end_ns``, ``end_cyc``, ``rate``. A key without a range after its view has none.
    """
    low, high = (
        F.min(F.when(F.col("end_time") > F.col(edge), F.col("end_cum_cyc"))) for edge in ("view_start", "view_end")
    )
    found = join_groups(ranges.select(*keys, "end_time", "end_cum_cyc"), views, keys)
    ends = found.groupBy(*keys, "view_start", "view_end").agg(low.alias("start_cyc"), high.alias("end_cyc"))
    rate = ratio(F.col("view_end") - F.col("view_start"), F.col("end_cyc") - F.col("start_cyc"))
    return ends.select(
        *keys, F.col("view_start").alias("start_ns"), "start_cyc", F.col("view_end").alias("end_ns"), "end_cyc",
        rate.alias("rate"),
    )


def on_clocks(ranges: DataFrame, clock: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges with ``end_ns`` and ``duration_ns`` on the clock of their key, and whether they end ``in_view``."""
    timed = join_groups(ranges, clock, keys)
    return timed.withColumns(
        {
            "in_view": F.col("end_cum_cyc").between(F.col("start_cyc"), F.col("end_cyc")),
            "duration_ns": F.col("cyc_count") * F.col("rate"),
            "_end_ns": F.col("start_ns") + (F.col("end_cum_cyc") - F.col("start_cyc")) * F.col("rate"),
        }
    ).drop("start_ns", "start_cyc", "end_ns", "end_cyc", "rate").withColumnRenamed("_end_ns", "end_ns")


def time_bounds(ranges: DataFrame, view: View) -> DataFrame:
    """Both ends of the view in ns and in cycles: the cycle is where the first later range ends."""
    later = [F.min(F.when(F.col("end_time") > ns, F.col("end_cum_cyc"))) for ns in (view.start, view.end)]
    bounds = ranges.agg(later[0].alias("low"), later[1].alias("high"))
    return bounds.select(
        F.inline(
            F.array(
                F.struct(F.lit(view.start).cast("long").alias("ns"), F.col("low").alias("cyc")),
                F.struct(F.lit(view.end).cast("long").alias("ns"), F.col("high").alias("cyc")),
            )
        )
    )


@dataclass(frozen=True)
class CycleClock:
    """Linear map from cycles to ns through the two time bounds."""

    start_ns: int
    start_cyc: int
    end_ns: int
    end_cyc: int

    @classmethod
    def from_bounds(cls, bounds: DataFrame) -> CycleClock:
        (low, high) = sorted(bounds.collect(), key=lambda r: r.ns)
        return cls(low.ns, low.cyc, high.ns, high.cyc)

    @property
    def rate(self) -> float:
        return float(self.end_ns - self.start_ns) / (self.end_cyc - self.start_cyc)

    def duration(self, cycles: Column) -> Column:
        return cycles * F.lit(self.rate)

    def time(self, cycles: Column) -> Column:
        return F.lit(self.start_ns) + self.duration(cycles - F.lit(self.start_cyc))


def in_cycles(ranges: DataFrame, clock: CycleClock) -> DataFrame:
    """Ranges that end between the two cycle bounds."""
    return ranges.filter(F.col("end_cum_cyc").between(clock.start_cyc, clock.end_cyc))


def raw_ipc(ranges: DataFrame) -> DataFrame:
    """IPC of each range on its own."""
    return ranges.select(
        "start_cum_cyc",
        "end_cum_cyc",
        ratio(F.col("insn_count"), F.col("cyc_count")).alias("ipc"),
        "cyc_count",
    )


def long_ranges(ranges: DataFrame, limit: int = LONG_RANGE_CYCLES) -> DataFrame:
    """Ranges too long for the IPC inside them to be known."""
    return ranges.filter(F.col("cyc_count") > limit)


def stored_ranges(
    samples: DataFrame,
    *,
    keys: Sequence[str] = (),
    names: Sequence[str] = (),
    slices: WidthSlices | QuantileSlices | SliceDirectory | None = None,
) -> DataFrame:
    """Timestamped ranges written once, for plans that read them several times."""
    return materialise(timestamped_ranges(samples, keys=keys, names=names, slices=slices), "ranges")
