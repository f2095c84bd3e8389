"""Instructions per cycle over a window sliding along the cycle axis, with error bounds.

The window covers ``size`` cycles, both ends included. It changes its content at two kinds of positions:
where its leading edge reaches the end of a range, and where its trailing edge does. Between positions the
IPC is linear, so one row per position describes the whole curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.columns import ratio
from traceloom.operators import QuantileSlices, SliceDirectory, WidthSlices, ordered_scan, quantile_slices
from traceloom.operators.slices import DEFAULT_SLICE_ROWS

WINDOW_CYCLES = 2_000
# Fixed value: shown instead of the interpolated IPC where a range without cycles makes it undefined.
UNDEFINED_IPC = 10_000.0

RANGE_FIELDS = ["end_cum_cyc", "cyc_count", "end_cum_insns", "insn_count"]


def sliding_window(
    ranges: DataFrame,
    size: int = WINDOW_CYCLES,
    *,
    keys: Sequence[str] = (),
    slices: QuantileSlices | SliceDirectory | WidthSlices | None = None,
    rows_per_slice: int = DEFAULT_SLICE_ROWS,
) -> DataFrame:
    """One row per window position with the ranges under its two edges.

    Each range ends at ``e`` and so yields the positions ``e`` (side ``leading``) and ``e + size - 1`` (side
    ``trailing``) of the window's last cycle. On that axis both searches look the same way: the range under
    the leading edge is the next ``leading`` point, the one under the trailing edge the next ``trailing``
    point. So both searches, and the width of each step, come from one ordered scan over the points.
    ``ranges`` is read more than once: pass a stored table.

    Ranges without cycles share their end with the range before them; the first of such a group stands for
    it. Positions after the last range are left out.
    """
    if slices is None:
        slices = quantile_slices(ranges, "end_cum_cyc", rows_per_slice, keys=keys, tie="end_sample_id")
    end = F.col("end_cum_cyc").cast("long")
    number = F.col("end_sample_id").cast("long")
    # At equal positions leading points sort first: they are the rows that stay, so the step is theirs.
    points = ranges.select(
        *keys,
        F.struct(*RANGE_FIELDS, "end_time").alias("own"),
        ((F.col("cyc_count") > 0) | (F.col("end_sample_row_number") == 1)).alias("usable"),
        F.inline(
            F.array(
                F.struct(
                    F.lit(True).alias("leads"),
                    end.alias("position"),
                    (number * 2 - (1 << 62)).alias("tie"),
                ),
                F.struct(
                    F.lit(False).alias("leads"),
                    (end + (size - 1)).alias("position"),
                    (number * 2 + 1).alias("tie"),
                ),
            )
        ),
    )
    is_leading, own = F.col("leads"), F.col("own")
    here = F.struct("position", own.alias("range"))
    scanned = ordered_scan(
        points,
        "position",
        tie="tie",
        keys=keys,
        lags={"previous": "position"},
        last_known={"behind": F.when(is_leading & F.col("usable"), here)},
        next_known={
            "leading": F.when(is_leading & F.col("usable"), own),
            "trailing": F.when(~is_leading & F.col("usable"), own),
        },
        slices=slices,
    )
    coincides = F.col("behind.position") == F.col("position")
    lead = (
        F.when(is_leading, own)
        .when(coincides, F.col("behind.range"))
        .otherwise(F.col("leading"))
    )
    trail = F.when(is_leading, F.col("trailing")).otherwise(own)
    rows = scanned.withColumns({"_l": lead, "_t": trail}).filter(F.col("_l").isNotNull())
    window_end = F.col("position")
    window_start = F.col("position") - (size - 1)
    return rows.select(
        *keys,
        (is_leading & (F.col("_l.end_cum_cyc") == F.col("_t.end_cum_cyc"))).alias("is_single_range"),
        window_end.alias("window_end_cum_cyc"),
        window_start.alias("window_start_cum_cyc"),
        F.col("_l.end_time").alias("end_time"),
        *[F.col(f"_l.{f}").alias(f"leading_{f}") for f in RANGE_FIELDS],
        *[F.col(f"_t.{f}").alias(f"trailing_{f}") for f in RANGE_FIELDS],
        F.when(is_leading, "leading").otherwise("trailing").alias("side"),
        F.when(is_leading, window_start == F.col("_t.end_cum_cyc"))
        .otherwise(window_end == F.col("_l.end_cum_cyc"))
        .alias("is_span_aliased"),
        (window_end - F.col("previous")).alias("_step"),
    )


def window_rows(window: DataFrame) -> DataFrame:
    """The sliding window without the internal step width."""
    return window.drop("_step")


def ipc_spans(window: DataFrame, size: int = WINDOW_CYCLES, *, keys: Sequence[str] = ()) -> DataFrame:
    """IPC at the end of each span between window positions.

    Conservative counts only ranges wholly inside the window, optimistic all instructions of the two edge
    ranges too, interpolated the share of them in proportion to the cycles inside.
    """
    single = F.col("is_single_range")
    none = F.lit(0).cast("long")
    kept = window.filter((F.col("side") == "leading") | ~F.col("is_span_aliased"))
    parts = kept.withColumns(
        {
            "trailing_insns": F.col("trailing_insn_count"),
            "trailing_cyc_in_window": F.col("trailing_end_cum_cyc") - F.col("window_start_cum_cyc") + 1,
            "leading_insns": F.when(single, none).otherwise(F.col("leading_insn_count")),
            "leading_cyc_in_window": F.when(single, none).otherwise(
                F.col("window_end_cum_cyc") - F.col("leading_end_cum_cyc") + F.col("leading_cyc_count")
            ),
            "interior_insns": F.when(single, none).otherwise(
                F.col("leading_end_cum_insns") - F.col("leading_insn_count") - F.col("trailing_end_cum_insns")
            ),
            "interior_cyc": F.when(
                F.col("leading_end_cum_cyc") == F.col("trailing_end_cum_cyc"), none
            ).otherwise(
                F.col("leading_end_cum_cyc") - F.col("leading_cyc_count") - F.col("trailing_end_cum_cyc")
            ),
            "span_width_cyc": F.coalesce(F.col("_step"), none),
        }
    )
    edges = [
        F.col(f"{edge}_insns") * ratio(F.col(f"{edge}_cyc_in_window"), F.col(f"{edge}_cyc_count"))
        for edge in ("trailing", "leading")
    ]
    everything = F.col("trailing_insns") + F.col("leading_insns") + F.col("interior_insns")
    interpolated = (edges[0] + edges[1] + F.col("interior_insns")) / F.lit(float(size))
    return parts.select(
        *keys,
        "window_end_cum_cyc",
        "window_start_cum_cyc",
        "end_time",
        (F.col("interior_insns").cast("double") / size).alias("conservative_ipc"),
        (everything.cast("double") / size).alias("optimistic_ipc"),
        F.coalesce(interpolated, F.lit(UNDEFINED_IPC)).alias("end_linear_interp_ipc"),
        "span_width_cyc",
        (F.col("window_end_cum_cyc") - F.col("span_width_cyc")).alias("span_start_cyc"),
        (F.col("window_start_cum_cyc") > 0).alias("window_complete"),
        *[f"leading_{c}" for c in ("cyc_in_window", "insns")],
        *[f"trailing_{c}" for c in ("cyc_in_window", "insns")],
        "interior_cyc",
        "interior_insns",
        *[f"{edge}_{f}" for edge in ("leading", "trailing") for f in RANGE_FIELDS],
    )
