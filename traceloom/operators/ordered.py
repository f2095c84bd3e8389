"""Running sums, row numbers, lag and lead over a global order, without a global sort.

One shuffle puts each slice of the order in one task. Every slice also contributes one summary row; running totals
and boundary rows over those summaries come from a tree (:mod:`traceloom.operators.tree`) and are joined back by slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.slices import (
    DEFAULT_SLICE_ROWS,
    QuantileSlices,
    SliceDirectory,
    WidthSlices,
    group_of,
    quantile_slices,
)
from traceloom.operators.tree import carried_over


def _column(source: str | Column) -> Column:
    return F.col(source) if isinstance(source, str) else source


def ordered_scan(
    df: DataFrame,
    order: str,
    *,
    tie: str | None = None,
    keys: Sequence[str] = (),
    sums: Mapping[str, str] | None = None,
    lags: Mapping[str, str] | None = None,
    leads: Mapping[str, str] | None = None,
    last_known: Mapping[str, str | Column] | None = None,
    next_known: Mapping[str, str | Column] | None = None,
    lows: Mapping[str, str] | None = None,
    row_number: str | None = None,
    slices: WidthSlices | QuantileSlices | SliceDirectory | None = None,
) -> DataFrame:
    """Add running columns along ``order`` within each combination of ``keys``.

    Each mapping gives a new column its source column. ``sums`` include the current row, ``last_known`` and
    ``next_known`` take the nearest non-NULL value at or before, and at or after it; ``lows`` are the minimum
    over the whole group. The known values may be expressions; they are formed after the shuffle, so that
    only the columns they are made of travel. ``order`` must be unique within the keys, or be made so by ``tie`` (both integers). Without
    ``slices`` a unique order is cut by width, a tied one at quantiles.
    """
    sums, lags, leads = dict(sums or {}), dict(lags or {}), dict(leads or {})
    last_known = {out: _column(src) for out, src in dict(last_known or {}).items()}
    next_known = {out: _column(src) for out, src in dict(next_known or {}).items()}
    tie_slices = None
    if slices is None:
        slices = WidthSlices() if tie is None else quantile_slices(df, order, keys=keys, tie=tie)
    spread = F.col(tie).cast("long") if isinstance(slices, SliceDirectory) and tie else F.lit(0)
    if tie is not None and isinstance(slices, QuantileSlices) and slices.hot:
        tied = df.filter(F.col(order).isin(list(slices.hot)))
        tie_slices = quantile_slices(tied, tie, DEFAULT_SLICE_ROWS, slices.parts)
        df = tie_slices.assign(df, tie, "_spread", F.lit(0))
        spread = F.col("_spread")
    df = slices.assign(df.withColumn("_group", group_of(keys)), order, "_slice", spread)
    if tie_slices is not None:
        df = df.drop("_spread")

    place = [F.col(order)] + ([F.col(tie)] if tie else [])
    along = Window.partitionBy("_group", "_slice").orderBy(*place)
    running = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local: dict[str, Column] = {}
    totals: dict[str, Column] = {}  # per slice
    kinds: dict[str, str] = {}  # how a total is carried over to other slices
    final: dict[str, Column] = {}
    for out, src in sums.items():
        local[f"_s_{out}"] = F.sum(src).over(running)
        totals[f"s_{out}"], kinds[f"s_{out}"] = F.sum(src), "sum"
        here, earlier = F.col(f"_s_{out}"), F.col(f"_c_s_{out}")
        final[out] = F.coalesce(here + earlier, here, earlier)
    for out, src in dict(lows or {}).items():
        totals[f"m_{out}"], kinds[f"m_{out}"] = F.min(src), "low"
        final[out] = F.col(f"_c_m_{out}")
    if row_number:
        local["_n"] = F.row_number().over(along)
        totals["n"], kinds["n"] = F.count(F.lit(1)), "sum"
        final[row_number] = (F.col("_n") + F.coalesce("_c_n", F.lit(0))).cast("long")
    # A plain column keeps the summary a hash aggregate; a struct would make Spark sort for it.
    at = F.struct(*place) if tie else place[0]
    for name, wanted, nearest, kind in (("lag", lags, F.max_by, "last"), ("lead", leads, F.min_by, "next")):
        if not wanted:
            continue
        # One struct of all values, so that a NULL in a row is told from no row.
        row = F.struct(*[F.col(src).alias(out) for out, src in wanted.items()])
        local[f"_{name}"] = (F.lag if name == "lag" else F.lead)(row).over(along)
        totals[name], kinds[name] = nearest(row, at), kind
        for out in wanted:
            final[out] = F.coalesce(f"_{name}", f"_c_{name}")[out]
    for out, src in last_known.items():
        local[f"_p_{out}"] = F.last(src, ignorenulls=True).over(running)
        totals[f"p_{out}"], kinds[f"p_{out}"] = F.max_by(src, F.when(src.isNotNull(), at)), "last"
        final[out] = F.coalesce(F.col(f"_p_{out}"), F.col(f"_c_p_{out}"))
    # Looking ahead is looking back along the reversed order; a frame up to the last row would be quadratic.
    ahead = Window.partitionBy("_group", "_slice").orderBy(*[c.desc() for c in place])
    ahead = ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for out, src in next_known.items():
        local[f"_q_{out}"] = F.last(src, ignorenulls=True).over(ahead)
        totals[f"q_{out}"], kinds[f"q_{out}"] = F.min_by(src, F.when(src.isNotNull(), at)), "next"
        final[out] = F.coalesce(F.col(f"_q_{out}"), F.col(f"_c_q_{out}"))

    columns = [c for c in df.columns if c not in ("_group", "_slice")]
    spread_out = df
    if last_known or next_known:
        spread_out = df.repartition(*(["_group", "_slice"] if keys else ["_slice"]))
    scanned = spread_out.withColumns(local)
    if slices.single:
        # Each group is one slice: nothing to hand on.
        lowest = {f"_c_m_{out}": F.min(src).over(Window.partitionBy("_group", "_slice")) for out, src in dict(lows or {}).items()}
        scanned = scanned.withColumns({f"_c_{name}": F.lit(None) for name, kind in kinds.items() if kind != "low"} | lowest)
        scanned = scanned.withColumns({f"_c_{n}": F.lit(None).cast(scanned.schema[f"_{n}"].dataType) for n in ("lag", "lead") if n in kinds})
    else:
        summary = df.groupBy("_group", "_slice").agg(*[c.alias(name) for name, c in totals.items()])
        scanned = scanned.join(carried_over(summary, kinds), ["_group", "_slice"])
    kept = [F.col(c) for c in columns if c not in final]
    return scanned.select(*kept, *[c.alias(out) for out, c in final.items()])
