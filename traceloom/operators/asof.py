"""As-of join: each left row meets the nearest right row on one side of its key."""

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


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: str,
    right_on: str,
    right_id: str,
    columns: Mapping[str, str],
    keys: Sequence[str] = (),
    direction: str = "forward",
    allow_equal: bool = False,
    how: str = "left",
    slices: QuantileSlices | SliceDirectory | WidthSlices | None = None,
    rows_per_slice: int = DEFAULT_SLICE_ROWS,
) -> DataFrame:
    """Left rows with ``columns`` (new name -> right column) of the matching right row.

    ``forward`` takes the smallest right key above the left key, ``backward`` the largest below;
    ``allow_equal`` lets equal keys match. Of several right rows with that key the one with the lowest
    ``right_id`` (an integer) is taken. ``how`` is ``left`` or ``inner``; a NULL key never matches.

    Both sides are put in one ordered stream and shuffled once by (keys, slice). Within a slice a
    running ``last`` finds the match; what a slice has to hand on to the next is one right row, which
    comes from a pre-aggregated summary. Hot left values are scattered over several slices and hot
    right values reduced to the one row that can match, so no slice grows with the ties. ``slices`` lets
    several joins on one axis share their quantiles; slices by width suit keys without frequent values.
    """
    if direction not in ("forward", "backward") or how not in ("left", "inner"):
        raise ValueError(f"unsupported as-of join: direction={direction!r} how={how!r}")
    forward = direction == "forward"
    if slices is None:
        both = left.select(*keys, F.col(left_on).cast("long").alias("_k")).unionAll(
            right.select(*keys, F.col(right_on).cast("long").alias("_k"))
        )
        slices = quantile_slices(both, "_k", rows_per_slice, keys=keys)

    names = list(left.columns)
    payload = F.struct(
        F.col(right_on).cast("long").alias("_k"),
        F.col(right_id).cast("long").alias("_id"),
        *[F.col(src).alias(out) for out, src in columns.items()],
    )
    rights = right.filter(F.col(right_on).isNotNull()).select(
        group_of(keys).alias("_group"), F.col(right_on).cast("long").alias("_k"), payload.alias("_right")
    )
    lefts = left.select(
        group_of(keys).alias("_group"),
        F.col(left_on).cast("long").alias("_k"),
        F.struct(*[F.col(c) for c in names]).alias("_left"),
    )

    right_spread = left_spread = F.lit(0)
    if not isinstance(slices, WidthSlices):
        # Along the scan an inclusive match needs the right row first, a strict one last.
        right_spread = slices.ends()[forward == allow_equal]
        left_spread = slices.scatter(F.col("_left"))
    if isinstance(slices, QuantileSlices) and slices.hot:
        rights = _lowest_of_hot(rights, F.col("_k").isin(list(slices.hot)))
    rights = slices.assign(rights, "_k", "_slice", right_spread)
    if isinstance(slices, SliceDirectory):
        rights = _lowest_of_hot(rights, F.col("_slice_hot"))
    lefts = slices.assign(lefts, "_k", "_slice", left_spread)
    # Left rows without a key match nothing; scatter them instead of giving them one slice.
    lost = slices.lost(F.col("_left"))
    lefts = lefts.withColumn("_slice", F.when(F.col("_k").isNull(), lost).otherwise(F.col("_slice")))
    stream = rights.select("_group", "_slice", "_k", "_right").unionByName(
        lefts.select("_group", "_slice", "_k", "_left"), allowMissingColumns=True
    )

    is_right = F.col("_right").isNotNull()
    turn = F.when(is_right, 0).otherwise(1) if allow_equal else F.when(is_right, 1).otherwise(0)
    step = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    along = (
        Window.partitionBy("_group", "_slice")
        .orderBy(step("_k"), turn, F.col("_right._id").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = F.last("_right", ignorenulls=True).over(along)
    matched = stream.withColumn("_match", found).filter(F.col("_left").isNotNull())

    match = F.col("_match")
    if not slices.single:
        rank = F.struct(F.col("_k"), F.col("_right._id") * (1 if forward else -1))
        edge = F.min_by("_right", rank) if forward else F.max_by("_right", rank)
        edges = rights.groupBy("_group", "_slice").agg(edge.alias("_edge"))
        asking = lefts.select("_group", "_slice", F.lit(True).alias("_asks")).distinct()
        summary = edges.join(asking, ["_group", "_slice"], "full")
        carry = carried_over(summary, {"_edge": "next" if forward else "last"})
        matched = matched.join(carry, ["_group", "_slice"])
        match = F.coalesce(match, F.col("_c__edge"))
    matched = matched.select("_left", F.when(F.col("_k").isNotNull(), match).alias("_match"))
    if how == "inner":
        matched = matched.filter(F.col("_match").isNotNull())
    return matched.select(
        *[F.col("_left")[c].alias(c) for c in names], *[F.col("_match")[out].alias(out) for out in columns]
    )


def _lowest_of_hot(rights: DataFrame, is_hot: Column) -> DataFrame:
    """Of right rows with one hot key only the one that can match."""
    same = [c for c in rights.columns if c != "_right"]
    lowest = rights.filter(is_hot).groupBy(*same).agg(F.min_by("_right", F.col("_right._id")).alias("_right"))
    return rights.filter(~is_hot).unionByName(lowest)
