"""Cutting a total order into consecutive slices of bounded size.

An unpartitioned window would sort the whole table in one task. Here every row gets a slice number
that never decreases along the order, so a window per slice plus a small per-slice summary gives the
same answer in parallel. Two ways to choose the slices:

* :class:`WidthSlices` cuts a unique integer column every ``width`` values. A slice then holds at most
  ``width`` rows per group, whatever the data look like, and no pass over the data is needed.
* :class:`QuantileSlices` cuts at quantiles of any integer column. A value that is so frequent that it
  would fill slices on its own is split further, so it cannot overload one task. Up to FAN slices only: their
  bounds are literals in the plan.
* :class:`SliceDirectory` keeps the cuts as tables, an axis of its own for each group of rows, and cells that
  are too full as rows of further tables. Nothing of it is on the driver, whatever the number of groups and slices.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators.tree import FAN, floor_div
from traceloom.session import materialise

DEFAULT_WIDTH = 1 << 18
DEFAULT_SLICE_ROWS = 1 << 18
SAMPLE_PER_SLICE = 64
# Slice of rows without a key: before all others, as NULL sorts first.
NO_KEY = -(1 << 62)
UNSAMPLED_ROWS = 2_000_000


@dataclass(frozen=True)
class WidthSlices:
    """Slices of ``width`` consecutive values of a unique integer column."""

    width: int = DEFAULT_WIDTH

    def assign(self, df: DataFrame, key: str, out: str, spread: Column | None = None) -> DataFrame:
        """Add the slice number; ``spread`` is not needed because values are unique."""
        k = f"cast(`{key}` as bigint)"
        number = F.expr(f"({k} - pmod({k}, {self.width})) div {self.width}")
        return df.withColumn(out, F.coalesce(number, F.lit(NO_KEY)))

    @property
    def single(self) -> bool:
        return False

    def lost(self, column: Column) -> Column:
        """Slices for rows without a key, which match nothing."""
        return F.lit(NO_KEY) + F.pmod(F.xxhash64(column), F.lit(FAN))


@dataclass(frozen=True)
class QuantileSlices:
    """Slices between ``bounds``; values in ``hot`` are frequent enough to be split further.

    ``near`` says that every value minus ``origin``, the smallest one, fits in a long.
    """

    origin: int = 0
    bounds: tuple[int, ...] = ()
    hot: tuple[int, ...] = ()
    near: bool = True
    _splits: tuple[float, ...] = field(default=(), init=False, repr=False)

    def __post_init__(self) -> None:
        inner = sorted({float(b - self.origin) for b in self.bounds})
        object.__setattr__(self, "_splits", (-math.inf, *inner, math.inf))

    @property
    def single(self) -> bool:
        """True when all rows fit in one slice."""
        return not self.bounds

    @property
    def parts(self) -> int:
        """Number of pieces a hot value is cut into."""
        return len(self.bounds) + 1

    def ends(self) -> tuple[Column, Column]:
        """Spread of a row that comes before, or after, all others with the same hot value."""
        return F.lit(0), F.lit(self.parts + 1)

    def lost(self, column: Column) -> Column:
        """Slices for rows without a key, which match nothing."""
        return F.lit(NO_KEY) + F.pmod(F.xxhash64(column), F.lit(FAN))

    def scatter(self, *cols: Column) -> Column:
        """Spread of rows whose order among equal values does not matter."""
        return F.pmod(F.xxhash64(*cols), F.lit(self.parts)) + 1

    def assign(self, df: DataFrame, key: str, out: str, spread: Column | None = None) -> DataFrame:
        """Add the slice number as ``out``.

        The order is preserved in doubles too: rounding a long is monotone, so two close values may share
        a slice but never swap. ``spread`` (0 to ``parts + 1``) orders rows within a hot value.
        """
        if self.single:
            return df.withColumn(out, F.lit(0).cast("long"))
        k = F.col(key).cast("long")
        offset = k - F.lit(self.origin) if self.near else k.cast("double") - float(self.origin)
        raw, bucket = f"{out}_k", f"{out}_b"
        df = Bucketizer(
            splits=list(self._splits), inputCol=raw, outputCol=bucket, handleInvalid="keep"
        ).transform(df.withColumn(raw, offset.cast("double")))
        number = F.col(bucket).cast("long")
        if self.hot:
            stride = self.parts + 4
            hot_of: dict[int, int] = {}
            for v in self.hot:
                hot_of.setdefault(bisect_right(self._splits, float(v - self.origin)) - 1, v)
            pairs = [F.lit(x) for b, v in hot_of.items() for x in (b, v)]
            value = F.try_element_at(F.create_map(*pairs), number.cast("int"))
            spread = F.lit(0) if spread is None else spread
            inside = F.least(F.greatest(spread.cast("long"), F.lit(0)), F.lit(self.parts + 1)) + 1
            sub = (
                F.when(value.isNull() | (k < value), F.lit(0))
                .when(k == value, inside)
                .otherwise(F.lit(self.parts + 3))
            )
            number = number * stride + sub
        return df.withColumn(out, F.coalesce(number, F.lit(NO_KEY))).drop(raw, bucket)


def group_of(keys: Sequence[str]) -> Column:
    """Partition keys as one struct, so that a NULL key forms a group of its own in joins too."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def join_groups(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``table``, which has a row per combination of ``keys``; NULL keys meet."""
    rest = [c for c in table.columns if c not in keys]
    right = table.select(group_of(keys).alias("_group"), *rest)
    return df.withColumn("_group", group_of(keys)).join(right, "_group", how).drop("_group")


@dataclass(frozen=True)
class SliceDirectory:
    """Slices of each group along its own axis, as tables.

    ``tables[0]`` has the origin and width of the cells of each group, ``tables[i]`` those of the cells of level i - 1 that are
    too full, by the numbers ``_p0`` to ``_p<i-1>`` that lead there. A cell of one value goes on along the tie, or where the
    directory knows none, in ``_parts`` pieces between a first and a last one. A slice is the struct of its numbers.
    """

    tables: tuple[DataFrame, ...]

    single = False

    def ends(self) -> tuple[Column, Column]:
        """Spread of a row that comes before, or after, all others with the same hot value."""
        return F.lit(-1).cast("long"), F.lit((1 << 63) - 1)

    def scatter(self, *cols: Column) -> Column:
        """Spread of rows whose order among equal values does not matter."""
        return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 62) - 1))

    def lost(self, column: Column) -> Column:
        """Slices for rows without a key, which match nothing."""
        rest = [F.lit(0).cast("long").alias(f"p{i}") for i in range(1, len(self.tables))]
        return F.struct((F.lit(NO_KEY) + F.pmod(F.xxhash64(column), F.lit(FAN))).alias("p0"), *rest)

    def assign(self, df: DataFrame, key: str, out: str, spread: Column | None = None) -> DataFrame:
        """Add the slice as ``out``, and whether its value is hot as ``<out>_hot``. ``df`` has ``_group``."""
        k = F.col(key).cast("long")
        spread = F.lit(0).cast("long") if spread is None else spread.cast("long")
        rows = df.withColumns({"_hot": F.lit(False), "_spread": spread})
        for i, table in enumerate(self.tables):
            rows = rows.join(table, ["_group", *[f"_p{j}" for j in range(i)]], "left")
            value = F.when(F.col("_by_tie"), F.col("_spread")).otherwise(k)
            last = F.lit((1 << 63) - 1)
            piece = F.pmod(F.col("_spread"), F.col("_parts")) + 1
            piece = F.when(F.col("_spread") < 0, F.lit(0)).when(F.col("_spread") == last, F.col("_parts") + 1).otherwise(piece)
            number = F.when(F.col("_parts").isNotNull(), piece).otherwise(
                floor_div(value, F.col("_width")) - F.col("_origin")
            )
            # A cell of one value may meet others when the directory was made for other rows.
            number = F.when(k < F.col("_value"), F.lit(-(1 << 62))).when(k > F.col("_value"), F.lit(1 << 62)).otherwise(number)
            none = F.lit(NO_KEY) if i == 0 else F.lit(0).cast("long")
            rows = rows.withColumns(
                {f"_p{i}": F.coalesce(number, none), "_hot": F.col("_hot") | F.col("_parts").isNotNull()}
            ).drop("_origin", "_width", "_by_tie", "_parts", "_value")
        numbers = [f"_p{i}" for i in range(len(self.tables))]
        slice_ = F.struct(*[F.col(n).alias(n[1:]) for n in numbers])
        return rows.withColumns({out: slice_, f"{out}_hot": F.col("_hot")}).drop("_hot", "_spread", *numbers)


def slice_directory(
    df: DataFrame,
    key: str,
    *,
    keys: Sequence[str] = (),
    tie: str | None = None,
    rows_per_slice: int = DEFAULT_SLICE_ROWS,
) -> SliceDirectory:
    """Cut ``df`` along ``key`` within each combination of ``keys`` into slices of about ``rows_per_slice`` rows.

    Each group gets an axis between its own ends with as many equal cells as its rows ask for; cells that turn out
    too full are cut again between their own ends, and so on. A pass over ``df`` per level: pass a stored table. ``tie`` makes
    equal keys unique, as in :func:`ordered_scan`.
    """
    tie_ = F.col(tie).cast("long") if tie else F.lit(None).cast("long")
    rows = df.select(group_of(keys).alias("_group"), F.col(key).cast("long").alias("k"), tie_.alias("t"))
    rows = rows.filter("k is not null")
    extent = [F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in "kt" for f in (F.min, F.max)]]

    def entries(cells: DataFrame, least: int) -> DataFrame:
        same = F.col("min_k") == F.col("max_k")
        by_tie = same & F.coalesce(F.col("min_t") < F.col("max_t"), F.lit(False))
        low, high = (F.when(by_tie, F.col(f"{f}_t")).otherwise(F.col(f"{f}_k")).cast("decimal(38,0)") for f in ("min", "max"))
        count = F.greatest(F.ceil(F.col("n") / rows_per_slice), F.lit(least))
        width = F.least(F.ceil((high - low + 1) / count), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
        parts = F.when(same & ~by_tie & F.lit(tie is None and least > 1), count)
        path = [c for c in cells.columns if c.startswith("_")]
        return cells.select(
            *path, width.alias("_width"), by_tie.alias("_by_tie"), parts.cast("long").alias("_parts"),
            floor_div(F.when(by_tie, F.col("min_t")).otherwise(F.col("min_k")), width).alias("_origin"),
            F.when(by_tie | parts.isNotNull(), F.col("min_k")).alias("_value"),
        )

    top = materialise(entries(rows.groupBy("_group").agg(*extent), 1), "slices")
    tables = [top]
    while True:
        placed = SliceDirectory(tuple(tables)).assign(rows, "k", "_slice", F.col("t") if tie else None)
        path = [F.col("_slice")[f"p{i}"].alias(f"_p{i}") for i in range(len(tables))]
        cells = placed.filter(~F.col("_slice_hot")).groupBy("_group", *path).agg(*extent)
        wider = (F.col("min_k") < F.col("max_k")) | F.coalesce(F.col("min_t") < F.col("max_t"), F.lit(tie is None))
        full = cells.filter((F.col("n") > 2 * rows_per_slice) & wider)
        level = materialise(entries(full, 16), "slices")
        if level.isEmpty():
            return SliceDirectory(tuple(tables))
        tables.append(level)


def quantile_slices(
    df: DataFrame,
    key: str,
    rows_per_slice: int = DEFAULT_SLICE_ROWS,
    max_slices: int | None = None,
    *,
    keys: Sequence[str] = (),
    tie: str | None = None,
) -> QuantileSlices | SliceDirectory:
    """Choose slices for column ``key`` from its quantiles, or a directory where more than FAN are needed.

    With ``max_slices`` there are at most that many, and never a directory. ``keys`` and ``tie`` are those of the scan or join the
    slices are for; only a directory uses them.

    Runs one counting pass and, for tables larger than a slice, one pass over at most
    ``SAMPLE_PER_SLICE`` sampled rows per slice; like the sampling of a range repartition this only
    steers the balance, never the result. Pass a stored table, since its lineage is read twice.
    """
    found = df.select(F.col(key).cast("long").alias("k")).filter("k is not null")
    low, high, rows = found.agg(F.min("k"), F.max("k"), F.count("k")).first()
    count = math.ceil(rows / rows_per_slice)
    if max_slices is None and count > FAN:
        return slice_directory(df, key, keys=keys, tie=tie, rows_per_slice=rows_per_slice)
    count = min(max_slices or FAN, count)
    if count <= 1:
        return QuantileSlices(origin=low or 0)
    near = high - low < 2**63
    # The quantile sketch works in doubles: measure from the smallest value to keep them exact.
    base = low if near else 0
    if rows > UNSAMPLED_ROWS:
        found = found.sample(fraction=min(1.0, max(UNSAMPLED_ROWS, SAMPLE_PER_SLICE * count) / rows), seed=7)
    shares = [i / count for i in range(1, count)]
    sketch = F.percentile_approx(F.col("k") - base, shares, max(10_000, 16 * count))
    points = [base + p for p in found.agg(sketch).first()[0] or []]
    hot = sorted({a for a, b in zip(points, points[1:]) if a == b})
    return QuantileSlices(origin=low, bounds=tuple(sorted(set(points))), hot=tuple(hot), near=near)
