"""Running values over slice summaries, as a tree: sums go up, what is carried over comes down.

Summaries of neighbouring slices are combined FAN to one until few are left, those are scanned, and each level hands what it
carries to the level below. So no task sees more than FAN summaries of a group at a time, however many slices
there are and however their numbers are spread.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.session import materialise

FAN = 1024


def floor_div(value: Column, by: Column | int) -> Column:
    """Whole quotient rounded down, for any sign."""
    by = F.lit(by) if isinstance(by, int) else by
    return F.call_function("div", value - F.pmod(value, by), by)


def carried_over(summary: DataFrame, kinds: Mapping[str, str], fan: int = FAN, label: str = "summaries") -> DataFrame:
    """(_group, _slice, and ``_c_<name>`` for each name) from one row per (_group, _slice) with a column per name.

    ``sum`` carries the total of all earlier slices of the group, ``last`` the nearest non-NULL value of an earlier one,
    ``next`` that of a later one, ``low`` the smallest value of the whole group. ``_slice`` is a long or a struct of longs,
    compared from the first to the last.
    """
    level = materialise(summary, label)
    kind = level.schema["_slice"].dataType
    parts = [F.col("_slice")[f] for f in kind.fieldNames()] if isinstance(kind, T.StructType) else [F.col("_slice")]
    columns = [f"_p{i}" for i in range(len(parts))]
    level = level.select("*", *[p.alias(c) for p, c in zip(parts, columns)])

    levels = []
    while True:
        own = columns[-1]
        rows, low, high = level.agg(F.count(F.lit(1)), F.min(own), F.max(own)).first()
        if rows <= fan or (len(columns) == 1 and high - low < fan):
            break
        above = {c: F.col(c) for c in columns[:-1]}
        if high - low >= fan:
            above[own] = floor_div(F.col(own), fan)
        level = level.withColumns({f"_up{c}": e for c, e in above.items()})
        levels.append((level, own, list(above)))
        columns = list(above)
        combined = {
            "sum": lambda c, own=own: F.sum(c),
            "last": lambda c, own=own: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(own))),
            "next": lambda c, own=own: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(own))),
            "low": lambda c, own=own: F.min(c),
        }
        level = level.groupBy("_group", *[F.col(f"_up{c}").alias(c) for c in columns]).agg(
            *[combined[kind](name).alias(name) for name, kind in kinds.items()]
        )
        level = materialise(level, label)

    def within(among: list[str], own: list[str], name: str, kind: str) -> Column:
        siblings = Window.partitionBy("_group", *among)
        if kind == "low":
            return F.min(name).over(siblings)
        order = [F.col(c).desc() if kind == "next" else F.col(c).asc() for c in own]
        earlier = siblings.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.sum(name).over(earlier) if kind == "sum" else F.last(name, ignorenulls=True).over(earlier)

    done = level.withColumns({f"_c_{n}": within([], columns, n, k) for n, k in kinds.items()})
    for level, own, above in reversed(levels):
        up = [f"_up{c}" for c in above]
        handed = done.select(
            "_group", *[F.col(c).alias(f"_up{c}") for c in above], *[F.col(f"_c_{n}").alias(f"_h_{n}") for n in kinds]
        )
        done = level.withColumns({f"_c_{n}": within(up, [own], n, k) for n, k in kinds.items() if k != "low"})
        done = done.join(handed, ["_group", *up])
        for n, k in kinds.items():
            here, handed_on = F.col(f"_c_{n}"), F.col(f"_h_{n}")
            if k == "low":
                value = handed_on
            elif k == "sum":
                value = F.coalesce(here + handed_on, here, handed_on)
            else:
                value = F.coalesce(here, handed_on)
            done = done.withColumn(f"_c_{n}", value)
    return done.select("_group", "_slice", *[f"_c_{n}" for n in kinds])
