"""Column expressions shared by the plans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_text(value: Column) -> Column:
    """Lower-case hexadecimal digits of a long, read as unsigned 64 bits."""
    return F.lower(F.hex(value))


def hex_text_unsigned(value: Column) -> Column:
    """Lower-case hexadecimal digits of an unsigned value held in a decimal."""
    return F.lower(F.conv(value.cast("string"), 10, 16))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, NULL where ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ipc(insns: Column, cycles: Column) -> Column:
    """Instructions per cycle to two places, 0 where no cycles were counted."""
    return F.when(cycles == 0, F.lit(0.0)).otherwise(F.round(ratio(insns, cycles), 2))


def code_text(code: Column, texts: Mapping[int, str]) -> Column:
    """Text of a numeric code; an unlisted code becomes its digits."""
    text = code.cast("string")
    for number, name in texts.items():
        text = F.when(code == number, name).otherwise(text)
    return text


def truth_text(flag: Column) -> Column:
    return F.when(flag == 0, "False").otherwise("True")


def touches(start: Column, end: Column, low: int, high: int) -> Column:
    """The closed interval meets the closed window anywhere, also by enclosing it."""
    return (start <= high) & (end >= low)


def ends_inside(start: Column, end: Column, low: int, high: int) -> Column:
    """At least one end of the interval lies in the closed window; an enclosing interval does not count."""
    return start.between(low, high) | end.between(low, high)


def plain_label(name: Column) -> Column:
    """A symbol name without its leading underscores."""
    return F.ltrim(name, F.lit("_"))
