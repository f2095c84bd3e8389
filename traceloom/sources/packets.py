"""Decoding raw synthesised-event packets into the power-event tables.

A packet row has ``id``, ``config`` (which kind it is) and ``raw``, its little-endian bytes. All decoding
is byte slicing and bit arithmetic on columns; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Packet kind for each config number.
KINDS = {0: "ptwrite", 1: "mwait", 2: "pwre", 3: "exstop", 4: "pwrx", 5: "cbr"}
UNHANDLED = "unhandled"


def unsigned(raw: Column, offset: int, size: int) -> Column:
    """Little-endian unsigned integer of up to four bytes at ``offset``, as a long."""
    return F.conv(F.hex(_big_endian(raw, offset, size)), 16, 10).cast("long")


def signed64(raw: Column, offset: int) -> Column:
    """Eight little-endian bytes at ``offset`` as a long with the same bits."""
    return F.conv(F.hex(_big_endian(raw, offset, 8)), 16, -10).cast("long")


def _big_endian(raw: Column, offset: int, size: int) -> Column:
    # ``reverse`` works on text, so go through one character per byte.
    text = F.decode(F.substring(raw, offset + 1, size), "ISO-8859-1")
    return F.encode(F.reverse(text), "ISO-8859-1")


def bits(value: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(mask)).cast("int")


def with_kind(packets: DataFrame) -> DataFrame:
    """Add ``kind``; one pass serves all kinds, each reader filters the one it needs."""
    kind = F.lit(UNHANDLED)
    for config, name in KINDS.items():
        kind = F.when(F.col("config") == config, name).otherwise(kind)
    return packets.withColumn("kind", kind)


def reject_counts(packets: DataFrame) -> DataFrame:
    """Packets per kind, with the unknown ones counted as ``unhandled``."""
    return with_kind(packets).groupBy("kind").agg(F.count(F.lit(1)).alias("packets"))


def _of_kind(packets: DataFrame, kind: str) -> DataFrame:
    config = next(c for c, name in KINDS.items() if name == kind)
    return packets.filter(F.col("config") == config)


def decode_ptwrite(packets: DataFrame) -> DataFrame:
    raw = F.col("raw")
    return _of_kind(packets, "ptwrite").select(
        "id", signed64(raw, 4).alias("payload"), bits(unsigned(raw, 0, 4), 0, 1).alias("exact_ip")
    )


def decode_cbr(packets: DataFrame) -> DataFrame:
    """Core-to-bus ratio; MHz and percent are rounded with integer arithmetic."""
    ratio, highest, khz = (unsigned(F.col("raw"), at, size) for at, size in ((0, 1), (2, 1), (4, 4)))
    return (
        _of_kind(packets, "cbr")
        .select("id", ratio.alias("_ratio"), highest.alias("_highest"), khz.alias("_khz"))
        .select(
            "id",
            F.col("_ratio").cast("int").alias("cbr"),
            F.expr("cast((_khz + 500) div 1000 as int)").alias("mhz"),
            F.expr("cast((_ratio * 1000 div nullif(_highest, 0) + 5) div 10 as int)").alias("percent"),
        )
    )


def decode_mwait(packets: DataFrame) -> DataFrame:
    payload = signed64(F.col("raw"), 4)
    return _of_kind(packets, "mwait").select(
        "id", bits(payload, 0, 0xFF).alias("hints"), bits(payload, 32, 0x3).alias("extensions")
    )


def decode_pwre(packets: DataFrame) -> DataFrame:
    payload = signed64(F.col("raw"), 4)
    return _of_kind(packets, "pwre").select(
        "id",
        bits(payload, 12, 0xF).alias("cstate"),
        bits(payload, 8, 0xF).alias("subcstate"),
        bits(payload, 7, 0x1).alias("hw"),
    )


def decode_exstop(packets: DataFrame) -> DataFrame:
    return _of_kind(packets, "exstop").select(
        "id", bits(unsigned(F.col("raw"), 0, 4), 0, 1).alias("exact_ip")
    )


def decode_pwrx(packets: DataFrame) -> DataFrame:
    payload = signed64(F.col("raw"), 4)
    return _of_kind(packets, "pwrx").select(
        "id",
        bits(payload, 0, 0xF).alias("deepest_cstate"),
        bits(payload, 4, 0xF).alias("last_cstate"),
        bits(payload, 8, 0xF).alias("wake_reason"),
    )


DECODERS = {
    "ptwrite": decode_ptwrite,
    "mwait": decode_mwait,
    "pwre": decode_pwre,
    "exstop": decode_exstop,
    "pwrx": decode_pwrx,
    "cbr": decode_cbr,
}
