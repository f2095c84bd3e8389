"""Near-duplicate vectors by counted collisions of one-dimensional projections (operator 4).

A vector is projected on many random directions. Sorted projections cut into strips give ``tables`` of keys, each of
several strips; both numbers follow from the number of vectors and the wanted recall. For each pair that
shares a key, the windows centred on one vector's projections that hold the other's are counted over
``COUNTED`` directions; pairs with a count that linked vectors reach (but for ``MISS``) are verified by their cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import (
    BASE,
    block_pairs,
    connected_components,
    in_blocks,
    local_components,
    mix,
    prepare,
    run_starts,
    runs,
)
from traceloom.session import materialise

COUNTED = 64
STRIP = 1.4  # width of a strip and half-width of a counting window, for vectors of length 1
WINDOW = 0.4
MISS = 1e-4  # chance that a pair just at the threshold is lost by its count
LOST = 1e-3  # and by its keys
PER_KEY = 16  # unrelated vectors expected under a key
UNIT = 1 << 24  # vectors and directions are rounded to integers, so every task computes equal projections
GRAIN = 1 << 8


def inside(width: float, deviation: float) -> float:
    """Chance that a normal number of this deviation is at most ``width`` away from 0."""
    return math.erf(width / deviation / math.sqrt(2))


def same_strip(deviation: float) -> float:
    """Chance that two projections whose difference has this deviation share a strip at random offsets."""
    grid = (np.arange(2000) + 0.5) / 2000 * STRIP
    density = 2 / (deviation * math.sqrt(2 * math.pi)) * np.exp(-0.5 * (grid / deviation) ** 2)
    return float((density * (1 - grid / STRIP)).sum() * STRIP / 2000)


class Projections:
    """Directions, strip keys and the count that linked pairs reach, for ``n`` vectors of a dimension."""

    def __init__(self, n: int, dimension: int, cosine: float):
        near = math.sqrt(2 - 2 * cosine)
        p_near, p_far = same_strip(near), same_strip(math.sqrt(2))
        self.strips = max(1, math.ceil(math.log(max(n / PER_KEY, 2)) / -math.log(p_far)))
        self.tables = math.ceil(math.log(LOST) / math.log(1 - p_near**self.strips))
        p, total, self.least = inside(WINDOW, near), 0.0, 0
        for k in range(COUNTED + 1):
            total += math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)
            if total > MISS:
                self.least = k
                break
        rng = np.random.default_rng(4)
        self.counted = np.rint(rng.normal(size=(dimension, COUNTED)) * GRAIN)
        self.keyed = np.rint(rng.normal(size=(dimension, self.tables * self.strips)) * GRAIN)
        self.offsets = rng.uniform(0, STRIP, self.tables * self.strips)

    def project(self, unit: np.ndarray, directions: np.ndarray) -> np.ndarray:
        return np.rint(unit * UNIT) @ directions / (UNIT * GRAIN)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A key per table for each row: a hash of the table and of the row's strips."""
        strips = np.floor((self.project(unit, self.keyed) + self.offsets) / STRIP).astype(np.int64).view(np.uint64)
        strips = strips.reshape(len(unit), self.tables, self.strips)
        value = np.broadcast_to(np.arange(self.tables, dtype=np.uint64), strips.shape[:2]).copy()
        for k in range(self.strips):
            value = value * np.uint64(BASE) + strips[:, :, k]
        return mix(value).view(np.int64)


def unit_rows(column: pa.Array) -> np.ndarray:
    x = np.stack([np.frombuffer(v, "<f8") for v in column.to_pylist()])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vector_links(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding).

    Vectors link if the cosine of their components in double precision is at least ``cosine``; only vectors of equal length
    are compared. Null, empty and zero vectors and those with null or non-finite components link with nothing. Equal
    vectors are one class that is compared once and counts as often as it stands there; every link of a
    class counts for all its rows. ``component_id`` is the smallest vec_id reachable. Rows with a null vec_id
    count as links of others but name no component. Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(finite, F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 becomes 0.0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if x is None else np.array(x, "<f8").tobytes() for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    rows = rows.mapInArrow(pack, "vec_id long, v binary").withColumn("hash", F.xxhash64("v"))
    rows = materialise(rows, "vectors")
    classes = rows.where("v is not null").groupBy("hash", "v").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("smallest")
    )
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    links = None
    for row in classes.groupBy(F.length("v").alias("bytes")).agg(F.count("*").alias("n")).orderBy("bytes").collect():
        found = class_links(classes.where(F.length("v") == row["bytes"]), row["n"], row["bytes"] // 8, cosine)
        links = found if links is None else links.unionAll(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = materialise(links, "vector-links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    named = classes.join(counts, "node", "left").join(groups, "node", "left")
    named = materialise(named.withColumn("component", F.coalesce("component", "node")), "named")
    lowest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = named.join(lowest, "component").select(
        "hash", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    out = rows.join(named, ["hash", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def class_links(classes: DataFrame, n: int, dimension: int, cosine: float) -> DataFrame:
    """(node, links, root): copies of linked classes found in a block, and the first node of its component there."""
    plan = Projections(n, dimension, cosine)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = plan.keys(unit_rows(part.column("v")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("node").to_numpy(), plan.tables)), pa.array(found.ravel())], names=["node", "key"]
                )

    listed = materialise(classes.select("node", "v").mapInArrow(keys, "node long, key long"), "vector-keys")
    sizes = listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    placed = in_blocks(listed.join(sizes, "key"), "node").join(classes.select("node", "copies", "v"), "node")
    order = ["key", "bi", "bj"]
    placed = placed.select(*order, "node", "b", "copies", "v").repartition(*order).sortWithinPartitions(*order, "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, order):
            unit = unit_rows(table["v"])
            place = plan.project(unit, plan.counted)
            key, node, copies = (table[c].to_numpy() for c in ("key", "node", "copies"))
            left, right = block_pairs(table, run_starts(table, order))
            found = []
            for at in range(0, len(left), 1 << 14):
                a, b = left[at : at + (1 << 14)], right[at : at + (1 << 14)]
                count = (np.abs(place[a] - place[b]) <= WINDOW).sum(axis=1)
                a, b = a[count >= plan.least], b[count >= plan.least]
                good = (unit[a] * unit[b]).sum(axis=1) >= cosine
                found.append((a[good], b[good]))
            if not found:
                continue
            left, right = (np.concatenate(x) for x in zip(*found))
            if not len(left):
                continue
            label = local_components(len(node), left, right)
            # A pair is counted under the first key that it shares, which is the same in whatever task it is found.
            rows, index = np.unique(np.concatenate((left, right)), return_inverse=True)
            own = plan.keys(unit[rows])
            total = np.zeros(len(node), np.int64)
            half = len(left)
            for at in range(0, half, 1 << 14):
                i, j = index[at : min(half, at + (1 << 14))], index[half + at : half + min(half, at + (1 << 14))]
                a, b = left[at : at + (1 << 14)], right[at : at + (1 << 14)]
                same = own[i] == own[j]
                first = own[i, np.argmax(same, axis=1)] == key[a]
                np.add.at(total, a[first], copies[b[first]])
                np.add.at(total, b[first], copies[a[first]])
            yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(total[rows]), pa.array(node[label[rows]])], names=["node", "links", "root"])

    return placed.mapInArrow(link, "node long, links long, root long")
