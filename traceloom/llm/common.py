"""What several operators share: words of texts as arrays, bounded Arrow batches, sorted runs, connected components."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.session import materialise

SPACE_BYTES = (0x20, *range(0x09, 0x0E))
BATCH_BYTES = 8 << 20
#: Texts are handled in slices of about this many bytes, so memory follows the slice or the longest text.
SLICE_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
#: Rows of a group that are compared in one piece; larger groups are cut into pairs of blocks.
BLOCK = 256
#: Bits of a filter of ids that every task gets: 4 MB.
FILTER_BITS = 1 << 25
LONG_WORD = 64
INVERSE = pow(BASE, -1, 1 << 64)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Bound Arrow batches to Python workers by bytes too, and let workers of this machine import the library."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, [paths]), root])


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` stored with a number of its own for each row, and that column's name, which ``df`` does not have."""
    name = "row_number"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), label), name


def quoted(columns: list[str]) -> list[Column]:
    """Columns by names that may hold dots or backticks."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in columns]


def crc32_of_id(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit values in which every bit of the input reaches every output bit."""
    x = values.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(separators: tuple[int, ...] = SPACE_BYTES) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(separators)] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = byte_table()
#: ASCII that is neither a letter nor a digit; bytes of other characters belong to words.
NOT_ALNUM = byte_table(tuple(c for c in range(128) if not chr(c).isalnum()))

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins; the array is large_string without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """The words of a slice of texts as arrays: byte ranges, hashes, and each text's range of words.

    A word is a longest run of bytes that are not separators. Hashes are of the word's bytes, 64 bits wide: sums along the
    text for words of under LONG_WORD bytes; such sums are no hash of longer ones, of which some always collide, so
    these are hashed one by one.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = True):
        raw, self.bounds = raw_bytes(texts)
        self.bytes = LOWER[raw] if lower else raw
        inside = ~separators[self.bytes]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = self.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, self.bounds)  # text i has the words at[i]..at[i+1]
        up, down = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        self.sums, self.down = sums, down
        self.hashes = self.hash(self.ends)

    def hash(self, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words if they ended at ``ends``."""
        found = mix((self.sums[ends] - self.sums[self.starts]) * self.down[self.starts])
        for i in np.flatnonzero(ends - self.starts >= LONG_WORD).tolist():
            word = self.bytes[self.starts[i] : ends[i]].tobytes()
            found[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found

    def text_of(self, i: int) -> str:
        return self.bytes[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of about ``limit`` bytes with the position of their first text; null texts are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, texts.slice(at, end - at)
        at = end


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter, nothing for no words."""
    n = min(size, len(words))
    if n == 0:
        return np.zeros(0, np.uint64)
    count = len(words) - n + 1
    total = np.full(count, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(BASE) + words[k : k + count]
    return mix(total)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (the last may have less) that hold whole runs of equal keys.

    The partition must be sorted by the keys, which hold no nulls.
    """
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        first = run_starts(table, keys)[-1]
        if first:
            yield table.slice(0, first)
        held, count = [table.slice(first)], table.num_rows - first
    if held:
        yield pa.concat_tables(held).combine_chunks()


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for key in keys:
        values = table[key].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def pairs_within(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of all pairs within each (bounded) run of ``n`` rows."""
    sizes = np.diff(np.append(starts, n))
    later = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # rows of the same run after each row
    left = np.repeat(np.arange(n), later)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
    return left, right


def in_blocks(rows: DataFrame, name: str, block: int = BLOCK) -> DataFrame:
    """Rows with (bi, bj, side): the pairs of blocks in which a row of a group of ``size`` rows is compared."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64(F.col(name)), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        "*", F.least("b", "other").alias("bi"), F.greatest("b", "other").alias("bj")
    ).drop("blocks", "other")


def block_pairs(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows to compare: within a block, or between the two blocks of a pair of blocks."""
    left, right = pairs_within(starts, table.num_rows)
    b, bi, bj = (table[c].to_numpy() for c in ("b", "bi", "bj"))
    keep = (bi[left] == bj[left]) | (b[left] != b[right])
    return left[keep], right[keep]


def filter_bits(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> bytes:
    """A bit map of fixed size with the bits of all ``ids`` (one long column, no nulls) set.

    Tasks make partial maps in chunks, which Spark brings together by chunk; the driver gets FILTER_BITS / 8 bytes. Ids
    outside may hit a set bit, so an exact join follows wherever it is used to spare a shuffle.
    """
    name = ids.columns[0]
    chunks = 64
    width = FILTER_BITS // 8 // chunks

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[filter_bits(batch.column(name).to_numpy())] = True
        rows = np.packbits(bits).reshape(chunks, width)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_pydict({"chunk": used, "bits": [rows[i].tobytes() for i in used]})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, bits in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist()):
                held[chunk] = held.get(chunk, np.uint8(0)) | np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_pydict({"chunk": list(held), "bits": [x.tobytes() for x in held.values()]})

    parts = ids.mapInArrow(partial, "chunk long, bits binary").repartition(chunks, "chunk")
    out = np.zeros((chunks, width), np.uint8)
    for row in parts.mapInArrow(whole, "chunk long, bits binary").collect():
        out[row.chunk] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` positions reaches through the pairs."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
        left, right = label[left], label[right]
        keep = left != right
        left, right = left[keep], right[keep]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
    while not (label[label] == label).all():
        label = label[label]
    return label


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of ``edges`` (a, b: long, none null, a != b).

    Alternates two steps on stored edge tables: hang every larger neighbour on the smallest neighbour, then every
    smaller one. The number of rounds grows with the logarithm of the longest path. Minima are partial
    aggregates, and a hub's rows are split by the skew join, so no task holds a whole component.
    """
    edges = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(),
        f"{label}-edges",
    )
    before = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a != b").distinct(), f"{label}-large")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            lowest.select("a", F.col("m").alias("b"))
        )
        edges = materialise(small.where("a != b").distinct(), f"{label}-small")
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
