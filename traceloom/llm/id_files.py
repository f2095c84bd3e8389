"""Token ids in binary files: Simple-8b words with escapes and per-block offsets (operator 7).

A file holds segments, each followed by one byte 0x0A. A segment holds whole documents: a header of eight 64-bit
numbers, document ids, null flags and lengths, the offset of each block of 256 ids, and the words. A word's
low four bits select how many ids of how many bits it packs; selector 14 announces an id of over 60 bits in the
next word. All numbers are little-endian. Blocks decode side by side, so decoding is arrays only.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import prepare
from traceloom.llm.encoder import encoder
from traceloom.session import materialise, shared_folder

# Ids in a word and bits of each, by selector; fixed values of the coding.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BITS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
ESCAPE = len(COUNTS)
BLOCK = 256
MAGIC = 0x31384253  # "SB81"
#: Ids of a segment (or the longest document), and segments of a file: they bound a task's memory.
SEGMENT_IDS = 1 << 20
FILE_SEGMENTS = 8


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block (one more at the end); ids are unsigned, up to 64 bits."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    width = np.zeros(blocks * block, np.uint8)
    for bits in BITS[:0:-1]:
        width[:n] += ids >= np.uint64(1 << int(bits))
    # The largest count that fits from each position: no id wider than the selector's bits within the block.
    levels = len(BITS) - 1 - width.reshape(blocks, block).astype(np.int8)  # the highest selector that holds the id
    low = {1: levels}
    span = 1
    while span < 64:
        wider = np.minimum(low[span], np.pad(low[span][:, span:], ((0, 0), (0, min(span, block))), constant_values=-1)[:, :block])
        span *= 2
        low[span] = wider
    choice = np.zeros((blocks, block), np.int8)
    for s in range(1, len(COUNTS)):
        count = int(COUNTS[s])
        half = 1 << (count.bit_length() - 1)
        least = low[half]
        if count > half:
            shift = count - half
            least = np.minimum(least, np.pad(least[:, shift:], ((0, 0), (0, shift)), constant_values=-1)[:, :block])
        choice = np.where(least >= s, np.int8(s), choice)
    choice = choice.reshape(-1)
    # Each block follows its own chain of words; the chains of all blocks advance together.
    limits = np.minimum((np.arange(blocks) + 1) * block, n)
    at, live, steps = np.arange(blocks) * block, np.arange(blocks), []
    while len(live):
        # Near the end of the last block a word may not reach over the last id.
        s = choice[at].copy()
        over = COUNTS[s] > limits[live] - at
        for i in np.flatnonzero(over):
            s[i] = np.flatnonzero(COUNTS <= limits[live[i]] - at[i])[-1]
        steps.append((live, at, s))
        at = at + COUNTS[s]
        keep = at < limits[live]
        at, live = at[keep], live[keep]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    of, starts, chosen = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(starts, kind="stable")
    of, starts, chosen = of[order], starts[order], chosen[order].astype(np.int64)
    large = (chosen == 0) & (ids[starts] >= np.uint64(1 << 60))
    place = np.arange(len(starts)) + np.cumsum(large) - large
    words = np.zeros(len(starts) + int(large.sum()), np.uint64)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero((chosen == s) & ~large)
        value = np.full(len(mine), s, np.uint64)
        for k in range(int(COUNTS[s])):
            value |= ids[starts[mine] + k] << np.uint64(4 + k * int(BITS[s]))
        words[place[mine]] = value
    words[place[large]] = ESCAPE
    words[place[large] + 1] = ids[starts[large]]
    sizes = np.bincount(of, minlength=blocks) + np.bincount(of[large], minlength=blocks)
    return words, np.append(0, np.cumsum(sizes))


def decode_ids(words: np.ndarray, n: int, offsets: np.ndarray | None = None) -> np.ndarray:
    """The ids of whole blocks; escapes are told from words by following the words of each block in step."""
    selectors = (words & np.uint64(15)).astype(np.int64)
    head = np.ones(len(words), bool)
    for i in np.flatnonzero(selectors == ESCAPE).tolist():  # rare: ids of over 60 bits
        if head[i]:
            head[i + 1] = False
    places = np.flatnonzero(head)
    chosen = selectors[places]
    counts = np.append(COUNTS, 1)[chosen]
    starts = np.cumsum(counts) - counts
    ids = np.zeros(n, np.uint64)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(chosen == s)
        value = words[places[mine]] >> np.uint64(4)
        low = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            ids[starts[mine] + k] = (value >> np.uint64(k * int(BITS[s]))) & low
    mine = np.flatnonzero(chosen == ESCAPE)
    ids[starts[mine]] = words[places[mine] + 1]
    return ids


def segment_bytes(partition: int, segment: int, before: int, doc_ids: list, ids: list[np.ndarray]) -> bytes:
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([0 if x is None else x for x in doc_ids], "<i8")
    lengths = np.array([len(x) for x in ids], "<i8")
    total = int(lengths.sum())
    words, offsets = encode_ids(np.concatenate(ids)) if total else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    header = np.array([MAGIC, partition, segment, before, len(ids), total, len(offsets), len(words)], "<i8")
    return b"".join(
        x.tobytes() for x in (header, numbers, lengths, known, offsets.astype("<i8"), words.astype("<u8"))
    )


def read_segments(content: bytes) -> Iterator[tuple]:
    """(partition, segment, ids before it in the partition, document ids, lengths, ids) of each segment of a file."""
    at = 0
    while at < len(content):
        magic, partition, segment, before, docs, total, blocks, count = np.frombuffer(content, "<i8", 8, at).tolist()
        if magic != MAGIC:
            raise ValueError("not a segment")
        at += 64
        numbers = np.frombuffer(content, "<i8", docs, at)
        lengths = np.frombuffer(content, "<i8", docs, at + 8 * docs)
        known = np.frombuffer(content, np.uint8, docs, at + 16 * docs)
        at += 17 * docs
        offsets = np.frombuffer(content, "<i8", blocks, at)
        words = np.frombuffer(content, "<u8", count, at + 8 * blocks)
        at += 8 * (blocks + count) + 1
        if offsets[-1] != count:
            raise ValueError("block offsets do not end at the last word")
        names = [x if k else None for x, k in zip(numbers.tolist(), known.tolist())]
        yield partition, segment, before, names, lengths, decode_ids(words, total, offsets)


def write_id_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write files of ids in ascending order of doc_id.

    Null texts are empty, null ids come first, documents with equal ids follow the hash of their texts. Documents are
    dealt out by ranges of (doc_id, hash), so a repeated id is split too; other columns are ignored. Spark's own
    committed text writer puts the bytes down, so a lost executor leaves no half files.
    """
    prepare(docs.sparkSession)
    spread = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*spread).sortWithinPartitions(*spread)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        names, held, size, number, before = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"value": [segment_bytes(partition, number, before, names, held)]})

        for batch in batches:
            for name, ids in zip(
                batch.column("doc_id").to_pylist(), encoder(tokenizer).encode(batch.column("text"), end_id)
            ):
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= segment_ids:
                    yield flush()
                    number, before = number + 1, before + size
                    names, held, size = [], [], 0
        if names:
            yield flush()

    rows = ordered.mapInArrow(segments, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read_id_files(spark, path: str) -> DataFrame:
    """(partition_no, segment, position, doc_id, before, n_tokens, ids_crc32) of each document in the files.

    ``before`` counts the ids ahead of the document in its partition.
    """
    schema = "partition_no long, segment long, position long, doc_id long, before long, n_tokens long, ids_crc32 long"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for partition, segment, before, names, lengths, ids in read_segments(content.as_buffer().to_pybytes()):
                    plain = ids.astype("<u4").tobytes()
                    ends = np.cumsum(lengths)
                    starts = ends - lengths
                    sums = [zlib.crc32(plain[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    n = len(names)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, partition)),
                            pa.array(np.full(n, segment)),
                            pa.array(np.arange(n)),
                            pa.array(names, pa.int64()),
                            pa.array(before + starts),
                            pa.array(lengths),
                            pa.array(sums, pa.int64()),
                        ],
                        names=[f.split()[0] for f in schema.split(", ")],
                    )

    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(documents, schema)


def id_digests(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write ``docs`` as files of ids, read them back: doc_id, start, n_tokens, ids_crc32 of each document.

    ``start`` counts the ids of all documents before it. Only one number per partition is added up in one task.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/traceloom/ids-{uuid.uuid4().hex}"
    write_id_files(docs, path, tokenizer, end_id)
    found = materialise(read_id_files(spark, path), "id-digests")
    totals = found.groupBy("partition_no").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("partition_no").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("partition_no", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("shift"))
    return found.join(shift, "partition_no").select(
        "doc_id", (F.col("shift") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
