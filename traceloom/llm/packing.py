"""Sum-of-squares packing of documents into windows of tokens (operator 1)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import prepare, run_starts, runs
from traceloom.llm.encoder import encoder
from traceloom.session import materialise

WINDOW = 4096
#: Partially filled windows that a task keeps open; beyond it they are cut together into full ones. Bounds memory.
OPEN_WINDOWS = 2048
#: Tasks whose last open windows (one each) are cut together.
GROUP = 64
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "ids binary, task long"
)


class Levels:
    """Open windows by fill level. ``counts[g]`` windows hold ``g`` tokens; a document goes to the level that makes
    the sum of squared counts smallest, the fullest level among equals; level 0 is a new window."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: dict[int, list[list]] = {}

    def place(self, piece: tuple, n: int) -> list | None:
        """Put a piece of ``n`` <= size tokens into a window; the window, if that fills it."""
        size, counts = self.size, self.counts
        fits = np.flatnonzero(counts[1 : size - n + 1]) + 1
        levels = np.append(fits, 0)
        # Leaving level g takes 2*counts[g]-1 from the sum, arriving at level h adds 2*counts[h]+1; 0 and size don't count.
        change = np.where(levels + n < size, 2 * counts[levels + n] + 1, 0) - np.where(levels > 0, 2 * counts[levels] - 1, 0)
        level = int(levels[np.lexsort((-levels, change))[0]])
        window = self.windows[level].pop() if level else []
        if level:
            counts[level] -= 1
        window.append(piece)
        if level + n == size:
            return window
        counts[level + n] += 1
        self.windows.setdefault(level + n, []).append(window)
        return None

    def drain(self) -> list[list]:
        """All open windows, the fullest first; none stay open."""
        out = [w for level in sorted(self.windows, reverse=True) for w in self.windows[level]]
        self.windows, self.counts = {}, np.zeros(self.size + 1, np.int64)
        return out


def cut_together(pieces: Iterator[tuple], size: int) -> Iterator[list]:
    """Windows filled with the pieces one after another; a piece that reaches over a window's end is cut."""
    window, level = [], 0
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            n = min(size - level, len(ids) - at)
            window.append((doc, start + at, ids[at : at + n], total))
            level, at = level + n, at + n
            if level == size:
                yield window
                window, level = [], 0
    if window:
        yield window


def rows_of(windows: list[list], first: int, keep_ids: bool, task: int) -> pa.RecordBatch:
    """One row per piece; sequence ids count from ``first``, null in windows that are still open (``keep_ids``)."""
    out: list[list] = [[] for _ in range(9)]
    for k, window in enumerate(windows):
        offset = 0
        for doc, start, ids, total in window:
            data = ids.astype("<u4").tobytes()
            row = (doc, start, len(ids), zlib.crc32(data), total, None if keep_ids else first + k, offset)
            for column, value in zip(out, (*row, data if keep_ids else None, task)):
                column.append(value)
            offset += len(ids)
    types = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = WINDOW, open_windows: int = OPEN_WINDOWS
) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into windows of ``size`` tokens; one row per piece of a document.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each row of ``docs`` is a document, also
    with a repeated or null doc_id; a null or empty text is the end id alone; other columns are ignored; no
    documents give no rows. A document of several windows fills whole windows; its rest is placed by sums of squares among
    its task's open windows. What stays open at the end of a task is cut together; its last window is written with its
    ids and cut together with those of GROUP tasks, so padding is less than a window per GROUP tasks.
    """
    spark = docs.sparkSession
    prepare(spark)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, levels, full = task << 40, Levels(size), []
        for batch in batches:
            texts = encoder(tokenizer).encode(batch.column("text"), end_id)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), texts):
                whole = len(ids) // size * size
                full.extend([(doc, at, ids[at : at + size], len(ids))] for at in range(0, whole, size))
                if whole < len(ids):
                    done = levels.place((doc, whole, ids[whole:], len(ids)), len(ids) - whole)
                    if done:
                        full.append(done)
                    if levels.counts.sum() > open_windows:
                        merged = list(cut_together((p for w in levels.drain() for p in w), size))
                        for p in merged.pop() if sum(len(p[2]) for p in merged[-1]) < size else []:
                            levels.place(p, len(p[2]))
                        full.extend(merged)
            if full:
                yield rows_of(full, number, False, task)
                number, full = number + len(full), []
        full = list(cut_together((p for w in levels.drain() for p in w), size))
        rest = full.pop() if full and sum(len(p[2]) for p in full[-1]) < size else None
        if full:
            yield rows_of(full, number, False, task)
        if rest:
            yield rows_of([rest], 0, True, task)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["group"], rows=1):
            starts = run_starts(table, ["group"])
            for a, b in zip(starts.tolist(), [*starts.tolist()[1:], table.num_rows]):
                part = table.slice(a, b - a)
                pieces = zip(
                    part["doc_id"].to_pylist(),
                    part["start"].to_pylist(),
                    (np.frombuffer(x, "<u4") for x in part["ids"].to_pylist()),
                    part["doc_tokens"].to_pylist(),
                )
                group = part["group"][0].as_py()
                yield rows_of(list(cut_together(pieces, size)), (1 << 62) + (group << 40), False, group)

    pieces = materialise(docs.select("doc_id", "text").mapInArrow(place, SCHEMA), "packed")
    rest = pieces.where("ids is not null").withColumn("group", F.floor(F.col("task") / GROUP).cast("long"))
    rest = rest.repartition("group").sortWithinPartitions("group", "task", "doc_id", "start", "ids_crc32")
    return pieces.where("ids is null").unionAll(rest.mapInArrow(close, SCHEMA)).drop("ids", "task")
