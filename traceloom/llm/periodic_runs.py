"""Periodic runs of words, found by an online sparse diagonal DP, and texts with their repeats collapsed.

A diagonal is a lag q: on it, the match length at word i counts the words up to i that equal the word q before them.
For each word, its earlier occurrences name the diagonals that may grow there; a diagonal that ends with enough matches
is a run. Of the earlier occurrences only those are followed that can still belong to a run: if a run's
smallest period is q, then the ``reach`` words from i on (the power of two in [q, 2q)) last stood exactly q words before. So
for each reach a word has one active lag, the distance to the last occurrence of its next ``reach`` words, however often the
word itself occurs, and the table stays sparse: words whose next words occur once leave it for good. Occurrences are
compared by classes of equal words, doubled in length each step, never by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import SLICE_BYTES, crc32_of_id, prepare

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def active_lags(classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far before each of the positions ``at`` (ascending) its class last stood; 0 if it did not."""
    order = np.argsort(classes, kind="stable")
    same = classes[order[1:]] == classes[order[:-1]]
    lags = np.zeros(len(at), np.int64)
    lags[order[1:][same]] = at[order[1:][same]] - at[order[:-1][same]]
    return lags


def find_runs(words: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """(start, length, period) of all runs in ``words`` (class numbers), a row each, by start, then period.

    A run is a stretch with smallest period q and at least max(``least``, ``exponent`` * q) words that no neighbour extends.
    Time grows with n log n, memory with n.
    """
    if exponent < 3:
        raise ValueError("runs need at least three periods")
    found = []
    at, classes, reach = np.arange(len(words)), words, 1
    while len(at) > 1:
        lags = active_lags(classes, at)
        on = (2 * lags > reach) & (lags <= reach)
        places, lag = at[on], lags[on]
        if len(places):
            # The DP over all words at once: a diagonal goes on where the next word has the same lag, else it ends.
            first = np.flatnonzero(np.append(True, (np.diff(places) != 1) | (np.diff(lag) != 0)))
            count = np.diff(np.append(first, len(places)))
            period = lag[first]
            length = count + reach - 1 + period
            long = length >= np.maximum(least, exponent * period)
            found.append(np.stack([places[first] - period, length, period], axis=1)[long])
        # The next ``reach`` doubles: only where both halves occur more than once can the whole do so.
        full = np.full(len(words) + 1, -1, np.int64)
        full[at] = classes
        twice = np.bincount(classes, minlength=1)[classes] > 1
        at = at[twice]
        second = full[np.minimum(at + reach, len(words))]
        at, second = at[second >= 0], second[second >= 0]
        classes, kinds = pd.factorize(full[at] * np.int64(len(words) + 1) + second)
        often = np.bincount(classes, minlength=1)[classes] > 1 if len(classes) else np.zeros(0, bool)
        at = at[often]
        classes = pd.factorize(classes[often])[0]
        reach *= 2
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Positions of the words that no run holds after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(cover[:n]) == 0)


def _batches(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of consecutive texts of about SLICE_BYTES together; a longer text comes alone."""
    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        data = (text or "").encode()
        held.append(data.split())  # bytes split at exactly the six ASCII white space characters
        size += len(data)
        if size > SLICE_BYTES:
            yield held
            held, size = [], 0
    yield held


def collapse_texts(texts: list[str | None], least: int, exponent: int) -> Iterator[tuple[np.ndarray, int, bytes]]:
    """(runs, number of words, collapsed text) of each text."""
    for group in _batches(texts):
        numbers: list[int] = []
        bounds = [0]
        for words in group:
            own: dict[bytes, int] = {}
            base = bounds[-1]  # numbers of different texts never meet
            numbers.extend([base + own.setdefault(w, len(own)) for w in words])
            bounds.append(base + len(words))
        found = find_runs(np.array(numbers, np.int64), least, exponent)
        cuts = np.searchsorted(found[:, 0], bounds)
        for words, base, a, b in zip(group, bounds, cuts, cuts[1:]):
            runs = found[a:b] - np.array([base, 0, 0])
            kept = words if a == b else [words[i] for i in kept_words(len(words), runs).tolist()]
            yield runs, len(words), b" ".join(kept)


def collapse_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed of each row of ``docs`` (doc_id, text).

    Words are what stands between ASCII white space. ``runs`` holds all periodic runs by start, then period; ``collapsed`` is the
    text without the words that a run holds after its first period, joined by single spaces. A null or empty text
    has no words, no runs and an empty collapsed text. A null or repeated doc_id stays as it is: each row is judged for itself. Other
    columns are ignored, an empty table gives none. A task holds one text at a time, or SLICE_BYTES of short ones; rows are
    not shuffled.
    """
    prepare(docs.sparkSession)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(collapse_texts(batch.column("text").to_pylist(), least, exponent))
            flat = np.concatenate([r[0] for r in rows]) if rows else np.zeros((0, 3), np.int64)
            ends = np.cumsum([0, *(len(r[0]) for r in rows)])
            runs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN_TYPE.value_type))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs, type=_RUN_TYPE),
                    pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(collapse, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which every tenth text by crc32 of its doc_id repeats words from some place on.

    Word i >= a becomes word a + (i - a) % p, with a = g % n, p = 1 + (n - a) // (3 + g % 8), g = crc32 // 10.
    """
    prepare(docs.sparkSession)

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, h in enumerate(batch.column("h").to_pylist()):
                words = (texts[i] or "").encode().split() if h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    tail = words[a : a + p]
                    texts[i] = b" ".join(words[:a] + (tail * ((n - a) // p + 1))[: n - a]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", crc32_of_id(F.col("doc_id")).alias("h"))
    return rows.mapInArrow(repeat, "doc_id long, text string")


def run_digests(docs: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = collapse_runs(docs).select("doc_id", "runs", "collapsed", longest.alias("best"))
    length, start, period = (F.col("best")[name] for name in ("length", "col2", "col3"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-start).alias("start"),
        length.alias("length"),
        (-period).alias("period"),
        F.floor(length * 1000 / -period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
