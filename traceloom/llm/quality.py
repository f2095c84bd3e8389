"""Quality scores from document statistics by random Fourier features (operator 8).

Standardised statistics go through ``FEATURES`` cosines with fixed random directions, whose products approximate a Gaussian
kernel. Each partition sums its part of the normal equations, Spark adds the parts, and the driver solves one system of
FEATURES + 1 unknowns. Isotonic regression over a fixed grid of raw scores turns them into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import Words, crc32_of_id, prepare, raw_bytes, slices
from traceloom.session import materialise

FEATURES = 128
WIDTH = 3.0  # of the kernel, in standard deviations of a statistic
RIDGE = 1e-3  # per training row
GRID = 1000  # cells of the calibration between raw scores -0.5 and 1.5
STATISTICS = (
    "bytes words word_length long_words distinct repeated upper digits symbols other_bytes bars marked lines "
    "line_words letters"
).split()


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text, all of bounded size; a null or empty text is a row of zeros."""
    out = []
    for _, part in slices(texts):
        raw, bounds = raw_bytes(part)
        words = Words(part)
        n, at = len(part), words.at
        count = np.diff(at)
        size = np.diff(bounds)
        owner = np.repeat(np.arange(n), count)

        def bytes_in(mask: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(mask))[bounds])

        def words_in(mask: np.ndarray) -> np.ndarray:
            return np.bincount(owner[mask], minlength=n)

        upper, lower = (raw > 64) & (raw < 91), (raw > 96) & (raw < 123)
        digit, high, space = (raw > 47) & (raw < 58), raw > 127, (raw == 32) | ((raw > 8) & (raw < 14))
        symbol = ~(upper | lower | digit | high | space | (raw == 44) | (raw == 46))
        lengths = words.ends - words.starts
        again = np.zeros(len(lengths), bool)
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
        fresh = ~pd.Series(words.hashes ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))).duplicated().to_numpy()
        last = raw[words.ends - 1] if len(lengths) else raw[:0]
        marked = ~(((last > 47) & (last < 58)) | ((last > 64) & (last < 91)) | ((last > 96) & (last < 123)) | (last > 127) | (last == 44) | (last == 46))
        lines = bytes_in(raw == 10) + (size > 0)
        w, b = np.maximum(count, 1), np.maximum(size, 1)
        out.append(
            np.stack(
                [
                    np.log1p(size),
                    np.log1p(count),
                    np.log1p(np.bincount(owner, lengths, n) / w),
                    words_in(lengths > 20) / w,
                    words_in(fresh) / w,
                    words_in(again) / w,
                    bytes_in(upper) / b,
                    bytes_in(digit) / b,
                    bytes_in(symbol) / b,
                    bytes_in(high) / b,
                    bytes_in(raw == 124) / w,
                    words_in(marked) / w,
                    np.log1p(lines),
                    np.log1p(count / np.maximum(lines, 1)),
                    bytes_in(upper | lower | high) / b,
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            column = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "doc_id long, x array<double>")


def directions(dimension: int, features: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.normal(size=(dimension, features)) / width, rng.uniform(0, 2 * np.pi, features)


class Model:
    """Means and deviations of the statistics, weights of the cosines, and the calibrated score of each grid cell."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH):
        self.mean, self.deviation, self.features = mean, deviation, features
        self.w, self.b = directions(len(mean), features, width)
        self.weights: np.ndarray | None = None
        self.scores: np.ndarray | None = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Features of rows of statistics, after a constant 1."""
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack((np.ones((len(x), 1)), np.sqrt(2 / self.features) * np.cos(z @ self.w + self.b)))

    def cells(self, x: np.ndarray) -> np.ndarray:
        raw = self.cosines(x) @ self.weights
        return np.clip(((raw + 0.5) / 2 * GRID).astype(np.int64), 0, GRID - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scores[self.cells(x)]


def stacked(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of positive / total by weighted pooling of adjacent violators; empty cells interpolate."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(total).tolist():
        blocks.append([positive[i], total[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, t, _, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + t, blocks[-1][2], end]
    x = [c for block in blocks for c in (block[2], block[3])]
    y = [block[0] / block[1] for block in blocks for _ in range(2)]
    return np.clip(np.interp(np.arange(len(total)), x, y), 0, 1)


def fit(training: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> Model | None:
    """Fit on ``training`` (x, y); None without rows. All rows count; only sums reach the driver."""
    dimension = len(STATISTICS)
    moments = training.select(
        F.count("*").alias("n"),
        *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(dimension)),
        *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(dimension)),
    ).first()
    if not moments["n"]:
        return None
    mean = np.array([moments[f"m{i}"] for i in range(dimension)])
    deviation = np.array([moments[f"s{i}"] or 1.0 for i in range(dimension)])
    model = Model(mean, deviation, features, width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = model.cosines(stacked(batch.column("x"), dimension))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            total += z.T @ np.hstack((z, y[:, None]))
        yield pa.RecordBatch.from_pydict({"i": np.arange(features + 1), "v": list(total)})

    parts = training.mapInArrow(sums, "i long, v array<double>")
    rows = parts.groupBy("i").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(features + 2))).collect()
    system = np.array([row[1:] for row in sorted(rows)])
    normal = system[:, :-1] + ridge * moments["n"] * np.diag([0.0] + [1.0] * features)
    model.weights = np.linalg.solve(normal, system[:, -1])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, GRID))
        for batch in batches:
            cells = model.cells(stacked(batch.column("x"), dimension))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            total += np.bincount(cells, y, GRID), np.bincount(cells, minlength=GRID)
        there = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_pydict({"cell": there, "positive": total[0][there], "total": total[1][there]})

    cells = training.mapInArrow(counts, "cell long, positive double, total double")
    grid = np.zeros((2, GRID))
    for row in cells.groupBy("cell").agg(F.sum("positive"), F.sum("total")).collect():  # at most GRID rows
        grid[:, row[0]] = row[1], row[2]
    model.scores = isotonic(*grid)
    return model


def fit_labels(found: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the rows of ``found`` (doc_id, x) that are not held out and have a label (their mean, if several)."""
    marks = labels.where("quality is not null and doc_id is not null")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").cast("double").alias("y"))
    training = found.where(crc32_of_id(F.col("doc_id")) % 5 != 0).join(marks, "doc_id").select("x", "y")
    return fit(materialise(training, "training"))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    Learns ``labels.quality`` of documents whose crc32(doc_id as text) mod 5 is not 0, from statistics of the whole texts
    alone; ``held_out`` marks the others. Labels that are null count as none, several labels of a document as their mean;
    repeated rows of a document each count. Null and empty texts have a row of zeros for statistics.
    Without any label every score is 0.5. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    found = materialise(document_statistics(docs), "statistics")
    model = fit_labels(found, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model_scores(model, stacked(batch.column("x"), len(STATISTICS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= cut).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = found.select("doc_id", (crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "x")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def model_scores(model: Model | None, x: np.ndarray) -> np.ndarray:
    return model.score(x) if model else np.full(len(x), 0.5)


def keep_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut`` (see ``quality_scores``), with all their columns.

    Each row is judged in place by its own text, so no text is shuffled and repeated ids need no rule.
    """
    prepare(docs.sparkSession)
    model = fit_labels(document_statistics(docs), labels)

    # Plain names on the way through Arrow, whose results are resolved by name: given ones may hold dots.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model_scores(model, statistics(batch.column(text)))
            yield batch.filter(pa.array(values >= cut))

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
