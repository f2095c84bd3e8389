"""Benchmark passages in documents by SimHash of item-sized windows (operator 10).

Every window of a document that is as long as some benchmark item gets a weighted SimHash fingerprint of its shingles.
A multi-index over the items' fingerprints finds all items within ``RADIUS`` bits: fingerprints are cut into ``BITS`` / 8 blocks
of 8 bits, and two fingerprints within the radius agree in some block up to RADIUS // blocks bits. Candidates are
then verified by the exact weighted similarity of their shingles. Windows in which the shingles of all items weigh less than
the threshold's share cannot reach it with any item and are not fingerprinted; shingles of items too heavy for the window
do not count there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import BASE, NOT_ALNUM, Words, mix, numbered, prepare, quoted, shingle_hashes, slices
from traceloom.session import materialise

BITS = 128
BLOCKS = BITS // 8
RADIUS = 31
#: Benchmark text that one pass over the documents compares with; a larger benchmark takes several passes.
PASS_BYTES = 32 << 20
#: Pairs of windows and items that one look-up in the multi-index forms for a block at most.
PAIRS = 1 << 22
NEAR = np.array([0] + [1 << k for k in range(8)], np.uint8)  # the 9 values within one bit of a block's


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of BITS values +1 or -1 for each hash."""
    both = np.stack((mix(hashes ^ np.uint64(BASE)), mix(hashes + np.uint64(BASE))), axis=1)
    bits = np.unpackbits(np.ascontiguousarray(both).view(np.uint8).reshape(len(hashes), BITS // 8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """BITS / 8 bytes per row of sums of signs, each times the root of its shingle's weight."""
    return np.packbits(sums > 0, axis=1)


def repeats(shingles: np.ndarray) -> np.ndarray:
    """For each place the first one at which a shingle comes again that also lies at or after the given place."""
    order = np.argsort(shingles, kind="stable")
    again = np.full(len(shingles), len(shingles), np.int64)
    same = np.flatnonzero(shingles[order[1:]] == shingles[order[:-1]])
    again[order[same]] = order[same + 1]
    return np.minimum.accumulate(again[::-1])[::-1]


class Benchmark(NamedTuple):
    """What weights and windows need of all items: how many have words, the shingles that several hold, the items' lengths."""

    count: int
    shared: np.ndarray
    frequency: np.ndarray
    lengths: np.ndarray


def item_words(text: str | None) -> np.ndarray:
    return Words(next(slices(pa.array([text], pa.string())))[1], NOT_ALNUM).hashes


def measure(benchmark: DataFrame) -> Benchmark:
    """Counts over the whole benchmark; the driver gets a row per shingle that several items hold and one per length."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([len(item_words(text)) for text in batch.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[found > 0])], names=["words"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = np.unique(shingle_hashes(item_words(text)))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])

    texts = benchmark.select("text")
    sizes = texts.mapInArrow(lengths, "words long").groupBy("words").count().toArrow()
    held = texts.mapInArrow(shingles, "shingle long").groupBy("shingle").count().where("count > 1").toArrow()
    shared, frequency = held["shingle"].to_numpy().view(np.uint64), held["count"].to_numpy()
    order = np.argsort(shared)
    return Benchmark(int(sizes["count"].to_numpy().sum()), shared[order], frequency[order], np.sort(sizes["words"].to_numpy()))


class Items:
    """Items of a benchmark as arrays: their shingles with weights, fingerprints, and the multi-index over them.

    ``whole`` is the ``Benchmark`` that the items are a part of; without it they are the whole of it.
    """

    def __init__(self, names: list, texts: list[str | None], whole: Benchmark | None = None):
        self.names, self.words, self.shingles = [], [], []
        for name, text in zip(names, texts):
            words = item_words(text)
            if len(words):
                self.names.append(name)
                self.words.append(len(words))
                self.shingles.append(shingle_hashes(words))
        self.count = len(self.names)
        if not self.count:
            return
        distinct = [np.unique(s) for s in self.shingles]
        own, frequency = np.unique(np.concatenate(distinct), return_counts=True)
        if whole is None:
            whole = Benchmark(self.count, own[frequency > 1], frequency[frequency > 1], np.unique(np.array(self.words)))
        # Shingles of other parts that a single item holds weigh as unknown ones do, so the shared ones are all there is to know.
        self.known = np.union1d(own, whole.shared)
        self.own = np.isin(self.known, own, assume_unique=True)
        frequency = np.ones(len(self.known), np.int64)
        frequency[np.searchsorted(self.known, whole.shared)] = whole.frequency
        # A shingle weighs the more the fewer items hold it; one that no item holds weighs as one that a single item holds.
        # Weights are multiples of 2^-24, so their sums are exact and no order of adding changes a similarity.
        self.weights = np.round(np.log1p(whole.count / frequency) * 2**24) / 2**24
        self.other = float(np.round(np.log1p(whole.count) * 2**24) / 2**24)
        self.sets = [(np.searchsorted(self.known, d), float(self.weights[np.searchsorted(self.known, d)].sum())) for d in distinct]
        # The weight of the lightest item of this part that holds a shingle.
        self.lightest = np.full(len(self.known), np.inf)
        for mine, total in self.sets:
            self.lightest[mine] = np.minimum(self.lightest[mine], total)
        # Bit distances follow the squares of the factors of the signs, similarity the plain weights: hence the roots.
        # Sums of 32-bit roots are exact in 64 bits, so equal windows have equal fingerprints wherever they lie.
        self.roots = np.sqrt(self.weights).astype(np.float32)
        self.other_root = np.sqrt(self.other).astype(np.float32)
        prints = [fingerprints(self.roots[np.searchsorted(self.known, s)][None, :].astype(np.float64) @ signs(s)) for s in self.shingles]
        self.prints = np.concatenate(prints)
        # By block and value the items with that value: positions in a sorted array of 256 * block + value.
        keys = (np.arange(BLOCKS) * 256)[None, :] + self.prints
        order = np.argsort(keys.ravel(), kind="stable")
        self.holders = order // BLOCKS
        self.starts = np.searchsorted(keys.ravel()[order], np.arange(BLOCKS * 256 + 1))
        self.lengths = whole.lengths
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def positions(self, shingles: np.ndarray) -> np.ndarray:
        """The shingles' places in ``known``, -1 for those that weigh as one that no item holds."""
        place = np.full(len(shingles), -1, np.int64)
        maybe = np.flatnonzero(self.filter[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        hit = self.known[at] == shingles[maybe]
        place[maybe[hit]] = at[hit]
        return place

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row, item) whose fingerprints differ in at most RADIUS bits."""
        ours, theirs = prints.view(np.uint64), self.prints.view(np.uint64)
        pairs = []
        for block in range(BLOCKS):
            values = (prints[:, block, None] ^ NEAR[None, :]).astype(np.int64) + 256 * block
            first, last = self.starts[values].ravel(), self.starts[values + 1].ravel()
            sizes = last - first
            row = np.repeat(np.repeat(np.arange(len(prints)), len(NEAR)), sizes)
            item = self.holders[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            # Distances come before the blocks' pairs are brought together: few pairs are left to be told apart.
            distance = np.zeros(len(row), np.uint8)
            for k in range(ours.shape[1]):
                distance += np.bitwise_count(ours[row, k] ^ theirs[item, k])
            keep = distance <= RADIUS
            pairs.append(row[keep] * self.count + item[keep])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // self.count, pairs % self.count

    def similarity(self, places: np.ndarray, shingles: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles (with their places) and an item's."""
        mine, total = self.sets[item]
        inside = np.unique(places[places >= 0])
        outside = len(np.unique(shingles[places < 0]))
        common = float(self.weights[np.intersect1d(inside, mine, assume_unique=True)].sum())
        window = float(self.weights[inside].sum()) + self.other * outside
        return common / (window + total - common)

    def matches(self, words: np.ndarray, threshold: float) -> list[tuple]:
        """(item, first word, words, similarity) of the best window for each item in a document."""
        shingles = shingle_hashes(words)
        return self._best(shingles, self.positions(shingles), len(words), threshold) if len(shingles) else []

    def search(self, words: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[int, list[tuple]]]:
        """(text, its matches) for texts of a slice, of which text i has the words at[i]..at[i+1].

        Shingles are looked up for all texts at once; those that reach into the next text belong to none.
        """
        shingles = shingle_hashes(words)
        places = self.positions(shingles)
        held = np.append(0, np.cumsum((places >= 0) & self.own[places]))
        first, last = at[:-1], at[1:]
        ends = np.minimum(np.maximum(last - 4, first), len(shingles))
        hits = held[ends] - held[np.minimum(first, len(shingles))]
        short = (last > first) & (last - first < 5)
        for i in np.flatnonzero((hits > 0) | short).tolist():
            a, b = int(first[i]), int(last[i])
            if short[i]:
                yield i, self.matches(words[a:b], threshold)
            else:
                yield i, self._best(shingles[a : b - 4], places[a : b - 4], b - a, threshold)

    def _best(self, shingles: np.ndarray, places: np.ndarray, total: int, threshold: float) -> list[tuple]:
        hits = np.flatnonzero((places >= 0) & self.own[places])
        if not len(hits):
            return []
        best: dict[int, tuple] = {}
        # Regions whose windows can hold a hit; the sums of signs are taken over each region.
        reach = int(self.lengths[-1])
        cuts = np.flatnonzero(np.diff(hits) > 2 * reach) + 1
        for group in np.split(hits, cuts):
            low, high = max(0, int(group[0]) - reach), min(len(shingles), int(group[-1]) + reach + 1)
            for at in range(low, high, 4096):  # bounded parts, overlapping by the longest window
                self._region(at, min(high, at + 4096 + reach), places, shingles, total, threshold, best)
        return [(self.names[i], *found) for i, found in best.items()]

    def _region(self, low, high, places, shingles, total, threshold, best) -> None:
        local, mine = places[low:high], shingles[low:high]
        weight = np.where(local >= 0, self.weights[local], self.other)
        ours = (local >= 0) & self.own[local]
        repeat = repeats(mine)
        # A window can only reach the threshold if the shingles that items of this part hold make up that share of its weight,
        # and only with items whose weight it makes up that share of. Where a shingle repeats in a window, sums are no
        # bound of its set's weight: then one such shingle is enough.
        held = np.append(0, np.cumsum(np.where(ours, weight, 0)))
        weights = np.append(0, np.cumsum(weight))
        least = threshold - 1e-4
        lightest = np.where(ours, self.lightest[local] * least, np.inf)
        windows = []
        for length in self.lengths.tolist():
            # A document shorter than the item is one window; a window of fewer than five words is one shingle.
            length = min(length, total)
            span = max(1, length - 4)
            if span > high - low or (total < 5) != (length < 5):
                continue
            inside, whole = held[span:] - held[:-span], weights[span:] - weights[:-span]
            share = np.where(repeat[: len(whole)] < np.arange(span, len(weights)), 0, least * whole)
            if not ((inside > 1e-9) & (inside >= share)).any():
                continue
            fit = np.append(0, np.cumsum(np.where(lightest <= whole.max(), weight, 0)))
            inside = fit[span:] - fit[:-span]
            starts = np.flatnonzero((inside > 1e-9) & (inside >= share))
            if len(starts):
                windows.append(np.stack((starts, np.full(len(starts), span), np.full(len(starts), length)), axis=1))
        if not windows:
            return
        starts, spans, lengths = np.concatenate(windows).T
        # Sums of signs over the places that these windows cover, side by side.
        covered = np.zeros(high - low + 1, np.int64)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + spans, -1)
        covered = np.flatnonzero(np.cumsum(covered) > 0)
        place = np.searchsorted(covered, np.arange(high - low + 1))
        root = np.where(local[covered] >= 0, self.roots[local[covered]], self.other_root)
        sums = np.zeros((len(covered) + 1, BITS), np.float64)
        np.cumsum(signs(mine[covered]) * root[:, None], axis=0, out=sums[1:])
        rows = min(4096, max(1, PAIRS // self.count))
        for at in range(0, len(starts), rows):
            a, b = starts[at : at + rows], starts[at : at + rows] + spans[at : at + rows]
            row, item = self.near(fingerprints(sums[place[b]] - sums[place[a]]))
            value = self._similarities(local, mine, weight, weights, repeat, a[row], b[row], item)
            keep = np.flatnonzero(value >= threshold)
            row, item, value = row[keep], item[keep], value[keep]
            begin, length = low + a[row], lengths[at + row]
            # Of equally similar windows the shortest, then the first one, in whichever region it lies.
            order = np.lexsort((begin, length, -value, item))
            for k in order[np.diff(item[order], prepend=-1) > 0].tolist():
                i, new = int(item[k]), (int(begin[k]), int(length[k]), float(value[k]))
                if i not in best or (-new[2], new[1], new[0]) < (-best[i][2], best[i][1], best[i][0]):
                    best[i] = new

    def _similarities(self, local, mine, weight, weights, repeat, begin, end, item) -> np.ndarray:
        """``similarity`` of windows of a region and items; by sums along the region where no shingle of a window repeats."""
        value = np.zeros(len(item))
        order = np.argsort(item, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else ():
            own, total = self.sets[item[group[0]]]
            a, b = begin[group], end[group]
            low, high = int(a.min()), int(b.max())
            common = np.append(0, np.cumsum(np.where(np.isin(local[low:high], own), weight[low:high], 0)))
            common = common[b - low] - common[a - low]
            value[group] = common / (weights[b] - weights[a] + total - common)
            for k in group[repeat[a] < b].tolist():
                value[k] = self.similarity(local[begin[k] : end[k]], mine[begin[k] : end[k]], int(item[k]))
        return value


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best window of a document for each item it holds.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters; shingles have five words, a shorter
    text is one shingle (an item of under five words is found only as a whole such text). Similarity is the weighted Jaccard similarity of the shingle sets. Null or
    wordless texts and items match nothing; repeated rows each report; other columns are ignored. The benchmark is
    sent to the tasks in passes of about ``pass_bytes`` of text; documents are never shuffled. Weights and window
    lengths are those of the whole benchmark, so passes do not change results; each task holds 16 bytes for every
    shingle that several items hold.
    """
    spark = docs.sparkSession
    prepare(spark)
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // pass_bytes) or 1
    whole = measure(benchmark)
    shared = spark.sparkContext.broadcast(tuple(whole))
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"
    out = None
    for k in range(passes):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else benchmark
        rows = part.collect()  # at most about pass_bytes
        sent = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value, Benchmark(*shared.value))
            for batch in batches:
                found: list[tuple] = []
                names = batch.column("doc_id").to_pylist()
                for first, texts in slices(batch.column("text")) if items.count else ():
                    words = Words(texts, NOT_ALNUM)
                    for i, matches in items.search(words.hashes, words.at, threshold):
                        found += [(names[first + i], *m) for m in matches]
                types = [pa.int64()] * 4 + [pa.float64()]
                columns = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=["doc_id", "item_id", "first_word", "n_words", "similarity"],
                )

        found = docs.mapInArrow(search, schema)
        out = found if out is None else out.unionAll(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` in whose texts no benchmark item is found, with all their columns.

    Rows are judged one by one, whatever their doc_id, which may be null or repeated.
    """
    stored, row = numbered(docs, "documents")
    texts = stored.select(F.col(row).alias("doc_id"), "text")
    found = contamination(texts, benchmark, threshold).select(F.col("doc_id").alias(row)).distinct()
    return stored.join(materialise(found, "contaminated"), row, "left_anti").select(*quoted(docs.columns))
