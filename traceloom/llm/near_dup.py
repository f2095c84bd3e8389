"""Near duplicates by bottom-k sketches of one hash function (operator 9).

A document's sketch is the ``K`` smallest hashes of its five-word shingles. Inverted lists hold, for each of ``CLASSES``
residue classes of the hashes, the documents with the same three lowest retained values; two documents of Jaccard
similarity s share a given list with probability s^3, so at 0.85 a pair escapes all 16 lists with (1-0.85^3)^16 < 3e-7.
Within the lists the sketch of the union estimates the similarity; documents that pass, with four
standard deviations of room, form groups, and within groups all pairs are compared on their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import (
    BASE,
    Words,
    block_pairs,
    connected_components,
    filter_bits,
    id_filter,
    in_blocks,
    local_components,
    mix,
    numbered,
    prepare,
    quoted,
    run_starts,
    runs,
    shingle_hashes,
    slices,
)
from traceloom.session import materialise

K = 128
CLASSES = 16
PER_LIST = 3
#: Hashes of the sketch that estimate similarity, and the estimate's room below the threshold in deviations.
ESTIMATE_K = 64
DEVIATIONS = 4.0
#: What a worker handles at a time: bytes of an Arrow batch and of texts, and pairs whose similarity is estimated.
BATCH_BYTES = 2 << 20
TEXT_BYTES = 256 << 10
PAIRS = 1 << 13


def document_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for a text without words."""
    for _, part in slices(texts, TEXT_BYTES):
        words = Words(part)
        at = words.at.tolist()
        for a, b in zip(at[:-1], at[1:]):
            yield np.unique(shingle_hashes(words.hashes[a:b], size))


def list_keys(sketch: np.ndarray, complete: bool) -> np.ndarray:
    """One key for each residue class with enough retained values: a hash of its lowest three.

    A sketch that is the whole set makes keys of fewer values too, and none of an empty class.
    """
    classes = (sketch & np.uint64(CLASSES - 1)).astype(np.int64)
    order = np.argsort(classes, kind="stable")  # the sketch is sorted, so values stay sorted in each class
    counts = np.bincount(classes, minlength=CLASSES)
    starts = np.cumsum(counts) - counts
    value = np.arange(1, CLASSES + 1, dtype=np.uint64)
    for k in range(PER_LIST):
        there = counts > k
        picked = np.zeros(CLASSES, np.uint64)
        picked[there] = sketch[order[starts[there] + k]]
        value = np.where(there, value * np.uint64(BASE) + picked, value)
    value = mix(value)
    return value[counts >= (1 if complete else PER_LIST)]


def sketches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, f1, f2, sketch, keys): the set's size, its two fingerprints, its sketch and its list keys.

    The fingerprints of an empty set are of the doc_id and the text, as only rows equal in both are repeats there.
    """
    schema = "row long, doc_id long, n long, f1 long, f2 long, sketch binary, keys array<long>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, found in enumerate(document_sets(batch.column("text"))):
                sketch = found[:K]
                keys = list_keys(sketch, len(found) <= K).view(np.int64) if len(found) else np.zeros(0, np.int64)
                if len(found):
                    prints = np.array([found.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(found + np.uint64(1)))], np.uint64)
                else:
                    own = repr((batch.column("doc_id")[i].as_py(), batch.column("text")[i].as_py())).encode()
                    prints = np.frombuffer(hashlib.blake2b(own, digest_size=16).digest(), np.uint64)
                values = (
                    len(found),
                    *prints.view(np.int64).tolist(),
                    (sketch[:ESTIMATE_K] >> np.uint64(32)).astype("<u4").tobytes(),
                    keys,
                )
                for row, value in zip(rows, values):
                    row.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *(pa.array(r, t) for r, t in zip(rows, types))],
                names=["row", "doc_id", "n", "f1", "f2", "sketch", "keys"],
            )

    return docs.select("row", "doc_id", "text").mapInArrow(build, schema)


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of pairs of sketches (rows of sorted 32-bit values, filled up with 2^32 in 64 bits)."""
    both = np.sort(np.concatenate((left, right), axis=1), axis=1)
    empty = both >= np.uint64(1 << 32)
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & ~empty[:, 1:]
    rank = np.cumsum(~same & ~empty, axis=1)  # of distinct values in the sketch of the union
    inside = (rank <= ESTIMATE_K) & ~empty
    return (same & inside).sum(axis=1) / np.maximum((~same & inside).sum(axis=1), 1)


def edge_batch(names: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
    """A row per connected name that leads to its component's first row: a spanning forest of the pairs."""
    label = local_components(len(names), left, right)
    moved = np.flatnonzero(label != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], names=["a", "b"])


def candidate_edges(representatives: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) of a forest that connects all pairs which share a list and pass the estimate."""
    room = DEVIATIONS * (threshold * (1 - threshold) / ESTIMATE_K) ** 0.5
    least = threshold - room
    listed = representatives.select("node", "n", F.explode("keys").alias("key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = materialise(listed.join(sizes, "key"), "lists")
    rows = in_blocks(rows, "node")
    attached = rows.join(representatives.select("node", "sketch", F.col("keys").alias("own")), "node")
    order = ["key", "bi", "bj"]
    attached = attached.repartition(*order).sortWithinPartitions(*order)

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, order):
            starts = run_starts(table, order)
            left, right = block_pairs(table, starts)
            n = table["n"].to_numpy()
            small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
            keep = small >= threshold * large
            left, right = left[keep], right[keep]
            names = table["node"].to_numpy()
            sketch = np.full((table.num_rows, ESTIMATE_K), 1 << 32, np.uint64)
            for i, x in enumerate(table["sketch"].to_pylist()):
                values = np.frombuffer(x, "<u4")
                sketch[i, : len(values)] = values
            own = np.full((table.num_rows, CLASSES), -1, np.int64)
            for i, x in enumerate(table["own"].to_pylist()):
                own[i, : len(x)] = np.sort(x)
            key = table["key"].to_numpy()
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for at in range(0, len(left), PAIRS):
                a, b = left[at : at + PAIRS], right[at : at + PAIRS]
                # A pair that shares several lists is estimated in the one of the smallest key only.
                both = np.sort(np.concatenate((own[a], own[b]), axis=1), axis=1)
                twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != -1)
                first = both[np.arange(len(a)), np.argmax(twice, axis=1)]
                mine = first == key[a]
                a, b = a[mine], b[mine]
                good = estimates(sketch[a], sketch[b]) >= least
                found.append((a[good], b[good]))
            if found:
                yield edge_batch(names, *(np.concatenate(x) for x in zip(*found)))

    return attached.select("node", "n", "key", "b", "bi", "bj", "sketch", "own").mapInArrow(connect, "a long, b long")


def set_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union; intersections by products of membership rows."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[codes] > 1
    owner, codes = owner[shared], codes[shared]
    codes = np.unique(codes, return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, (8 << 20) // (4 * len(sets)))  # columns at a time: 8 MB
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    top = int(codes[-1]) + 1 if len(codes) else 0
    for at in range(0, top, width):
        a, b = np.searchsorted(codes, [at, at + width])
        member = np.zeros((len(sets), min(width, top - at)), np.float32)
        member[owner[a:b], codes[a:b] - at] = 1
        common += member @ member.T
    both = common[left, right].astype(np.int64)
    return 100 * both >= percent * (sizes[left] + sizes[right] - both)


def exact_edges(docs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of a forest of all links within the candidate groups (node, component)."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    members = in_blocks(groups.join(sizes, "component"), "node")
    members = members.groupBy("node", "component", "b").agg(
        F.collect_list(F.struct("bi", "bj")).alias("places")
    )
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(groups.select("node")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8))
        for batch in batches:
            inside = bits[filter_bits(batch.column("node").to_numpy())] == 1
            batch = batch.filter(pa.array(inside))
            found = [s.tobytes() for s in document_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"])

    # Sets are made where the texts lie, for the filter's documents only: neither texts nor other sets are shuffled.
    texts = docs.select(F.col("row").alias("node"), "text")
    built = texts.mapInArrow(build, "node long, shingles binary").join(members.hint("merge"), "node")
    order = ["component", "bi", "bj"]
    spread = built.select("node", "component", "b", F.explode("places").alias("p"), "shingles").select(
        "node", "component", "b", "p.bi", "p.bj", "shingles"
    )
    spread = spread.repartition(*order).sortWithinPartitions(*order, "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, order, rows=256):
            bounds = [*run_starts(table, order).tolist(), table.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:]):
                part = table.slice(a, b - a)
                if part.num_rows < 2:
                    continue
                names = part["node"].to_numpy()
                left, right = block_pairs(part, np.zeros(1, np.int64))
                sets = [np.frombuffer(x, np.uint64) for x in part["shingles"].to_pylist()]
                good = set_links(sets, left, right, percent)
                if good.any():
                    yield edge_batch(names, left[good], right[good])

    return spread.mapInArrow(link, "a long, b long")


def judged(docs: DataFrame, percent: int) -> DataFrame:
    """row, doc_id, n, component_id, kept of each row of stored ``docs`` (row, doc_id, text); ``row`` is unique.

    Nodes are texts, never ids: the first row of each class of equal sets stands for it. The first row is the one of
    the smallest doc_id, nulls last, and of these of the smallest ``row``.
    """
    prepare(docs.sparkSession, BATCH_BYTES)
    found = materialise(sketches(docs), "sketches")
    content = ["n", "f1", "f2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    classes = found.groupBy(*content).agg(first).select(*content, F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id"))
    classes = materialise(classes, "classes")
    chosen = found.select(F.col("row").alias("node"), "n", "sketch", "keys").join(classes.where("n > 0").select("node"), "node")
    chosen = materialise(chosen, "chosen")
    candidates = connected_components(candidate_edges(chosen, percent / 100), "candidates")
    components = connected_components(exact_edges(docs, candidates, percent), "links")
    members = components.join(classes.select(F.col("node").alias("row"), "doc_id"), F.col("node") == F.col("row"))
    leaders = members.groupBy("component").agg(first).select("component", "first")
    linked = components.join(leaders, "component").select("node", "first")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("node").alias("row"))
    named = classes.join(linked, "node", "left").select(*content, F.coalesce("first", own).alias("first"))
    rows = found.select("row", "doc_id", *content).join(named, content)
    return rows.select(
        "row",
        "doc_id",
        "n",
        F.col("first.doc_id").alias("component_id"),
        ((F.col("row") == F.col("first.row")) | F.expr("n = 0 and doc_id is null")).alias("kept"),
    )


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text).

    Texts whose sets have 100 * intersection >= ``percent`` * union are linked, whatever their doc_ids;
    ``component_id`` is the smallest doc_id reachable, null if there is none. One row of a component is kept, one of the
    smallest doc_id, so a doc_id that stands for several texts has a verdict for each. A null, empty or blank text has an
    empty set and is linked with nothing but rows of the same doc_id and text; a text of under five words is one
    shingle. Equal sets are one class, compared once. Other columns are ignored.
    """
    docs, row = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "documents")
    rows = judged(docs.withColumnRenamed(row, "row"), percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_representatives(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group of near duplicates, with all their columns.

    Rows are judged one by one as in ``near_duplicates``. Of rows without words one stays for each doc_id and text;
    those that have no doc_id either all stay.
    """
    stored, row = numbered(docs, "documents")
    found = judged(stored.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), percent)
    removed = materialise(found.where("not kept").select(F.col("row").alias(row)), "removed")
    return stored.join(removed, row, "left_anti").select(*quoted(docs.columns))
