"""Product codes of integer vectors: exact k-means of each part over Hilbert-sorted flat blocks.

Rows are gathered in chunks. For each part of the vectors a chunk is sorted along a Hilbert curve and cut into flat
blocks, each with the box (smallest and greatest components) and the component sums of its rows. In a round, the distances
between a block's box and the codebook's entries leave a shortlist: an entry goes if even the nearest corner of the box is
farther from it than all of the box is from another. A block with one entry left adds its stored sums and no row is read;
the rows of the others meet their shortlist only, in integers. So results are those of the plain method, bit by bit.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import prepare
from traceloom.session import materialise, shared_folder

CHUNK = 16384  # rows that a task sorts and stores together
BLOCK = 64
_FIELDS = ("places", "components", "low", "high", "sums")
_PART = "struct<" + ", ".join(f"{name}: binary" for name in _FIELDS) + ">"


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """Positions of the rows of ``points`` along a Hilbert curve through their bounding box.

    Coordinates keep the leading bits that fit 62 in total; of more than 62 dimensions the first 62 steer the order, which
    is a matter of tight boxes only.
    """
    n, dims = points.shape
    if n == 0 or dims == 0:
        return np.arange(n)
    dims = min(dims, 62)
    bits = 62 // dims
    bits = min(bits, 20)
    low = points[:, :dims].min(axis=0)
    span = points[:, :dims].max(axis=0) - low + 1
    axes = [((points[:, k] - low[k]) * (1 << bits) // span[k]).astype(np.int64) for k in range(dims)]
    # Turn each level's cell to the curve's own directions, coarse to fine, then Gray-decode across the axes.
    for level in range(bits - 1, 0, -1):
        rest = (1 << level) - 1
        for k in range(dims):
            turned = (axes[k] >> level) & 1 == 1
            swap = np.where(turned, 0, (axes[0] ^ axes[k]) & rest)
            axes[0] = np.where(turned, axes[0] ^ rest, axes[0] ^ swap)
            if k:
                axes[k] = axes[k] ^ swap
    for k in range(1, dims):
        axes[k] = axes[k] ^ axes[k - 1]
    flip = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(dims):
            key = (key << 1) | ((axes[k] ^ flip) >> level & 1)
    return np.argsort(key, kind="stable")


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries (columns) can be nearest, or as near as the nearest, to some point in each box (rows)."""
    below, above = low[:, None, :] - book[None], book[None] - high[:, None, :]
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
    farthest = (np.maximum(-below, -above) ** 2).sum(axis=2)
    return nearest <= farthest.min(axis=1, keepdims=True)


def nearest_entries(rows: np.ndarray, allowed: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry (of equals the first) among its ``allowed`` ones."""
    best = np.full(len(rows), -1, np.int64)
    distance = np.full(len(rows), np.iinfo(np.int64).max, np.int64)
    for k in range(len(book)):
        at = np.flatnonzero(allowed[:, k])
        found = ((rows[at] - book[k]) ** 2).sum(axis=1)
        nearer = found < distance[at]
        best[at[nearer]] = k
        distance[at[nearer]] = found[nearer]
    return best, distance


class Part:
    """One part of a chunk: its rows in Hilbert order, in blocks with boxes and sums."""

    def __init__(self, stored: dict, dims: int):
        self.places = np.frombuffer(stored["places"], "<i4")
        n, blocks = len(self.places), -(-len(self.places) // BLOCK)
        self.components = np.frombuffer(stored["components"], "<i4").reshape(n, dims)
        self.low, self.high, self.sums = (
            np.frombuffer(stored[name], "<i8").reshape(blocks, dims) for name in ("low", "high", "sums")
        )
        self.block = np.arange(n) // BLOCK

    @staticmethod
    def store(rows: np.ndarray) -> dict:
        order = hilbert_order(rows)
        rows = rows[order]
        starts = np.arange(0, len(rows), BLOCK)
        fields = {"places": order.astype("<i4"), "components": rows.astype("<i4")}
        for name, ufunc in (("low", np.minimum), ("high", np.maximum), ("sums", np.add)):
            fields[name] = ufunc.reduceat(rows, starts, axis=0).astype("<i8")
        return {name: x.tobytes() for name, x in fields.items()}

    def totals(self, book: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add the number and the component sums of the rows nearest to each entry."""
        short = shortlists(self.low, self.high, book)
        whole = short.sum(axis=1) == 1
        sizes = np.bincount(self.block, minlength=len(whole))
        entry = short.argmax(axis=1)
        np.add.at(counts, entry[whole], sizes[whole])
        np.add.at(sums, entry[whole], self.sums[whole])
        mixed = ~whole[self.block]
        rows = self.components[mixed].astype(np.int64)
        best, _ = nearest_entries(rows, short[self.block[mixed]], book)
        np.add.at(counts, best, 1)
        np.add.at(sums, best, rows)

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, in the order the chunk's rows came in."""
        short = shortlists(self.low, self.high, book)
        best, distance = nearest_entries(self.components.astype(np.int64), short[self.block], book)
        index, error = np.empty_like(best), np.empty_like(distance)
        index[self.places], error[self.places] = best, distance
        return index, error


def _store(df: DataFrame, label: str) -> DataFrame:
    """As :func:`materialise`, with row groups that suit rows of some megabytes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/traceloom/{label}-{uuid.uuid4().hex}"
    sizes = {"parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 2, "parquet.page.size.row.check.max": 8}
    df.write.options(**{k: str(v) for k, v in sizes.items()}).mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compress_vectors(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, error) of each kept row of ``vectors`` (vec_id, embedding, label), and the codebooks.

    Component x counts as floor(scale * x). Vectors are cut into ``parts`` consecutive parts, as equal as can be; the
    codebook of a part starts with the parts of the ``entries`` rows with the smallest vec_id (nulls last, of equal ones the
    smallest vector first), fewer if there are fewer rows. Each round assigns every part to its nearest entry and moves entries to
    the floor of their parts' mean; unused ones stay. ``codes`` holds the final entry of each part, ``error`` the sum of
    their squared distances.

    Dropped: null vectors and those with null or non-finite components. A shorter vector counts as filled up with zeros to the length of
    the longest. Components saturate where sums of squares would leave 63 bits (beyond 2^28 at 64 components). Rows with a null
    or repeated vec_id are rows like others. Other columns are ignored; no rows give none. The driver holds the codebooks
    and their sums only; all else stays in tables.
    """
    spark = vectors.sparkSession
    prepare(spark)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label"
    ).where(finite)
    width = rows.agg(F.max(F.size("v"))).first()[0]
    limit = 1 << ((60 - math.ceil(math.log2(max(width or 1, 1)))) // 2)
    near = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(limit))), F.lit(-float(limit)))))
    rows = rows.select("vec_id", near.alias("v"), "label")
    cuts = [(width or 0) * k // parts for k in range(parts + 1)]
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    first = filled([r["v"] for r in seeds], width or 0)
    books = [first[:, a:b] for a, b in zip(cuts, cuts[1:])]
    label = next(f.dataType for f in rows.schema if f.name == "label")

    parts_type = pa.list_(pa.struct([(name, pa.binary()) for name in _FIELDS]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            whole = filled(table["v"].combine_chunks(), width)
            stored = [Part.store(whole[:, a:b]) for a, b in zip(cuts, cuts[1:])]
            one = [0, table.num_rows]
            lists = [pa.LargeListArray.from_arrays(one, table[c].combine_chunks()) for c in ("vec_id", "label")]
            columns = [x.cast(pa.list_(x.type.value_type)) for x in lists] + [pa.array([stored], parts_type)]
            return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "parts"])

        for batch in batches:
            while batch.num_rows:
                room = CHUNK - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == CHUNK:
                    yield chunk()
                    held = []
        if held:
            yield chunk()

    schema = f"vec_id array<bigint>, label array<{label.simpleString()}>, parts array<{_PART}>"
    chunks = _store(rows.mapInArrow(gather, schema), "vector-blocks")

    def read(batch: pa.RecordBatch, i: int) -> Iterator[Part]:
        for k, stored in enumerate(batch.column("parts")[i].as_py()):
            yield Part(stored, cuts[k + 1] - cuts[k])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                for k, part in enumerate(read(batch, i)):
                    part.totals(books[k], counts[k], sums[k])
        used = [(k, e) for k in range(parts) for e in np.flatnonzero(counts[k]).tolist()]
        out = {"part": [k for k, _ in used], "entry": [e for _, e in used], "n": [int(counts[k][e]) for k, e in used]}
        totals = pa.array([sums[k][e].tolist() for k, e in used], pa.list_(pa.int64()))
        arrays = [pa.array(x, t) for x, t in zip(out.values(), (pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*arrays, totals], names=[*out, "totals"])

    for _ in range(rounds):
        partial = chunks.select("parts").mapInArrow(assign, "part int, entry int, n long, totals array<bigint>")
        # The count travels as the component after the last, so all are added in one go.
        cells = partial.select("part", "entry", F.posexplode(F.concat("totals", F.array("n"))).alias("place", "value"))
        added = cells.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
        totals: dict[tuple[int, int], dict[int, int]] = {}
        for row in added.collect():  # a number per entry and component
            totals.setdefault((row["part"], row["entry"]), {})[row["place"]] = int(row["total"])
        moved = [b.copy() for b in books]
        for (k, entry), found in totals.items():
            dims = books[k].shape[1]
            moved[k][entry] = [found[d] // found[dims] for d in range(dims)]
        books = moved

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [part.codes(books[k]) for k, part in enumerate(read(batch, i))]
                codes = np.stack([f[0] for f in found], axis=1).astype(np.int32)
                ends = np.arange(0, codes.size + 1, parts, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id")[i].values,
                        batch.column("label")[i].values,
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel())),
                        pa.array(sum(f[1] for f in found)),
                    ],
                    names=["vec_id", "label", "codes", "error"],
                )

    schema = f"vec_id long, label {label.simpleString()}, codes array<int>, error long"
    return materialise(chunks.mapInArrow(encode, schema), "vector-codes"), books


def filled(vectors: pa.Array | list, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, with zeros after the end of shorter ones."""
    if isinstance(vectors, pa.ListArray) and len(vectors) * width == len(vectors.flatten()):
        lengths = np.diff(vectors.offsets.to_numpy())
        if (lengths == width).all():
            return vectors.flatten().to_numpy().reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors.to_pylist() if isinstance(vectors, pa.Array) else vectors):
        out[i, : len(v)] = v
    return out


def code_digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code in hex digits, error, label_error, codebooks_sha256 of each kept row."""
    coded, books = compress_vectors(vectors)
    numbers = ",".join(str(x) for book in books for x in book.ravel().tolist())
    by_label = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id",
        F.concat_ws("", digits).alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same as SQL: all distances of all rounds, without blocks, boxes or sums of blocks."""
    steps = [
        f"""kept as materialized (
            select vec_id, label, len(embedding) // {parts} as w, list_transform(embedding, lambda x: floor(x * 4096)::bigint) as v
            from embeddings where embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""cells as materialized (
            select vec_id, label, part, list_slice(v, part * w + 1, part * w + w) as v
            from kept, range({parts}) r(part))""",
        f"""book_0 as materialized (
            select part, rank - 1 as entry, v from (
                select part, v, row_number() over (partition by part order by vec_id) as rank from cells) where rank <= {entries})""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near_{k} as materialized (
            select vec_id, any_value(label) as label, part, arg_min(entry, d * {entries} + entry) as entry, min(d) as d from (
                select c.vec_id, c.label, c.part, b.entry,
                    list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
                from cells c join book_{k} b using (part)) group by vec_id, part)"""
        )
        if k < rounds:
            steps.append(
                f"""mean_{k} as (
                select part, entry, list(f order by place) as v from (
                    select part, entry, place, (s - ((s % n) + n) % n) // n as f from (
                        select part, entry, place, sum(x)::bigint as s, count(*) as n from (
                            select part, entry, unnest(v) as x, generate_subscripts(v, 1) as place
                            from cells join near_{k} using (vec_id, part)) group by part, entry, place))
                group by part, entry)"""
            )
            steps.append(
                f"""book_{k + 1} as materialized (
                select b.part, b.entry, coalesce(m.v, b.v) as v from book_{k} b left join mean_{k} m using (part, entry))"""
            )
    last = rounds
    return f"""with {", ".join(steps)},
        coded as (select vec_id, any_value(label) as label, sum(d)::bigint as error,
            string_agg(printf('%02x', entry), '' order by part) as code from near_{last} group by vec_id),
        digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from book_{last})
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
        from coded, digest"""
