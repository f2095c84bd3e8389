"""Scans over many slices as a tree, and slices from a directory of tables: skewed groups, hot values, sparse ids."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import (
    SliceDirectory,
    WidthSlices,
    asof_join,
    ordered_scan,
    overlap_totals,
    quantile_slices,
    slice_directory,
)
from traceloom.operators.tree import carried_over


def by_repr(items):
    return sorted(items, key=repr)


@pytest.mark.parametrize("spread", [1, 1 << 8])
@pytest.mark.parametrize("nested", [False, True])
def test_tree_of_three_levels_and_more(spark, nested, spread):
    """FAN 8 over 180 slices, dense or sparse, negative numbers too, needs three levels and more."""
    rng = random.Random(3)
    slices = [(g, (s - 90) * spread + rng.randrange(spread)) for g in (1, None) for s in range(180) if rng.random() < 0.8]
    data = [(g, s, rng.randrange(9), rng.choice([None, rng.randrange(99)])) for g, s in slices]
    df = spark.createDataFrame(data, "g int, s long, v long, w long")
    number = F.struct(F.floor(F.col("s") / (7 * spread)).alias("p0"), F.pmod("s", F.lit(7 * spread)).alias("p1"))
    summary = df.select(
        F.struct("g").alias("_group"), (number if nested else F.col("s")).alias("_slice"), "s",
        F.col("v").alias("total"), F.col("w").alias("before"), F.col("w").alias("after"), F.col("w").alias("least"),
    )
    kinds = {"total": "sum", "before": "last", "after": "next", "least": "low"}
    found = carried_over(summary.drop("s"), kinds, fan=8).join(summary.select("_group", "_slice", "s"), ["_group", "_slice"])
    got = [(r["_group"].g, r.s, r["_c_total"], r["_c_before"], r["_c_after"], r["_c_least"]) for r in found.collect()]
    expected = []
    for g in (1, None):
        part = sorted(r for r in data if r[0] == g)
        known = [r[3] for r in part]
        for i, (_, s, _, _) in enumerate(part):
            before = [w for w in known[:i] if w is not None]
            after = [w for w in known[i + 1 :] if w is not None]
            expected.append(
                (g, s, sum(r[2] for r in part[:i]) if i else None, before[-1] if before else None,
                 after[0] if after else None, min(w for w in known if w is not None))
            )
    assert by_repr(got) == by_repr(expected)


def test_tree_without_rows(spark):
    empty = spark.createDataFrame([], "_group int, _slice long, total long")
    assert carried_over(empty, {"total": "sum"}).collect() == []


def skewed(rng, n=600):
    """One group holds most rows, one value most of those, and one value lies far off."""
    rows = []
    for i in range(n):
        g = "big" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        k = 50 if g == "big" and rng.random() < 0.5 else rng.randrange(-20, 200) * (1 if g == "big" else 1 << 30)
        rows.append((g, k, i, rng.choice([None, rng.randrange(9)])))
    rows.append(("big", 1 << 61, n, 1))
    rows.append(("big", -(1 << 61), n + 1, 1))
    rows.append(("big", None, n + 2, 5))
    return rows


def test_directory_bounds_every_slice_and_keeps_order(spark):
    data = skewed(random.Random(8))
    df = spark.createDataFrame(data, "g string, k long, id long, v long")
    directory = slice_directory(df, "k", keys=["g"], tie="id", rows_per_slice=10)
    assert len(directory.tables) > 1
    placed = directory.assign(df.withColumn("_group", F.struct("g")), "k", "s", F.col("id")).filter("k is not null").collect()
    sizes = {}
    for r in placed:
        sizes[(r.g, r.s)] = sizes.get((r.g, r.s), 0) + 1
    assert max(sizes.values()) <= 20
    for g in ("big", "a", "b", None):
        part = sorted((r for r in placed if r.g == g), key=lambda r: (r.k, r.id))
        assert [r.s for r in part] == sorted(r.s for r in part)


def test_ordered_scan_over_a_directory(spark):
    data = skewed(random.Random(9))
    df = spark.createDataFrame(data, "g string, k long, id long, v long")
    directory = slice_directory(df, "k", keys=["g"], tie="id", rows_per_slice=10)
    got = ordered_scan(
        df, "k", tie="id", keys=["g"], sums={"total": "v"}, lags={"prev": "v"}, leads={"next": "v"}, row_number="n",
        last_known={"known": "v"}, next_known={"ahead": "v"}, lows={"low": "v"}, slices=directory,
    ).select("g", "id", "total", "prev", "next", "n", "known", "ahead", "low")
    expected = []
    for g in ("big", "a", "b", None):
        part = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        values = [r[3] for r in part]
        for i, r in enumerate(part):
            seen = [v for v in values[: i + 1] if v is not None]
            ahead = [v for v in values[i:] if v is not None]
            expected.append(
                (g, r[2], sum(seen) if seen else None, values[i - 1] if i else None, values[i + 1] if i + 1 < len(part) else None,
                 i + 1, seen[-1] if seen else None, ahead[0] if ahead else None, min(v for v in values if v is not None))
            )
    assert by_repr(tuple(r) for r in got.collect()) == by_repr(expected)


@pytest.mark.parametrize("allow_equal", [True, False])
@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_asof_join_over_a_directory(spark, direction, allow_equal):
    rng = random.Random(4)
    left, right = skewed(rng, 300), skewed(rng, 200)
    ldf = spark.createDataFrame(left, "g string, lk long, n long, v long").drop("v")
    rdf = spark.createDataFrame(right, "g string, rk long, rid long, v long").drop("v")
    both = ldf.select("g", F.col("lk").alias("k")).unionAll(rdf.select("g", F.col("rk").alias("k")))
    directory = slice_directory(both, "k", keys=["g"], rows_per_slice=10)
    assert len(directory.tables) > 1
    got = asof_join(
        ldf, rdf, left_on="lk", right_on="rk", right_id="rid", columns={"rid": "rid"}, keys=["g"], direction=direction,
        allow_equal=allow_equal, slices=directory,
    )
    forward = direction == "forward"
    expected = []
    for g, k, n, _ in left:
        fits = [
            (rk if forward else -rk, rid) for rg, rk, rid, _ in right
            if rg == g and None not in (k, rk) and ((rk == k and allow_equal) or (rk > k if forward else rk < k))
        ]
        expected.append((n, min(fits)[1] if fits else None))
    assert by_repr((r.n, r.rid) for r in got.collect()) == by_repr(expected)


@pytest.mark.parametrize("tie", ["id", None])
def test_a_directory_orders_rows_it_was_not_made_for(spark, tie):
    made = [(500, i) for i in range(200)] + [(0, 900), (1000, 901)]
    directory = slice_directory(spark.createDataFrame(made, "k long, id long"), "k", tie=tie, rows_per_slice=10)
    rnd = random.Random(6)
    data = sorted((rnd.choice([500, rnd.randrange(-100, 1100)]), i * 3 - 400) for i in range(300))
    df = spark.createDataFrame(data, "k long, id long")
    got = ordered_scan(df, "k", tie="id", row_number="n", slices=directory if tie else None).select("k", "id", "n").collect()
    assert sorted((r.k, r.id, r.n) for r in got) == [(k, i, n + 1) for n, (k, i) in enumerate(data)]
    placed = directory.assign(df.withColumn("_group", F.lit(0)), "k", "s", F.col("id")).collect()
    order = sorted((r.k, r.s) for r in placed)
    assert all(a[1] <= b[1] for a, b in zip(order, order[1:]) if a[0] < b[0])


def test_sparse_ids_scan_in_bounded_tasks(spark):
    """Each id has a slice of its own: the summaries are as many as the rows, and the tree still scans them."""
    rng = random.Random(1)
    ids = sorted(rng.sample(range(-(1 << 50), 1 << 50), 2500))
    df = spark.createDataFrame([(i, n % 7) for n, i in enumerate(ids)], "id long, v long").repartition(4)
    got = ordered_scan(df, "id", sums={"total": "v"}, row_number="n", slices=WidthSlices(1000)).select("id", "total", "n")
    total, expected = 0, []
    for n, i in enumerate(ids):
        total += n % 7
        expected.append((i, total, n + 1))
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_more_slices_than_literals_become_a_directory(spark):
    df = spark.range(6000).select((F.col("id") * 5).alias("k"), F.col("id").alias("t"))
    assert isinstance(quantile_slices(df, "k", rows_per_slice=5, tie="t"), SliceDirectory)
    got = ordered_scan(df, "k", tie="t", sums={"n": "t"}, slices=quantile_slices(df, "k", rows_per_slice=5, tie="t"))
    assert got.filter(F.col("n") != F.col("t") * (F.col("t") + 1) / 2).count() == 0
    assert got.count() == 6000


@pytest.mark.parametrize("rows_per_slice", [8, 10_000])
def test_overlap_totals_equal_pairs(spark, rows_per_slice):
    rnd = random.Random(rows_per_slice)
    base = 1_700_000_000_000_000_000  # so that sums of points leave 64 bits

    def rows(n, wide):
        out = []
        for i in range(n):
            start = base + (50 if rnd.random() < 0.3 else rnd.randrange(100))
            length = rnd.choice([0, 1, rnd.randrange(wide), rnd.randrange(wide), -3, None])
            out.append((rnd.choice(["x", "x", "y", None]), i, start, None if length is None else start + length))
        return out

    a, b = rows(90, 40), rows(120, 80)
    schema = "k string, {0}id long, {0}s long, {0}e long"
    got = overlap_totals(
        spark.createDataFrame(a, schema.format("a")), spark.createDataFrame(b, schema.format("b")), a_id="aid",
        a_interval=("as", "ae"), b_interval=("bs", "be"), keys=["k"], rows_per_slice=rows_per_slice,
    )
    expected = []
    for k, i, s, e in a:
        if e is None or e < s:
            continue
        met = [(bs, be) for bk, _, bs, be in b if bk == k and be is not None and bs <= be and bs < e and s < be]
        expected.append((k, i, len(met), sum(min(e, be) - max(s, bs) for bs, be in met)))
    assert by_repr(tuple(r) for r in got.collect()) == by_repr(expected)
