"""Operators against brute force on small random tables, for several ways of slicing the order."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import (
    WidthSlices,
    ancestor_chains,
    asof_join,
    closure,
    log_histogram,
    ordered_scan,
    overlap_join,
    quantile_slices,
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_repr(items):
    return sorted(items, key=repr)


def test_quantile_slices_find_hot_value(spark):
    data = [(7,)] * 60 + [(i,) for i in range(60)] + [(None,)]
    df = spark.createDataFrame(data, "k long")
    slices = quantile_slices(df, "k", rows_per_slice=10)
    assert 7 in slices.hot
    numbered = slices.assign(df.filter("k is not null"), "k", "s", slices.scatter(F.rand(1))).collect()
    ordered = sorted(numbered, key=lambda r: r.s)
    assert [r.k for r in ordered] == sorted(r.k for r in numbered)
    assert len({r.s for r in numbered if r.k == 7}) > 3


def test_slices_keep_order_of_large_values(spark):
    base = 2**62
    df = spark.range(200).select((F.col("id") * 3 + base).alias("k"))
    slices = quantile_slices(df, "k", rows_per_slice=20)
    got = sorted((r.k, r.s) for r in slices.assign(df, "k", "s").collect())
    assert [s for _, s in got] == sorted(s for _, s in got)
    negative = spark.createDataFrame([(-1,), (-10,), (0,), (9,), (10,)], "k long")
    got = {r.k: r.s for r in WidthSlices(10).assign(negative, "k", "s").collect()}
    assert got == {-1: -1, -10: -1, 0: 0, 9: 0, 10: 1}


@pytest.mark.parametrize("width", [3, 17, 10_000])
def test_ordered_scan_unique_order(spark, width):
    rng = random.Random(width)
    ids = rng.sample(range(400), 120)
    data = [(i, rng.choice(["a", "b", None]), rng.randrange(9)) for i in ids]
    df = spark.createDataFrame(data, "id long, g string, v long")
    got = rows(
        ordered_scan(
            df,
            "id",
            keys=["g"],
            sums={"total": "v"},
            lags={"prev": "id"},
            leads={"next": "id"},
            row_number="n",
            slices=WidthSlices(width),
        ).select("id", "g", "v", "total", "n", "prev", "next")
    )
    expected = []
    for g in ["a", "b", None]:
        part = sorted(r for r in data if r[1] == g)
        total = 0
        for n, (i, _, v) in enumerate(part):
            total += v
            prev = part[n - 1][0] if n else None
            following = part[n + 1][0] if n + 1 < len(part) else None
            expected.append((i, g, v, total, n + 1, prev, following))
    assert got == by_repr(expected)


def test_ordered_scan_with_hot_ties(spark):
    rng = random.Random(5)
    data = [(50 if rng.random() < 0.5 else rng.randrange(100), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(data, "t long, id long, v long")
    slices = quantile_slices(df, "t", rows_per_slice=20)
    assert slices.hot
    got = rows(
        ordered_scan(df, "t", tie="id", sums={"total": "v"}, lags={"prev": "id"}, slices=slices).select(
            "t", "id", "total", "prev"
        )
    )
    expected, total, prev = [], 0, None
    for t, i, v in sorted(data):
        total += v
        expected.append((t, i, total, prev))
        prev = i
    assert got == by_repr(expected)


def nearest(left, right, forward, allow_equal):
    key, group = left
    if key is None:
        return None
    fits = []
    for k, i, g in right:
        if g == group and k is not None:
            if (k == key and allow_equal) or (k > key if forward else k < key):
                fits.append((k if forward else -k, i))
    return min(fits)[1] if fits else None


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("allow_equal", [True, False])
@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("mode", ["single", "quantile", "hot", "width"])
def test_asof_join(spark, direction, allow_equal, how, mode):
    rng = random.Random(f"{direction}{allow_equal}{how}{mode}")

    def key():
        if rng.random() < 0.05:
            return None
        if mode == "hot" and rng.random() < 0.5:
            return 40
        return rng.randrange(-50, 150)

    left = [(n, key(), rng.choice([1, 2, None])) for n in range(150)]
    right = [(key(), i, rng.choice([1, 2, 3, None])) for i in range(80)]
    ldf = spark.createDataFrame(left, "n long, lk long, g int")
    rdf = spark.createDataFrame(right, "rk long, rid long, g int")
    slices = WidthSlices(7) if mode == "width" else None
    got = rows(
        asof_join(
            ldf,
            rdf,
            left_on="lk",
            right_on="rk",
            right_id="rid",
            columns={"hit": "rid"},
            keys=["g"],
            direction=direction,
            allow_equal=allow_equal,
            how=how,
            slices=slices,
            rows_per_slice=10_000 if mode == "single" else 15,
        ).select("n", "hit")
    )
    expected = [(n, nearest((k, g), right, direction == "forward", allow_equal)) for n, k, g in left]
    if how == "inner":
        expected = [e for e in expected if e[1] is not None]
    assert got == by_repr(expected)


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_join(spark, seed):
    rng = random.Random(seed)

    def intervals(count):
        out = []
        for i in range(count):
            start = 100 if rng.random() < 0.3 else rng.randrange(-300, 300)
            length = rng.choice([0, 1, 2, 5, 40, 5000])
            out.append((i, start, start + length, rng.choice([1, 2, None])))
        return out

    a, b = intervals(90), intervals(70)
    adf = spark.createDataFrame(a, "ia long, sa long, ea long, g int")
    bdf = spark.createDataFrame(b, "ib long, sb long, eb long, g int")
    got = rows(
        overlap_join(adf, bdf, a_interval=("sa", "ea"), b_interval=("sb", "eb"), keys=["g"]).select(
            "ia", "ib", "overlap_start", "overlap_end"
        )
    )
    expected = [
        (i, j, max(s, t), min(e, f))
        for i, s, e, g in a
        for j, t, f, h in b
        if g == h and s < f and t < e
    ]
    assert got == by_repr(expected)
    with pytest.raises(ValueError):
        overlap_join(adf, adf, a_interval=("sa", "ea"), b_interval=("sa", "ea"), keys=["g"])


def test_touching_intervals_do_not_overlap(spark):
    a = spark.createDataFrame([(0, 10)], "sa long, ea long")
    b = spark.createDataFrame([(10, 20), (9, 10)], "sb long, eb long")
    got = rows(overlap_join(a, b, a_interval=("sa", "ea"), b_interval=("sb", "eb")).select("sb", "eb"))
    assert got == [(9, 10)]


def test_ancestor_chains(spark):
    rng = random.Random(3)
    parents = {0: 0}
    for i in range(1, 60):
        parents[i] = i - 1 if i < 30 else rng.choice([0, rng.randrange(i), 1000])
    df = spark.createDataFrame(list(parents.items()), "id long, parent_id long").withColumn(
        "name", F.concat(F.lit("n"), F.col("id"))
    )
    expected = []
    for i in parents:
        node, depth = i, 0
        while node in parents:
            expected.append((i, node, parents[node], depth, f"n{node}"))
            if node == 0:
                break
            node, depth = parents[node], depth + 1
    chains = ancestor_chains(df, columns=["name"])
    assert rows(closure(chains, ["name"])) == by_repr(expected)
    short = ancestor_chains(df, columns=["name"], max_depth=3)
    assert rows(closure(short, ["name"])) == by_repr(e for e in expected if e[3] <= 3)


@pytest.mark.parametrize("pointers", [[(1, 2), (2, 1)], [(5, 5)], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 3)]])
def test_ancestor_chains_refuse_cycles(spark, pointers):
    df = spark.createDataFrame([(0, 0), (9, 0), *pointers], "id long, parent_id long")
    with pytest.raises(ValueError):
        ancestor_chains(df)


def test_ancestor_chains_by_key(spark):
    # Two trials and one without a name have equal ids; each has its own root and frames.
    found = [(0, 0), (1, 0), (2, 1), (3, 2)]
    data = [(t, i, p, f"{t}{i}") for t in ("x", "y", None) for i, p in found]
    df = spark.createDataFrame(data, "trial string, id long, parent_id long, name string")
    chains = ancestor_chains(df, columns=["name"], keys=["trial"])
    got = rows(closure(chains, ["name"], keys=["trial"]).select("trial", "group_id", "id", "depth", "name"))
    assert got == by_repr(
        (t, i, i - d, d, f"{t}{i - d}") for t in ("x", "y", None) for i in range(4) for d in range(i + 1)
    )
    short = ancestor_chains(df, columns=["name"], keys=["trial"], max_depth=1)
    assert rows(closure(short, keys=["trial"]).groupBy("trial").count()) == by_repr([("x", 7), ("y", 7), (None, 7)])


def test_log_histogram(spark):
    df = spark.createDataFrame([(1,), (9,), (11,), (99,), (1000,)], "v long")
    got = log_histogram(df, "v", edges=4, measures={"n": F.count(F.lit(1))}).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in got] == [(0, 2), (1, 2), (2, 1)]
    assert [round(r.upper_edge) for r in got] == [10, 100, 1000]
    same = spark.createDataFrame([(5,), (5,)], "v long")
    assert [r.n for r in log_histogram(same, "v", edges=4, measures={"n": F.count(F.lit(1))}).collect()] == [2]


def test_log_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(1,), (1000,)], "v long")
    measures = {"n": F.count(F.lit(1)), "total": F.sum("v")}
    got = log_histogram(df, "v", edges=4, measures=measures).orderBy("bin").collect()
    assert [(r.bin, r.n, r.total) for r in got] == [(0, 1, 1), (1, 0, 0), (2, 1, 1000)]
    assert log_histogram(df.limit(0), "v", edges=4, measures=measures).collect() == []
