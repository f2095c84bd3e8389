"""Work along parent pointers without chains, against chains and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import ancestor_chains, ancestor_pairs, chain_digests, closure, nearest_marked
from traceloom.plans import overlays, timeline
from traceloom.plans.ranges import View
from traceloom.session import materialise


def forest(seed, groups=("x", None), n=40):
    """Deep, bushy and single stacks under root 0; some parents are missing."""
    rnd = random.Random(seed)
    rows = []
    for g in groups:
        rows.append((g, 0, 0, "root"))
        for i in range(1, n + 1):
            parent = i - 1 if i < 20 else rnd.choice([0, rnd.randrange(i), 10_000 + i])
            rows.append((g, i, parent, rnd.choice(["a", "b", None])))
    return rows


NODES = "trial string, id long, parent_id long, name string"


def lists(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_pairs_equal_chains(spark):
    nodes = materialise(spark.createDataFrame(forest(1), NODES))
    columns = ["trial", "group_id", "id", "parent_id", "depth", "name"]
    chains = ancestor_chains(nodes, columns=["name"], keys=["trial"])
    want = lists(closure(chains, ["name"], keys=["trial"]), *columns)
    got = lists(ancestor_pairs(nodes, columns=["name"], keys=["trial"]), *columns)
    assert got == want and max(r[4] for r in got) > 15
    one = nodes.filter("trial = 'x'")
    assert ancestor_pairs(one.limit(0)).collect() == []


def test_circles_are_reported(spark):
    rows = [("x", 0, 0, "r"), ("x", 1, 2, "a"), ("x", 2, 3, "b"), ("x", 3, 1, "c"), ("x", 4, 0, "d")]
    nodes = spark.createDataFrame(rows, NODES)
    for walk in (
        lambda: ancestor_pairs(nodes).collect(),
        lambda: nearest_marked(nodes, F.lit(False)).collect(),
        lambda: chain_digests(nodes, F.col("name")).collect(),
    ):
        with pytest.raises(ValueError, match="cycle"):
            walk()


@pytest.mark.parametrize("root_marked", [False, True])
def test_nearest_marked(spark, root_marked):
    rows = forest(2)
    rnd = random.Random(3)
    marked = {(g, i) for g, i, _, _ in rows if rnd.random() < 0.15 and (i or root_marked)} | ({("x", 0)} if root_marked else set())
    data = [(g, i, p, (g, i) in marked) for g, i, p, _ in rows]
    nodes = materialise(spark.createDataFrame(data, "trial string, id long, parent_id long, m boolean"))
    got = {(r["_group"].trial, r.id): r["at"] for r in nearest_marked(nodes, F.col("m"), keys=["trial"]).collect()}
    up = {(g, i): p for g, i, p, _ in rows}
    expected = {}
    for g, i in up:
        at = i
        while (g, at) in up and (g, at) not in marked and at != 0:
            at = up[(g, at)]
        if (g, at) in marked:
            expected[(g, i)] = at
    assert got == expected


def test_digests_tell_paths_apart(spark):
    rows = forest(4)
    found = chain_digests(spark.createDataFrame(rows, NODES), F.col("name"), keys=["trial"]).collect()
    digest = {(r["_group"].trial, r.id): bytes(r.digest) for r in found}
    up = {(g, i): (p, name) for g, i, p, name in rows}

    def path(g, i):
        out = []
        while i and (g, i) in up:
            i, name = up[(g, i)]
            out.append(name)
        return tuple(out)

    paths = {key: path(*key) for key in digest}
    assert set(digest) == {(g, i) for g, i, _, _ in rows if i}
    for a in digest:
        for b in digest:
            assert (digest[a] == digest[b]) == (paths[a] == paths[b])


def random_calls(spark, seed):
    """Nested calls whose frames often, not always, have the shape of a system call."""
    rnd = random.Random(seed)
    rows, number = [(0, 0, 0, 0, "unknown")], 1
    for _ in range(60):
        names = ["entry_SYSCALL_64", "do_syscall_64", "x64_sys_call", "__x64_sys_read", "leaf", "leaf"]
        if rnd.random() < 0.3:
            names.insert(rnd.randrange(4), rnd.choice(["trap", "do_syscall_64", "x64_sys_call"]))
        start, end, parent = rnd.randrange(200), 200 + rnd.randrange(200), 0
        for name in names[: rnd.randint(1, len(names))]:
            start, end = start + rnd.randrange(20), end - rnd.randrange(20)
            rows.append((number, parent, start, end, name))
            parent, number = number, number + 1
    return materialise(spark.createDataFrame(rows, "id long, parent_id long, call_time long, return_time long, symbol string"))


@pytest.mark.parametrize("view", [None, View(0, 1000), View(150, 250), View(100, 140), View(500, 600)])
def test_syscalls_by_pointers_equal_stacks(spark, view):
    calls = random_calls(spark, 5).withColumn("dso", F.lit("k"))
    stacks = ancestor_chains(calls, columns=timeline.FRAME)
    columns = ["call_time", "return_time", "syscall_kernel_name", "call_id"]
    want = lists(timeline.full_syscalls(stacks, view), *columns)
    assert lists(timeline.syscalls_of(timeline.marked_frames(calls, view)), *columns) == want
    assert bool(want) == (view is None or view.start < 500)


def test_syscalls_of_many_trials_in_their_own_views(spark):
    both = random_calls(spark, 6).withColumn("trial", F.lit("a")).unionByName(random_calls(spark, 7).withColumn("trial", F.lit(None)))
    views = spark.createDataFrame([("a", 150, 250), (None, 0, 400)], "trial string, view_start long, view_end long")
    frames = timeline.marked_frames(both, views, ["trial"])
    columns = ["call_time", "return_time", "syscall_kernel_name", "call_id"]
    got = timeline.syscalls_of(frames, ["trial"])
    for trial, view in (("a", View(150, 250)), (None, View(0, 400))):
        one = F.col("trial").eqNullSafe(F.lit(trial))
        alone = timeline.syscalls_of(timeline.marked_frames(both.filter(one), view))
        assert lists(got.filter(one), *columns) == lists(alone, *columns)


def test_paths_of_deep_recursion(spark):
    """Forty levels of one function under another: as many distinct paths, each spelled once."""
    rows = [(0, 0, 0, 0, "unknown")]
    for stack in range(3):
        for level in range(40):
            number = stack * 40 + level + 1
            name = None if level == 7 else ("f" if level else "main")
            rows.append((number, number - 1 if level else 0, level, 1000 - level, name))
    calls = materialise(spark.createDataFrame(rows, "id long, parent_id long, call_time long, return_time long, symbol string"))
    table = overlays.call_path_table(calls)
    assert table.count() == 40 and table.filter("parent_path_id is null").count() == 1
    got = {r.path: (r.self_time, r.calls) for r in overlays.folded_paths(table).collect()}
    expected = {}
    for number, _, start, end, _ in rows[1:]:
        level = (number - 1) % 40
        path = ";".join(["main", *["f"] * (level - (level >= 7))])
        own = 1000 - 2 * level - (1000 - 2 * (level + 1) if level < 39 else 0)
        before = expected.get(path, (0, 0))
        expected[path] = (before[0] + own, before[1] + 1)
    assert got == expected
