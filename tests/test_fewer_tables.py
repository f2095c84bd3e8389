"""Which tables ancestor pairs and call paths store on their way."""

from __future__ import annotations

import pytest

from traceloom.operators import ancestor_pairs, chains
from traceloom.plans import overlays
from traceloom.session import materialise


@pytest.fixture
def stored(monkeypatch):
    labels = []

    def noting(df, label="table"):
        labels.append(label)
        return materialise(df, label)

    monkeypatch.setattr(chains, "materialise", noting)
    monkeypatch.setattr(overlays, "materialise", noting)
    return labels


def test_first_pointers_are_neither_joined_nor_stored(spark, stored):
    parents = {0: 0, 1: 0, 2: 1, 3: 2, 5: 4, 6: 5}  # 4 is missing
    nodes = spark.createDataFrame([("t", i, p) for i, p in parents.items()], "trial string, id long, parent_id long")
    got = ancestor_pairs(materialise(nodes, "nodes"), keys=["trial"]).collect()
    want = []
    for i in parents:
        at, depth = i, 0
        while at in parents:
            want.append((i, at, parents[at], depth))
            if at == 0:
                break
            at, depth = parents[at], depth + 1
    assert sorted((r.group_id, r.id, r.parent_id, r.depth) for r in got) == sorted(want)
    assert stored.count("pairs") == stored.count("jumps") - 2


def test_digests_of_calls_are_stored_once(spark, stored):
    calls = [(0, 0, 0, 0, None), (1, 0, 0, 10, "a"), (2, 1, 2, 5, "b"), (3, 1, 6, 7, "b"), (4, 0, 20, 25, "a")]
    named = spark.createDataFrame(calls, "id long, parent_id long, call_time long, return_time long, symbol string")
    got = {(r.path, r.self_time, r.calls) for r in overlays.folded_stacks(materialise(named, "named")).collect()}
    assert got == {("a", 11, 2), ("a;b", 4, 2)}
    assert "call-digests" not in stored
