"""Ancestor chains in a forest given as parent pointers.

Joins name the id before the group: rows are sorted by a long then, and groups are compared only where ids are equal.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators.slices import group_of
from traceloom.session import materialise


def ancestor_chains(
    nodes: DataFrame,
    *,
    node: str = "id",
    parent: str = "parent_id",
    columns: Sequence[str] = (),
    root: int = 0,
    keys: Sequence[str] = (),
    max_depth: int | None = None,
) -> DataFrame:
    """One row per node: ``keys``, ``id`` and ``chain``, the node itself and its ancestors, nearest first.

    Chain elements are structs of ``id``, ``parent_id`` and ``columns``. A chain ends at ``root`` or
    where the parent is missing; ``max_depth`` limits it to that many ancestors. Each combination of ``keys`` is a
    forest of its own with its own root; ids are unique within it. Pointers in a circle raise ValueError, found
    when a node meets itself, before its chain is twice as long as the circle and the way to it.

    Chains double in each round: a node appends the chain of the last ancestor it knows. A stack of
    depth ``d`` takes ``log2(d)`` joins instead of ``d``. Finished chains leave the join, and the root,
    the one parent that nearly everything shares, is appended from a table of one row per combination of
    ``keys``. Each round stores the chains it grew, so losing an executor never repeats earlier
    rounds and a finished chain is written once. ``nodes`` is read several times: pass a stored table.
    """
    element = F.struct(
        F.col(node).cast("long").alias("id"),
        F.col(parent).cast("long").alias("parent_id"),
        *[F.col(c) for c in columns],
    )
    base = nodes.select(group_of(keys).alias("_group"), element.alias("_self"))
    top = base.filter(F.col("_self.id") == root).select("_group", F.col("_self").alias("_top"))
    up = F.col("_self.parent_id")
    at_root = F.col("_self.id") == root
    # Without keys the root is one row; with keys Spark broadcasts the roots if they are few.
    linked = base.join(top if keys else F.broadcast(top), "_group", "left")
    under_root = ~at_root & (up == root) & F.col("_top").isNotNull()
    state = linked.select(
        "_group",
        F.col("_self.id").alias("id"),
        F.when(under_root, F.array("_self", "_top")).otherwise(F.array("_self")).alias("chain"),
        F.when(~at_root & (up != root), up).alias("_next"),
    )
    if max_depth is not None:
        rounds = math.ceil(math.log2(max_depth + 1))
        for i in range(rounds):
            state = _done(state).unionByName(_doubled(_open(state), state))
            if i + 1 < rounds:
                state = materialise(state, "chains")
        return state.select(*_names(keys), "id", F.slice("chain", 1, max_depth + 1).alias("chain"))
    finished, pending, known = [_done(state)], _open(state), state
    while True:
        grown = materialise(_doubled(pending, known), "chains")
        finished.append(_done(grown))
        pending = _open(grown)
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, finished).select(*_names(keys), "id", "chain")
        if not pending.filter(F.exists("chain", lambda f: f.id == F.col("_next"))).isEmpty():
            raise ValueError("parent pointers form a cycle")
        known = reduce(DataFrame.unionByName, [*finished, pending])


def _names(keys: Sequence[str]) -> list[Column]:
    return [F.col("_group")[k].alias(k) for k in keys]


def _open(state: DataFrame) -> DataFrame:
    return state.filter(F.col("_next").isNotNull())


def _done(state: DataFrame) -> DataFrame:
    return state.filter(F.col("_next").isNull())


def _doubled(pending: DataFrame, known: DataFrame) -> DataFrame:
    more = known.select(
        "_group", F.col("id").alias("_next"), F.col("chain").alias("_more"), F.col("_next").alias("_then")
    )
    return pending.join(more, ["_next", "_group"], "left").select(
        "_group",
        "id",
        F.when(F.col("_more").isNull(), F.col("chain")).otherwise(F.concat("chain", "_more")).alias("chain"),
        F.col("_then").alias("_next"),
    )


def closure(chains: DataFrame, columns: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Chains as rows: each node with each of its ancestors and their distance ``depth`` (0 = itself)."""
    return chains.select(
        *keys, F.col("id").alias("group_id"), F.posexplode("chain").alias("depth", "_node")
    ).select(
        *keys,
        "group_id",
        F.col("_node.id").alias("id"),
        F.col("_node.parent_id").alias("parent_id"),
        F.col("depth").cast("long").alias("depth"),
        *[F.col("_node")[c].alias(c) for c in columns],
    )


def _pointers(nodes: DataFrame, node: str, parent: str, root: int, keys: Sequence[str]) -> DataFrame:
    """``_group``, ``id`` and ``up``, the parent: NULL for the root and below it."""
    up = F.when((F.col(node) != root) & (F.col(parent) != root), F.col(parent).cast("long"))
    return nodes.select(group_of(keys).alias("_group"), F.col(node).cast("long").alias("id"), up.alias("up"))


def _further(jumps: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """Pointers twice as long: each node's ``up`` replaced by that of the node it points to; NULL past the end."""
    there = known.select(
        "_group", F.col("id").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in columns]
    )
    return jumps.join(there, ["up", "_group"], "left")


def ancestor_pairs(
    nodes: DataFrame,
    *,
    node: str = "id",
    parent: str = "parent_id",
    columns: Sequence[str] = (),
    root: int = 0,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Each node with itself and each of its ancestors, as rows: ``keys``, ``group_id``, ``id``, ``parent_id``, ``depth``, ``columns``.

    The same rows as :func:`closure` of :func:`ancestor_chains` gives, without chains: rounds double the distance
    that pairs of ids span, and what an ancestor looks like is joined once at the end. A pair is shuffled
    once when it is found and once for its columns, so the work is that of the output, however long the stacks and
    wide the columns. The root is no join key; it comes from one row per combination of ``keys``. Pointers in a circle raise
    ValueError. ``nodes`` is read several times: pass a stored table.
    """
    jumps = materialise(_pointers(nodes, node, parent, root, keys), "jumps")
    known = jumps  # as long pointers of all nodes, NULL for those that ended
    pairs = [jumps.select("_group", F.col("id").alias("group_id"), "id", F.lit(0).cast("long").alias("depth"))]
    pending, distance = jumps.filter("up is not null"), 1
    while not pending.isEmpty():
        if distance == 1:
            # Pointers as they stand; those to nowhere meet no columns in the end.
            found = pending.select("_group", F.col("id").alias("group_id"), F.col("up").alias("id"), F.lit(1).cast("long").alias("depth"))
        else:
            reached = reduce(DataFrame.unionAll, pairs).select("_group", F.col("group_id").alias("up"), F.col("id").alias("_id"), "depth")
            found = pending.join(reached, ["up", "_group"]).select(
                "_group", F.col("id").alias("group_id"), F.col("_id").alias("id"), (F.col("depth") + distance).alias("depth")
            )
            found = materialise(found, "pairs")
        if not found.filter("group_id = id").isEmpty():
            raise ValueError("parent pointers form a cycle")
        pairs.append(found)
        grown = materialise(_further(pending, known).select("_group", "id", F.col("_up").alias("up")), "jumps")
        pending, known, distance = grown.filter("up is not null"), grown, distance * 2
    looks = nodes.select(
        group_of(keys).alias("_group"), F.col(node).cast("long").alias("id"), F.col(parent).cast("long").alias("parent_id"),
        *columns,
    )
    # What stands right below the root has the root as one more ancestor, if there is one.
    shown = ["id", "parent_id", *columns]
    top = looks.filter(F.col("id") == root).select("_group", F.struct(*shown).alias("_top"))
    looks = looks.join(top if keys else F.broadcast(top), "_group", "left")
    under = (F.col("parent_id") == root) & (F.col("id") != root) & F.col("_top").isNotNull()
    itself = F.struct(F.lit(0).cast("long").alias("_up"), F.struct(*shown).alias("_look"))
    above = F.struct(F.lit(1).cast("long").alias("_up"), F.col("_top").alias("_look"))
    looks = looks.select("_group", "id", F.when(under, F.array(itself, above)).otherwise(F.array(itself)).alias("_looks"))
    below = reduce(DataFrame.unionAll, pairs).join(looks, ["id", "_group"])
    everything = below.select("_group", "group_id", "depth", F.inline("_looks"))
    return everything.select(
        *_names(keys), "group_id", F.col("_look.id").alias("id"), F.col("_look.parent_id").alias("parent_id"),
        (F.col("depth") + F.col("_up")).alias("depth"), *[F.col("_look")[c].alias(c) for c in columns],
    )


def nearest_marked(
    nodes: DataFrame, marked: Column, *, node: str = "id", parent: str = "parent_id", root: int = 0, keys: Sequence[str] = ()
) -> DataFrame:
    """``_group``, ``id``, ``at``: for each node the nearest of itself and its ancestors that is marked, if there is one.

    Each round doubles the distance a node looks up; nodes that met a marked one or the end of their stack leave. Only ids
    are carried. Pointers in a circle raise ValueError. ``nodes`` is read several times: pass a stored table.
    """
    here = F.coalesce(marked, F.lit(False))
    own = nodes.select(
        group_of(keys).alias("_group"), F.col(node).cast("long").alias("id"), F.col(parent).cast("long").alias("_parent"),
        here.alias("_here"),
    )
    tops = own.filter((F.col("id") == root) & F.col("_here")).select("_group", F.lit(root).cast("long").alias("_top"))
    linked = own.join(tops if keys else F.broadcast(tops), "_group", "left")
    at = F.when(F.col("_here"), F.col("id")).when(F.col("_parent") == root, F.col("_top"))
    up = F.when(~F.col("_here") & (F.col("id") != root) & (F.col("_parent") != root), F.col("_parent"))
    state = materialise(linked.select("_group", "id", at.alias("at"), up.alias("up")), "marked")
    found, pending = [state.filter("at is not null").select("_group", "id", "at")], state.filter("up is not null")
    known = state.filter("at is not null or up is not null")  # the others have nothing to hand on
    # A way up meets each of these nodes at most once, so more rounds than that mean a circle.
    for _ in range(pending.count().bit_length() + 1):
        if pending.isEmpty():
            return reduce(DataFrame.unionAll, found)
        grown = _further(pending.drop("at"), known, "at").select(
            "_group", "id", F.col("_at").alias("at"), F.when(F.col("_at").isNull(), F.col("_up")).alias("up")
        )
        grown = materialise(grown, "marked")
        found.append(grown.filter("at is not null").select("_group", "id", "at"))
        pending = grown.filter("up is not null")
        ended = [f.withColumn("up", F.lit(None).cast("long")) for f in found]
        known = reduce(DataFrame.unionByName, [*ended, pending])
    raise ValueError("parent pointers form a cycle")


def chain_digests(
    nodes: DataFrame, value: Column, *, node: str = "id", parent: str = "parent_id", root: int = 0, keys: Sequence[str] = ()
) -> DataFrame:
    """``_group``, ``id``, ``digest`` of each node but the root: equal for nodes whose values up to below the root are equal.

    SHA-256 over the values of growing stretches: a round joins the digest of 2^k nodes with that of the next ones, so stacks of
    equal length are cut alike, and only ids and 32 bytes are carried. ``nodes`` is read once; pointers in a circle raise ValueError.
    """
    up = F.when(F.col(parent) != root, F.col(parent).cast("long"))
    # The empty value and no value differ from any text.
    text = F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit("n"))
    state = nodes.filter(F.col(node) != root).select(
        group_of(keys).alias("_group"), F.col(node).cast("long").alias("id"), up.alias("up"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    state = materialise(state, "digests")
    done, pending, known = [state.filter("up is null")], state.filter("up is not null"), state
    for _ in range(pending.count().bit_length() + 1):
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done).select("_group", "id", "digest")
        joined = F.unhex(F.sha2(F.concat("digest", "_digest"), 256))
        grown = _further(pending, known, "digest").select(
            "_group", "id", F.col("_up").alias("up"),
            F.when(F.col("_digest").isNull(), F.col("digest")).otherwise(joined).alias("digest"),
        )
        grown = materialise(grown, "digests")
        done.append(grown.filter("up is null"))
        pending = grown.filter("up is not null")
        known = reduce(DataFrame.unionByName, [*done, pending])
    raise ValueError("parent pointers form a cycle")
