"""Trie of conversation prefixes, with subtree totals by centroid decomposition.

A node is a distinct sequence of first turns (role and text). Its name is 128 bits of hashes over its turns and their places,
taken from running sums along each conversation, so nodes are made by one aggregate instead of a join for each level.

Subtree totals are rolled up over the forest of parent edges. A component of the forest is split at its centroid: the lowest
node that holds half or more of the component's mass. The centroid leaves; each of its children heads a component of its
own, and what lies above stays one. A node's mass is the sum of members over its subtree, which the aggregate that makes
the nodes gives without a rollup; a split takes the centroid's mass off the nodes above it, which are exactly those that
hold half or more. So every split halves a component at least, and their depth is logarithmic, however long a conversation is
and however many branches a turn has. Which child of a centroid a node is below is read from the path of one of its
members, by one join a round.

Components of more than ``local`` nodes are split by Spark, all of them in one round; smaller ones are packed into groups of
about that size, and each group is decomposed in a task. Going back, a centroid's total is its own value and the
totals of the components that its children head; it is added to the nodes from the centroid to its component's top.

Defined cases: turns are in the order of turn (null first), then role, then the text's SHA-256; a null role or text is
empty; rows with a null conv_id belong to no conversation; repeated rows are turns of their own; an empty table has no
root and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.llm.common import stored
from playtape.operators.ordered import ordered, row_number, running_sum, scan

LOCAL = 1 << 14  # nodes of a component that one task decomposes
CHUNK = 1 << 10  # neighbouring conversation ids whose ends are one text
SHARE, MOST = 5, 9  # conversations that share an opening, and one more than its longest length
NODE = ["a", "b"]


def openings(conv_id: Column, most: int = MOST) -> Column:
    """How many turns of a conversation come from the first of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % most


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, said, bytes): turns in order from 1; ``said`` is the text's SHA-256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.sha2(text.cast("binary"), 256).alias("said"), F.octet_length(text).cast("long").alias("bytes"))
    # Turns that are equal in every column of the order are interchangeable.
    return scan(ordered(turns, ["conv_id"], ["turn", "role", "said"]), place=row_number()).result().select("conv_id", "place", "role", "said", "bytes")


def rebuilt(conversations: DataFrame, share: int = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, role, said, bytes, length) and conversations (conv_id, length) after the openings are shared."""
    turns = stored(placed_turns(conversations), "turns")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    each = sizes.select("conv_id", "own", openings(F.col("conv_id"), most).alias("h"), (F.col("conv_id") - F.col("conv_id") % share).alias("base"))
    opened = each.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left").withColumn(
        "kept", F.least("h", F.coalesce("base_own", F.lit(0))))
    opened = stored(opened.withColumn("length", F.col("kept") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    said = ["role", "said", "bytes", "length"]
    given = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "base").join(opened.select("base", "conv_id", "kept", "length"), "base").where(
        F.col("place") <= F.col("kept")).select("conv_id", "place", *said)
    own = turns.join(opened.select("conv_id", "h", "kept", "length"), "conv_id").where(F.col("place") > F.col("h")).select(
        "conv_id", (F.col("place") - F.col("h") + F.col("kept")).alias("place"), *said)
    return given.unionByName(own), opened.select("conv_id", "length")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, bytes, length): the node that each conversation reaches with each turn, and its parent."""
    term = lambda seed: F.xxhash64(F.lit(seed), "place", "role", "said").cast("decimal(20,0)")
    termed = turns.withColumns({"_s": term(1), "_t": term(2)})
    summed = scan(ordered(termed, ["conv_id"], ["place"]), _sums=running_sum(F.col("_s")), _sumt=running_sum(F.col("_t"))).result()

    def name(seed: int, depth: Column, s: Column, t: Column) -> Column:
        return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), depth, s.cast("decimal(38,0)"), t.cast("decimal(38,0)")))

    depth = F.col("place").cast("long")
    here, above = (depth, F.col("_sums"), F.col("_sumt")), (depth - 1, F.col("_sums") - F.col("_s"), F.col("_sumt") - F.col("_t"))
    return summed.select("conv_id", depth.alias("depth"), name(1, *here).alias("a"), name(2, *here).alias("b"),
                         name(1, *above).alias("pa"), name(2, *above).alias("pb"), "bytes", F.col("length").cast("long").alias("length"))


def nodes_of(path: DataFrame, conversations: DataFrame) -> DataFrame:
    """(a, b, pa, pb, depth, conv_id, n_convs, bytes, mass, n_children), the root included."""
    below = F.col("length") - F.col("depth") + 1
    deep = path.groupBy(*NODE).agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.sum(below).alias("mass"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") + 1).cast("long").alias("mass")).where(
        "n_convs > 0").select(zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes"), "mass")
    nodes = stored(deep.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(children.hint("merge"), NODE, "left").fillna(0, ["n_children"])


def decomposed(parents: Sequence[int], mass: list[int], values: list[np.ndarray]) -> list[np.ndarray]:
    """Subtree totals of a forest: its parent indices (-1 for a top), the mass below each node, and columns to be summed."""
    children: list[list[int]] = [[] for _ in parents]
    stack = []
    for node, parent in enumerate(parents):
        (children[parent] if parent >= 0 else stack).append(node)
    gone, steps = [False] * len(parents), []
    while stack:
        top = stack.pop()
        centroid, above, half = top, [], mass[top]
        while True:
            heavy = next((u for u in children[centroid] if not gone[u] and 2 * mass[u] >= half), None)
            if heavy is None:
                break
            above.append(centroid)
            centroid = heavy
        for node in above:
            mass[node] -= mass[centroid]
        gone[centroid] = True
        heads = [u for u in children[centroid] if not gone[u]]
        steps.append((centroid, above, heads))
        stack += heads
        if above:
            stack.append(top)
    totals = [np.zeros(len(parents), np.int64) for _ in values]
    for centroid, above, heads in reversed(steps):
        for total, value in zip(totals, values, strict=True):
            total[centroid] = here = value[centroid] + total[heads].sum()
            total[above] += here
    return totals


def _local_totals(forest: DataFrame, values: list[str], groups: int) -> DataFrame:
    """(a, b, pa, pb, values): totals inside every component, whole components to a group."""
    def solve(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("a", "b", "pa", "pb", "ca", "cb", *values)}
        at = {name: i for i, name in enumerate(zip(column["a"].tolist(), column["b"].tolist(), strict=True))}
        tops = (column["a"] == column["ca"]) & (column["b"] == column["cb"])
        parents = [-1 if top else at[p] for top, *p in zip(tops.tolist(), column["pa"].tolist(), column["pb"].tolist(), strict=True) for p in [tuple(p)]]
        totals = decomposed(parents, table.column("mass").to_pylist(), [column[v] for v in values])
        return pa.table({**{c: table.column(c) for c in ("a", "b", "pa", "pb")}, **dict(zip(values, totals, strict=True))})

    named = ", ".join(f"{c} long" for c in ["a", "b", "pa", "pb", *values])
    # A top's parent is in another component, and the root has none.
    return forest.fillna(0, ["pa", "pb"]).groupBy(F.pmod(F.xxhash64("ca", "cb"), F.lit(groups))).applyInArrow(solve, named)


def rollup(nodes: DataFrame, path: DataFrame, values: list[str], local: int = LOCAL) -> DataFrame:
    """(a, b, values): the columns ``values`` of ``nodes``, summed over every node's subtree.

    ``nodes`` names the top of each node's component, (ca, cb): the root, to begin with.
    """
    top = ["ca", "cb"]
    state = nodes.select(*NODE, "pa", "pb", "depth", "conv_id", "mass", *values, *top)
    rounds: list[tuple[DataFrame, DataFrame]] = []
    done = None
    n_nodes = 0
    while True:
        sizes = state.groupBy(*top).agg(F.count(F.lit(1)).alias("n"), F.max("mass").alias("whole"))
        seen = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        n_nodes = n_nodes or seen.n or 0
        if not seen.most or seen.most <= local:
            break
        marked = state.join(sizes.hint("merge"), top)
        small = marked.where(F.col("n") <= local).select(*state.columns)
        large = marked.where(F.col("n") > local)
        heavy = large.where(F.col("mass") * 2 >= F.col("whole"))
        lowest = F.min_by(F.struct("a", "b", "depth", "mass", "pa", "pb", *values), "mass")
        found = stored(heavy.groupBy(*top).agg(lowest.alias("c")), "centroids")
        above = stored(heavy.join(found.hint("merge"), top).where(F.col("mass") > F.col("c.mass")).select(
            *NODE, F.col("c.a").alias("xa"), F.col("c.b").alias("xb")), "above")
        rounds.append((found.select("c.*"), above))
        split = large.join(found.hint("merge"), top).where((F.col("a") != F.col("c.a")) | (F.col("b") != F.col("c.b")))
        under = F.col("depth") > F.col("c.depth")
        steps = path.select("conv_id", F.col("depth").alias("_at"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("pa").alias("_pa"), F.col("pb").alias("_pb"))
        split = split.withColumn("_at", F.when(under, F.col("c.depth") + 1)).join(steps.hint("merge"), ["conv_id", "_at"], "left")
        below = F.coalesce((F.col("_pa") == F.col("c.a")) & (F.col("_pb") == F.col("c.b")), F.lit(False))
        lighter = F.col("mass") - F.when(F.col("mass") * 2 >= F.col("whole"), F.col("c.mass")).otherwise(F.lit(0))
        relabelled = split.select(*NODE, "pa", "pb", "depth", "conv_id", lighter.alias("mass"), *values,
                                  F.when(below, F.col("_a")).otherwise(F.col("ca")).alias("ca"), F.when(below, F.col("_b")).otherwise(F.col("cb")).alias("cb"))
        finished = stored(small, "components")
        done = finished if done is None else done.unionByName(finished)
        state = stored(relabelled, "components")
    forest = state if done is None else done.unionByName(state)
    totals = _local_totals(forest, values, -(-n_nodes // local) or 1)
    for found, above in reversed(rounds):
        totals = stored(totals, "totals")
        heads = totals.withColumnsRenamed({v: f"_{v}" for v in values}).select(F.col("pa").alias("a"), F.col("pb").alias("b"), *[f"_{v}" for v in values])
        beneath = found.select(*NODE).join(heads.hint("merge"), NODE).groupBy(*NODE).agg(*[F.sum(f"_{v}").alias(f"_{v}") for v in values])
        whole = found.join(beneath.hint("merge"), NODE, "left").select(
            *NODE, "pa", "pb", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).cast("long").alias(v) for v in values])
        whole = stored(whole.fillna(0, ["pa", "pb"]), "wholes")
        more = above.join(whole.select(F.col("a").alias("xa"), F.col("b").alias("xb"), *[F.col(v).alias(f"_{v}") for v in values]).hint("merge"), ["xa", "xb"])
        totals = totals.join(more.drop("xa", "xb").hint("merge"), NODE, "left").select(
            *NODE, "pa", "pb", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]).unionByName(whole)
    return totals.select(*NODE, *values)


def ends(path: DataFrame, conversations: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of nodes where conversations end: the digest of their ids in order, joined by commas.

    Ids are gathered into texts of neighbours first, at most ``CHUNK`` ids each, and a node's texts pass through the digest
    one after another.
    """
    zero = F.lit(0).cast("long")
    ended = path.where(F.col("depth") == F.col("length")).select(*NODE, "conv_id").unionByName(
        conversations.where("length = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    near = ended.groupBy(*NODE, F.floor(F.col("conv_id") / F.lit(CHUNK)).alias("chunk")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(ids.encode())
            yield _digests(out)
        yield _digests([(*node, state.hexdigest())] if node is not None else [])

    return near.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids").mapInArrow(digest, "a long, b long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["a", "b", "ends_sha256"])


def prefix_trie(conversations: DataFrame, share: int = SHARE, most: int = MOST, local: int = LOCAL) -> DataFrame:
    """Every node of the trie of the rebuilt conversations, with its place, members, subtree totals and ends."""
    turns, each = rebuilt(conversations, share, most)
    path = stored(paths(turns), "paths")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    root = F.lit(0).cast("long")
    nodes = nodes_of(path, each).withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": saved, "ca": root, "cb": root})
    nodes = stored(nodes, "trie")
    totals = rollup(nodes, path, ["n_leaves", "saved_tokens"], local)
    above = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    shown = nodes.drop("n_leaves", "saved_tokens", "ca", "cb").join(totals.hint("merge"), NODE).join(ends(path, each).hint("merge"), NODE, "left").join(
        above.hint("merge"), ["pa", "pb"], "left")
    return shown.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
