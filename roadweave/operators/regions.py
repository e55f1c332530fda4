"""Blocks of neighbouring node ids, and what can be told of a network within each of them before it is looked at as a whole."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from roadweave.plans.loops import cut

#: Ids of a block, 2 ** BITS; bounds what a task holds of nodes.
BITS = 15
#: Edges that are joined at once; bounds what a task holds of edges.
EDGES = 1 << 18


def least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component, of nodes 0 to n - 1 and edges (u, v)."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        # the greater root hangs on the least root next to it; then every way up ends at a root
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def block(c: str) -> Column:
    return F.shiftright(F.col(c).cast("long"), BITS)


def whole(df: DataFrame, *columns: str) -> bool:
    return all(isinstance(df.schema[c].dataType, IntegralType) for c in columns)


def _by_block(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows in order of block, in pieces of one block and at most about `most` rows."""
    held, n, at = [], 0, None
    for batch in itertools.chain(batches, [None]):
        for k, rows in batch.groupby("block", sort=True) if batch is not None else [(None, None)]:
            if n and (k != at or n >= most):
                yield at, pd.concat(held, ignore_index=True)
                held, n = [], 0
            at = k
            if rows is not None:
                held.append(rows)
                n += len(rows)


def _blocked(edges: DataFrame) -> DataFrame:
    """edges (u, v, ...) that lie within one block, all of a block in one task, in its order."""
    return edges.withColumn("block", block("u")).where(F.col("block") == block("v")).repartition("block").sortWithinPartitions("block")


def parts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, left) of edges (u, v, ... as whole numbers): part (node, part) names the least node that edges of its block join a node to, itself included;
    left are the edges between parts, with those for their ends."""
    edges = cut(edges)
    size = 1 << BITS

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, label, used = None, np.arange(0), np.zeros(0, bool)
        done = lambda: pd.DataFrame({"node": np.flatnonzero(used) + (at or 0) * size, "part": label[used] + (at or 0) * size})
        for k, rows in _by_block(batches, EDGES):
            if k != at:
                yield done()
                at, label, used = k, np.arange(size), np.zeros(size, bool)
            u, v = (rows[c].to_numpy("int64") - k * size for c in ("u", "v"))
            used[u] = used[v] = True
            label = least_labels(size, np.concatenate([u, np.arange(size)]), np.concatenate([v, label]))
        yield done()

    within = cut(_blocked(edges.select("u", "v")).mapInPandas(joined, "node long, part long"))
    # an end that no edge of its block joins to another is a part of its own
    name = lambda df, c: df.join(within.select(F.col("node").alias(c), F.col("part").alias(f"{c}_")), c, "left").withColumn(c, F.coalesce(f"{c}_", c)).drop(f"{c}_")
    left = cut(name(name(edges.where(block("u") != block("v")), "u"), "v"))
    alone = left.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(within.select("node"), "node", "left_anti")
    return within.unionByName(alone.select("node", F.col("node").alias("part"))), left


def bridge_tree(n: int, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes 0 to n - 1 and edges (u, v), by one walk in depth: a node of the same two-edge-connected part for each node; the bridges; and whether on one side of each all weights are 0."""
    m = len(u)
    ends = np.concatenate([u, v])
    order = np.argsort(ends, kind="stable")
    begin = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    to, by, at = np.concatenate([v, u])[order].tolist(), (order % max(m, 1)).tolist(), begin[:n]
    seen, low, up, over, walk = [0] * n, [0] * n, [-1] * n, [-1] * n, []
    for s in np.unique(ends).tolist():
        if seen[s]:
            continue
        walk.append(s)
        seen[s] = low[s] = len(walk)
        stack = [s]
        while stack:
            x = stack[-1]
            k = at[x]
            if k < begin[x + 1]:
                at[x] = k + 1
                y = to[k]
                if not seen[y]:
                    over[y], up[y] = by[k], x
                    walk.append(y)
                    seen[y] = low[y] = len(walk)
                    stack.append(y)
                elif by[k] != over[x] and seen[y] < low[x]:
                    low[x] = seen[y]
            else:
                stack.pop()
                if stack and low[x] < low[stack[-1]]:
                    low[stack[-1]] = low[x]
    group, below = list(range(n)), weight.tolist()
    for x in reversed(walk):
        if up[x] >= 0:
            below[up[x]] += below[x]
    bridge, one_sided, top = [], [], list(range(n))
    for x in walk:
        if up[x] >= 0:
            top[x] = top[up[x]]
            if low[x] == seen[x]:
                bridge.append(over[x])
                one_sided.append(below[x] == 0 or below[x] == below[top[x]])
            else:
                group[x] = group[up[x]]
    return np.array(group, np.int64), np.array(bridge, np.int64), np.array(one_sided, bool)


def bridge_kernel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sure, left) of edges (edge_id, u, v as whole numbers, u <> v): sure (edge_id) are bridges of the network for certain, and the rest of its bridges are those of left (edge_id, u, v).

    What two ways within a block join is one node of left. A bridge of a block is one of the network if no edge leads out of the block on one side of it; others
    stay in left, with the edges between blocks. A task holds a block's parts and at most about EDGES of its edges.
    """
    edges = cut(edges)
    size = 1 << BITS

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, label, out, held = None, np.arange(0), np.zeros(0, bool), [np.zeros(0, np.int64)] * 3

        def done() -> pd.DataFrame:
            edge, u, v = held
            node, base = np.flatnonzero(out), (at or 0) * size
            _, bridge, sure = bridge_tree(len(label), u, v, np.bincount(label[node], minlength=len(label)))
            edge, u, v = edge[bridge], u[bridge] + base, v[bridge] + base
            return pd.DataFrame({
                "kind": np.r_[np.where(sure, "sure", "left"), np.full(len(node), "name")], "edge_id": np.r_[edge, node * 0],
                "u": np.r_[u, node + base], "v": np.r_[v, label[node] + base],
            })

        for k, rows in _by_block(batches, EDGES):
            if k != at:
                yield done()
                at, label, out, held = k, np.arange(size), np.zeros(size, bool), [np.zeros(0, np.int64)] * 3
            edge, u, v = (rows[c].to_numpy("int64") for c in ("edge_id", "u", "v"))
            u_in, v_in = u >> BITS == k, v >> BITS == k
            out[u[u_in & ~v_in] - k * size] = out[v[v_in & ~u_in] - k * size] = True
            own = u_in & v_in
            edge, u, v = (np.concatenate([a, b]) for a, b in zip(held, (edge[own], label[u[own] - k * size], label[v[own] - k * size]), strict=True))
            group, bridge, _ = bridge_tree(size, u, v, np.zeros(size, np.int64))
            label, held = group[label], [edge[bridge], group[u[bridge]], group[v[bridge]]]
        yield done()

    dealt = edges.withColumn("block", F.explode(F.array_distinct(F.array(block("u"), block("v"))))).repartition("block").sortWithinPartitions("block")
    found = cut(dealt.mapInPandas(reduced, "kind string, edge_id long, u long, v long"))
    name = lambda df, c: df.join(found.where("kind = 'name'").select(F.col("u").alias(c), F.col("v").alias(f"{c}_")), c).withColumn(c, F.col(f"{c}_")).select("edge_id", "u", "v")
    across = name(name(edges.select("edge_id", "u", "v").where(block("u") != block("v")), "u"), "v")
    return found.where("kind = 'sure'").select("edge_id"), found.where("kind = 'left'").select("edge_id", "u", "v").unionByName(across)
