"""Spanning forests, and what follows from them: thinning that keeps a network whole, and bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadweave.operators import regions
from roadweave.operators.ranks import ranked
from roadweave.operators.rings import rings
from roadweave.plans.loops import cut, drop

#: Steps of a walk around a tree that are summed in one group.
BLOCK = 4096


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a table (node, up) of trees whose roots are their own parents; the way up is halved each round."""
    table = now = cut(parents)
    while True:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        then = cut(now.join(above, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        drop(table)
        table, now = then, then.select("node", "up")
        if then.where("moved").isEmpty():
            return now.select("node", F.col("up").alias("root"))


def spanning_forest(edges: DataFrame, weight: Column) -> DataFrame:
    """edge_id of each edge (edge_id, u, v) of the forest of least weights; of equal weights the least edge_id. Every part of the network is one tree.

    Each round every part takes its lightest edge to another part, and parts so joined become one; of several edges between two parts only the
    lightest stays. Parts at least halve in number each round. Edges from a node to itself are in no forest. No edges: no rows.
    """
    best = lambda: F.min(F.struct("w", "edge_id"))
    left = cut(edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), weight.alias("w"), "edge_id").groupBy("a", "b").agg(best().alias("e")).select("a", "b", "e.*"))
    taken, picks = left.select("edge_id").where(F.lit(False)), [left]
    while not left.isEmpty():
        both = left.select("a", "b", "w", "edge_id").union(left.select("b", "a", "w", "edge_id"))
        pick = cut(both.groupBy("a").agg(F.min(F.struct("w", "edge_id", "b")).alias("e")).select("a", "e.edge_id", "e.b"))
        picks.append(pick)
        taken = taken.union(pick.select("edge_id").distinct())
        # two parts that pick each other: the lesser is the root
        back = pick.select(F.col("a").alias("b"), F.col("b").alias("back"))
        root = _roots(pick.join(back, "b").select(F.col("a").alias("node"), F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("up")))
        x = left.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        then = cut(x.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(best().alias("e")).select("a", "b", "e.*"))
        if left is not picks[0]:
            drop(left)
        left = then
    out = cut(taken.distinct())
    drop(left, *picks)
    return out


def thinned(streets: DataFrame, fraction: float, seed: int) -> DataFrame:
    """streets (edge_id, u, v; both directions are one) with `kept`: the share `fraction` of them is removed in a random order, but none whose removal would part the network further.

    Going through the streets in a random order and putting back each that the rest needs leaves a spanning forest of the streets that come last;
    so those not in that forest, the first of the order first, are the ones removed. Where the forest leaves fewer, fewer are removed:
    the share reached is the share of rows not kept. Parallel streets don't need each other. fraction is at least 0 and below 1.
    """
    if not 0 <= fraction < 1:
        raise ValueError("the share to remove is at least 0 and below 1")
    base = cut(streets.withColumn("_order", F.xxhash64(F.lit(seed), "edge_id")))
    need = spanning_forest(base, F.struct(F.bitwise_not("_order"), -F.col("edge_id")))
    target = int(base.count() * fraction)
    spare = ranked(base.join(need, "edge_id", "left_anti").select("edge_id", "_order"), "_order", "edge_id").where(F.col("rank") <= target)
    gone = spare.select("edge_id", F.lit(False).alias("_kept"))
    return base.join(gone, "edge_id", "left").select(*streets.columns, F.coalesce("_kept", F.lit(True)).alias("kept"))


def bridges(edges: DataFrame) -> DataFrame:
    """edge_id of each edge (edge_id, u, v) whose loss parts its component.

    Every edge outside a spanning forest draws a random mark at both of its ends. A forest edge is a bridge if no such edge leads out of the subtree
    below it: then the marks there cancel each other out (XOR). Subtrees are stretches of a walk around the tree, which is a cycle of its
    directed edges; running XORs are summed by blocks. Rounds grow with the logarithm of the network, whatever its diameter. Marks have 128 bits: an edge
    is taken for a bridge by mistake with a chance of 2^-128. Parallel edges are no bridges, nor are edges from a node to itself.
    Where nodes are whole numbers, what can be told within blocks of them is told first, exactly (operators/regions.py); only the rest goes through these rounds.
    """
    edges = edges.where("u <> v").select(F.col("edge_id").cast("long").alias("edge_id"), "u", "v")
    if not regions.whole(edges, "u", "v"):
        return _marked_bridges(edges)
    sure, left = regions.bridge_kernel(edges)
    return sure.unionByName(_marked_bridges(left))


def _marked_bridges(edges: DataFrame) -> DataFrame:
    edges = cut(edges)
    tree = spanning_forest(edges, F.lit(0))
    marks = [F.xxhash64(F.lit(k), "edge_id").alias(f"m{k}") for k in (1, 2)]
    spare = edges.join(tree, "edge_id", "left_anti").select(F.explode(F.array("u", "v")).alias("node"), *marks)
    at_node = spare.groupBy("node").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"))
    t = edges.join(tree, "edge_id")
    half = t.select((2 * F.col("edge_id")).alias("h"), "u", "v", "edge_id").union(t.select((2 * F.col("edge_id") + 1).alias("h"), "v", "u", "edge_id"))
    w = Window.partitionBy("u").orderBy("v", "h")
    before = F.coalesce(F.lag("h").over(w), F.last("h").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # the walk comes back on the neighbour before, and goes out on this one
    steps = cut(half.select("h", before.bitwiseXOR(F.lit(1).cast("long")).alias("prev")))
    x = half.join(rings(steps), "h")
    two = Window.partitionBy("edge_id")
    x = x.withColumn("down", F.col("at") == F.min("at").over(two)).join(at_node, F.col("v") == F.col("node"), "left").drop("node")
    for m in ("m1", "m2"):
        x = x.withColumn(m, F.when(F.col("down"), F.coalesce(m, F.lit(0))).otherwise(F.lit(0)))
    x = cut(x.select("edge_id", "ring", "at", "down", "m1", "m2", F.floor(F.col("at") / BLOCK).alias("block")))
    sums = x.groupBy("ring", "block").agg(F.bit_xor("m1").alias("s1"), F.bit_xor("m2").alias("s2"))
    over = Window.partitionBy("ring").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    sums = sums.select("ring", "block", *[F.coalesce(F.bit_xor(s).over(over), F.lit(0)).alias(f"b{s}") for s in ("s1", "s2")])
    run = Window.partitionBy("ring", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    y = x.join(sums, ["ring", "block"]).select("edge_id", "down", *[F.bit_xor(f"m{k}").over(run).bitwiseXOR(F.col(f"bs{k}")).alias(f"p{k}") for k in (1, 2)], "m1", "m2")
    # up to the way back, less up to the way down but for the mark of the node that it leads to
    out = y.groupBy("edge_id").agg(*[F.bit_xor(F.col(f"p{k}").bitwiseXOR(F.col(f"m{k}"))).alias(f"x{k}") for k in (1, 2)])
    return out.where("x1 = 0 AND x2 = 0").select("edge_id")
