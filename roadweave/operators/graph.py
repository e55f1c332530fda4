"""Graph operators over edge tables: components, reachability, shortest paths, routes, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadweave.functions.routing import OUT_OF_REACH
from roadweave.operators import regions
from roadweave.operators.ranks import ranked
from roadweave.operators.spatial import nearest
from roadweave.plans.loops import cut, drop

#: Places of a component that each start may be followed through, and waves that take out hubs before.
FRONTIER, WAVES = 64, 16


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, root): the least node of its component. nodes: node_id; edges: u, v.

    Where ids are whole numbers, what edges join within a block of ids first becomes one node, its least, in the task that reads the block (operators/regions.py): if
    ids near each other are mostly joined, few nodes and edges are left. Each round a node takes the least label around it and then its label's label, so
    that chains shorten by half; a node's minimum is aggregated before the shuffle. Any ids give the same rows.
    """
    if not regions.whole(nodes, "node_id") or not regions.whole(edges, "u", "v"):
        return _labelled(nodes, edges)
    nodes = cut(nodes.select("node_id"))
    kept = nodes.where("node_id IS NOT NULL").distinct()
    inner = edges.select("u", "v").where("u <> v")
    inner = inner.join(kept.withColumnRenamed("node_id", "u"), "u", "left_semi").join(kept.withColumnRenamed("node_id", "v"), "v", "left_semi")
    part, left = regions.parts(inner)
    left = left.select("u", "v").distinct()
    label = _labelled(left.select(F.explode(F.array("u", "v")).alias("node_id")).distinct(), left).select(F.col("node_id").alias("part"), F.col("root").alias("far"))
    part = part.join(label, "part", "left").select(F.col("node").alias("node_id"), F.coalesce("far", "part").alias("near"))
    kind = nodes.schema["node_id"].dataType
    return nodes.join(part, "node_id", "left").select("node_id", F.coalesce(F.col("near").cast(kind), "node_id").alias("root"))


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct())
    table = label = cut(nodes.select("node_id", F.col("node_id").alias("root")))
    while True:
        around = both.join(label, both["v"] == label["node_id"]).groupBy("u").agg(F.min("root").alias("near"))
        x = label.join(around, label["node_id"] == around["u"], "left").select("node_id", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was"))
        up = x.select(F.col("node_id").alias("root"), F.col("root").alias("above"))
        x = cut(x.join(up, "root", "left").select("node_id", F.least("root", F.coalesce("above", "root")).alias("root"), "was"))
        drop(table)
        if x.where("root <> was").isEmpty():
            drop(both)
            return x.select("node_id", "root")
        table, label = x, x.select("node_id", "root")


def compressed(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) in compressed rows: nodes with node_index (from 0 by node_id) and the ranges out_begin to out_end, in_begin to in_end (behind the last) of their links;
    links (link_id, src, dst) with src_index, dst_index and their places out_at and in_at, ordered by node and link_id.

    A node is ranked together with its links, before the first of them: its rank less the nodes up to it is where its range begins, also if it has no links.
    Links between unknown nodes: ValueError.
    """
    numbered = cut(ranked(nodes.select("node_id").distinct(), "node_id").select("node_id", (F.col("rank") - 1).alias("node_index")))
    known = numbered.select("node_id")
    for end in ("src", "dst"):
        if not links.join(known.withColumnRenamed("node_id", end), end, "left_anti").isEmpty():
            raise ValueError(f"a link's {end} isn't a node")
    by_node, by_link = numbered, links
    for end, name in (("src", "out"), ("dst", "in")):
        rows = numbered.select("node_id", F.lit(None).cast("long").alias("link_id")).unionByName(links.select(F.col(end).alias("node_id"), F.col("link_id").cast("long")))
        placed = cut(ranked(rows, "node_id", F.asc_nulls_first("link_id")).join(numbered, "node_id").withColumn("place", F.col("rank") - F.col("node_index") - F.when(F.col("link_id").isNull(), 1).otherwise(2)))
        begin = placed.where("link_id IS NULL").select("node_id", F.col("place").alias(f"{name}_begin"))
        degree = placed.where("link_id IS NOT NULL").groupBy("node_id").agg(F.count("*").alias("d"))
        size = begin.join(degree, "node_id", "left").select("node_id", f"{name}_begin", (F.col(f"{name}_begin") + F.coalesce("d", F.lit(0))).alias(f"{name}_end"))
        by_node = by_node.join(size, "node_id")
        at = placed.where("link_id IS NOT NULL").select("link_id", F.col("node_index").alias(f"{end}_index"), F.col("place").alias(f"{name}_at"))
        by_link = by_link.join(at, "link_id")
    return by_node, by_link


def component_order(components: DataFrame) -> DataFrame:
    """(component_id, root, size): the largest first, ties by the least node; ids from 0."""
    sizes = components.groupBy("root").agg(F.count("*").alias("size"))
    return ranked(sizes, F.desc("size"), "root").select((F.col("rank") - 1).cast("int").alias("component_id"), "root", "size")


def cost_to_go(links: DataFrame, destinations: DataFrame) -> DataFrame:
    """(destination_id, node_id, cost) of every node that reaches a destination. links: src_node_id, dst_node_id, cost, blocked; destinations: destination_id.

    All destinations relax in one join each round; only nodes whose cost fell are carried on.
    """
    usable = cut(links.where("NOT blocked").groupBy(F.col("src_node_id").alias("s"), F.col("dst_node_id").alias("d")).agg(F.min("cost").alias("step")))
    table = best = cut(destinations.select("destination_id", F.col("destination_id").alias("node_id"), F.lit(0.0).alias("cost")))
    front = best
    while not front.isEmpty():
        reach = front.join(usable, front["node_id"] == usable["d"]).groupBy("destination_id", F.col("s").alias("node_id")).agg(F.min(F.col("cost") + F.col("step")).alias("new"))
        x = cut(best.join(reach, ["destination_id", "node_id"], "full_outer"))
        drop(table)
        table = x
        better = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))
        front = x.where(better).select("destination_id", "node_id", F.col("new").alias("cost"))
        best = x.select("destination_id", "node_id", F.when(better, F.col("new")).otherwise(F.col("cost")).alias("cost"))
    return best


def ranked_next_links(links: DataFrame, turns: DataFrame, costs: DataFrame) -> DataFrame:
    """(destination_id, incoming_link_id, link_id, cost, rank) of the legal links out of each link's end, and with a null incoming link out of each node."""
    first = links.select(F.col("link_id"), F.col("src_node_id"), F.col("dst_node_id").alias("node_id"), F.col("cost").alias("step"), "blocked")
    goal = first.join(costs, "node_id").where(~F.col("blocked") & (F.col("cost") < OUT_OF_REACH)).select("destination_id", "link_id", "src_node_id", (F.col("step") + F.col("cost")).alias("cost"))
    free = goal.withColumn("incoming_link_id", F.lit(None).cast("int"))
    legal = turns.where("NOT is_forbidden").select(F.col("from_link_id").alias("incoming_link_id"), F.col("to_link_id").alias("link_id"))
    x = free.unionByName(goal.join(legal, "link_id"))
    w = Window.partitionBy("destination_id", "incoming_link_id", F.when(F.col("incoming_link_id").isNull(), F.col("src_node_id"))).orderBy("cost", "link_id")
    return x.withColumn("rank", F.row_number().over(w)).select("destination_id", "incoming_link_id", "src_node_id", "link_id", "cost", "rank")


def greedy_routes(starts: DataFrame, links: DataFrame, turns: DataFrame, costs: DataFrame, max_hops: int) -> DataFrame:
    """starts (od_id, origin_id, destination_id) with path: the best legal link after each link, until the destination; empty on a cycle, a dead end or too many hops."""
    best = cut(ranked_next_links(links, turns, costs).where("rank = 1").select("destination_id", "incoming_link_id", "src_node_id", "link_id"))
    ends = links.select("link_id", F.col("dst_node_id").alias("at"))
    step = best.join(ends, "link_id")
    now = cut(starts.select("od_id", "origin_id", "destination_id", F.col("origin_id").alias("at"), F.array().cast("array<int>").alias("path"), (F.col("origin_id") == F.col("destination_id")).alias("done"), F.lit(False).alias("failed")))
    for hop in range(max_hops):
        a, b = now.alias("a"), step.alias("b")
        on = (F.col("a.destination_id") == F.col("b.destination_id")) & ~F.col("a.done") & ~F.col("a.failed")
        on &= (F.col("b.incoming_link_id").isNull() & (F.col("b.src_node_id") == F.col("a.at"))) if hop == 0 else (F.col("b.incoming_link_id") == F.element_at("a.path", -1))
        x = a.join(b, on, "left")
        moved = F.col("b.link_id").isNotNull()
        idle = F.col("a.done") | F.col("a.failed")
        path = F.when(moved, F.concat("a.path", F.array("b.link_id"))).otherwise(F.col("a.path"))
        failed = F.col("a.failed") | (~idle & (~moved | F.array_contains("a.path", F.col("b.link_id"))))
        now = cut(x.select("a.od_id", "a.origin_id", "a.destination_id", F.when(moved, F.col("b.at")).otherwise(F.col("a.at")).alias("at"), path.alias("path"), F.col("a.done").alias("was"), failed.alias("failed")).withColumn("done", F.col("was") | (F.col("at") == F.col("destination_id")) & ~F.col("failed")).drop("was"))
        if now.where("NOT done AND NOT failed").isEmpty():
            break
    return now.select("od_id", "origin_id", "destination_id", F.when(F.col("done"), F.col("path")).otherwise(F.array().cast("array<int>")).alias("path"))


def ranked_paths(ods: DataFrame, links: DataFrame, turns: DataFrame, costs: DataFrame, k: int, max_hops: int, max_expansions: int | None = None) -> DataFrame:
    """(od_id, rank, path, cost, met_bound): the k cheapest paths of each od (od_id, origin_id, destination_id) without a node twice, under turn rules; ties by the path.

    Partial paths are rows, ordered by cost so far plus cost to go, which never falls along a path. Each round adds a link to all of them by one
    equi-join. A row goes when the cost to go is known to be in vain: it is dearer than the k cheapest whole paths so far, or `max_expansions`
    rows of its od come before it. That is the bound on the search: at most so many rows of an od, in order, are looked at, by default
    k * max(16, 4 * links). An od that met it has `met_bound` set, also where no path was found (one row with a null rank). Other ods without a
    path, those that start at their goal among them, have no row. Ods may have an incoming_link_id, after which the first link must be a legal turn.
    """
    usable = cut(links.where("NOT blocked").select("link_id", F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("to"), F.col("cost").alias("step")))
    bound = max_expansions or k * max(16, 4 * links.count())
    follow = cut(turns.where("NOT is_forbidden").select(F.col("from_link_id").alias("last"), F.col("to_link_id").alias("link_id")).join(usable, "link_id"))
    goal = cut(costs.where(F.col("cost") < OUT_OF_REACH).select("destination_id", F.col("node_id").alias("to"), F.col("cost").alias("rest")))
    start = ods.where("origin_id <> destination_id").join(goal, ["destination_id"]).where("to = origin_id")
    front = cut(start.select("od_id", "destination_id", F.col("to").alias("at"), (F.col("incoming_link_id") if "incoming_link_id" in ods.columns else F.lit(None)).cast("int").alias("last"), F.array().cast("array<int>").alias("path"), F.array("to").alias("seen"), F.lit(0.0).alias("cost"), F.col("rest").alias("estimate")))
    seen = front.select("od_id", "estimate", "cost", "path", F.lit(False).alias("whole"))
    found = seen.where("whole")
    first = lambda: Window.partitionBy("od_id").orderBy("estimate", "cost", "path")
    for hop in range(max_hops):
        x = front.join(follow, "last")
        if hop == 0:
            names = ("od_id", "destination_id", "path", "seen", "cost", "link_id", "to", "step")
            x = x.select(*names).unionByName(front.where("last IS NULL").join(usable, front["at"] == usable["src"]).select(*names))
        x = x.where(~F.array_contains("seen", F.col("to"))).join(goal, ["destination_id", "to"]).withColumn("cost", F.col("cost") + F.col("step"))
        x = x.select("od_id", "destination_id", F.col("to").alias("at"), F.col("link_id").alias("last"), F.concat("path", F.array("link_id")).alias("path"), F.concat("seen", F.array("to")).alias("seen"), "cost", (F.col("cost") + F.col("rest")).alias("estimate"))
        dear = found.groupBy("od_id").agg(F.count("*").alias("n"), F.max("estimate").alias("most")).where(F.col("n") >= k).select("od_id", "most")
        x = x.join(dear, "od_id", "left").where("most IS NULL OR estimate <= most").drop("most")
        x = cut(x.withColumn("place", F.row_number().over(first())).where(F.col("place") <= bound + 1).drop("place"))
        whole = F.col("at") == F.col("destination_id")
        rows = x.select("od_id", "estimate", "cost", "path", whole.alias("whole"))
        seen = seen.unionByName(rows)
        found = cut(found.unionByName(rows.where("whole")).withColumn("place", F.row_number().over(first())).where(F.col("place") <= k).drop("place"))
        front = x.where(~whole)
        if front.isEmpty():
            break
    # one sort by od: which turn each row has, which of the whole paths it is, and whether the bound was met
    of_od = Window.partitionBy("od_id")
    x = seen.withColumn("turn", F.row_number().over(first())).withColumn("rank", F.sum(F.col("whole").cast("int")).over(first().rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("good", F.col("whole") & (F.col("rank") <= k) & (F.col("turn") <= bound))
    x = x.withColumn("n", F.sum(F.col("good").cast("int")).over(of_od)).withColumn("met_bound", (F.max("turn").over(of_od) > bound) & (F.col("n") < k))
    out = x.where("good OR (met_bound AND n = 0 AND turn = 1)")
    some = lambda c: F.when(F.col("good"), F.col(c)).alias(c)
    return out.select("od_id", some("rank").cast("int").alias("rank"), some("path"), some("cost"), "met_bound")


def _through_hubs(ways: DataFrame, known: DataFrame) -> DataFrame:
    """(p, part, hub, leads, led): of each place in a component (p, part) of directed edges (u_, v_) whether it leads to the component's hub, the place with the most edges (ties: the least), and whether the hub leads there."""
    degree = ways.select(F.explode(F.array("u_", "v_")).alias("p")).groupBy("p").agg(F.count("*").alias("d"))
    hub = known.join(degree, "p").groupBy("part").agg(F.max(F.struct("d", (-F.col("p")).alias("least"), "p")).alias("m")).select("part", F.col("m.p").alias("hub"))
    steps = cut(ways.select(F.lit(True).alias("on"), F.col("u_").alias("x"), F.col("v_").alias("y")).unionByName(ways.select(F.lit(False).alias("on"), F.col("v_").alias("x"), F.col("u_").alias("y"))))
    front = seen = cut(hub.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("on"), F.col("hub").alias("p")))
    while not front.isEmpty():
        front = cut(front.join(steps, (front["p"] == steps["x"]) & (front["on"] == steps["on"])).select(front["on"], F.col("y").alias("p")).distinct().join(seen, ["on", "p"], "left_anti"))
        seen = seen.unionByName(front)
    flags = seen.groupBy("p").agg(F.max(F.expr("NOT on")).alias("leads"), F.max("on").alias("led"))
    no = F.lit(False)
    out = cut(known.join(hub, "part").join(flags, "p", "left").select("p", "part", "hub", F.coalesce("leads", no).alias("leads"), F.coalesce("led", no).alias("led")))
    drop(steps)
    return out


def reachable_pairs(pairs: DataFrame, edges: DataFrame, most: int = FRONTIER, waves: int = WAVES) -> DataFrame:
    """pairs (a, b) with `reached`: whether b can be reached from a over directed edges (u, v); a pair with a null isn't.

    What edges in both directions join is one place, found in few rounds. Of the pairs of different places each wave settles those with a way through the
    hub of their component, where a leads to the hub and the hub to b, and takes the hubs out; so no start has to be followed through a hub. It also
    drops pairs that lie in different components, or that would lead there if they had a way. Once no component has over `most` places,
    or after so many waves, a frontier of each distinct start that is left grows until nothing is new: as many rounds as the longest way
    has one-way edges. A network that has no hubs may leave many starts and long ways to the last step.
    """
    edges = cut(edges.select("u", "v").where("u <> v").distinct())
    nodes = edges.select(F.col("u").alias("node_id")).union(edges.select("v")).union(pairs.select("a")).union(pairs.select("b")).distinct()
    both = edges.join(edges.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"])
    place = cut(weak_components(nodes, both))
    named = lambda df, c: df.join(place.select(F.col("node_id").alias(c), F.col("root").alias(f"{c}_")), c, "left")
    ways = cut(named(named(edges, "u"), "v").where("u_ <> v_").select("u_", "v_").distinct())
    asked = cut(named(named(pairs, "a"), "b"))
    left, hits = cut(asked.where("a_ <> b_").select("a_", "b_").distinct()), []
    for _ in range(waves):
        places = ways.select(F.explode(F.array("u_", "v_")).alias("p")).distinct()
        part = cut(weak_components(places.withColumnRenamed("p", "node_id"), ways.withColumnsRenamed({"u_": "u", "v_": "v"})).select(F.col("node_id").alias("p"), F.col("root").alias("part")))
        of = lambda df, c: df.join(part.select(F.col("p").alias(c), F.col("part").alias(f"{c}part")), c)  # noqa: E731, B023
        left = cut(of(of(left, "a_"), "b_").where("a_part = b_part").select("a_", "b_", F.col("a_part").alias("part")))
        big = cut(part.join(left.select("part").distinct(), "part", "left_semi").groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > most))
        if big.isEmpty():
            break
        flags = _through_hubs(ways.join(part.join(big, "part", "left_semi").select(F.col("p").alias("u_")), "u_", "left_semi"), part.join(big, "part", "left_semi"))
        side = lambda c: flags.select(F.col("p").alias(c), F.col("hub").alias(f"{c}hub"), F.col("leads").alias(f"{c}leads"), F.col("led").alias(f"{c}led"))  # noqa: E731, B023
        x = cut(left.join(side("a_"), "a_", "left").join(side("b_"), "b_", "left"))
        through = F.col("a_leads") & F.col("b_led")
        hits.append(x.where(through).select("a_", "b_"))
        # a way past the hub: what the hub leads to leads on to such places only, and what leads to the hub comes from such places only
        open_ = x.where("a_hub IS NULL").unionByName(x.where(~through & ((~F.col("a_led")) | F.col("b_led")) & ((~F.col("b_leads")) | F.col("a_leads")) & (F.col("a_") != F.col("a_hub")) & (F.col("b_") != F.col("b_hub"))))
        left = cut(open_.select("a_", "b_"))
        hubs = F.broadcast(flags.select(F.col("hub").alias("h")).distinct())  # one a component of over `most` places
        ways = cut(ways.join(hubs, F.col("u_") == F.col("h"), "left_anti").join(hubs, F.col("v_") == F.col("h"), "left_anti"))
        if left.isEmpty():
            break
    front = seen = cut(left.select(F.col("a_").alias("s")).distinct().select("s", F.col("s").alias("e")))
    while not front.isEmpty():
        front = cut(front.join(ways, front["e"] == ways["u_"]).select("s", F.col("v_").alias("e")).distinct().join(seen, ["s", "e"], "left_anti"))  # part of what is seen
        seen = seen.unionByName(front)
    hit = seen.select(F.col("s").alias("a_"), F.col("e").alias("b_")).join(left.select("a_", "b_"), ["a_", "b_"], "left_semi")
    for more in hits:
        hit = hit.unionByName(more)
    same = asked.where("a_ = b_").select(*pairs.columns, F.lit(True).alias("reached"))
    found = asked.where("a_ <> b_").join(hit.withColumn("hit", F.lit(True)), ["a_", "b_"], "left")
    none = asked.where("a IS NULL OR b IS NULL").select(*pairs.columns, F.lit(False).alias("reached"))
    return same.unionByName(none).unionByName(found.select(*pairs.columns, F.coalesce("hit", F.lit(False)).alias("reached")))


def joined_to_main(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(root, u, v): for each part (node_id, root) but the largest the shortest link between its nodes (node_id, x, y) and the largest part's, ties by ids."""
    main = component_order(parts).where("component_id = 0").select(F.col("root").alias("main"))
    n = nodes.join(parts, "node_id").join(F.broadcast(main), F.lit(True), "left")  # one row
    return nearest(n.where("root <> main").select("root", "node_id", "x", "y"), n.where("root = main").select("node_id", "x", "y"), "root").select("root", F.col("a").alias("u"), F.col("b").alias("v"))


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v, length, n_edges): chains through nodes of degree two as one edge between their ends; rings without an end have null ends. edges: edge_id, u, v, length."""
    ends = edges.select("edge_id", F.explode(F.array("u", "v")).alias("node_id"))
    inner = ends.groupBy("node_id").agg(F.count("*").alias("n"), F.min("edge_id").alias("a"), F.max("edge_id").alias("b")).where("n = 2")
    chain = weak_components(edges.select(F.col("edge_id").alias("node_id")), inner.select(F.col("a").alias("u"), F.col("b").alias("v")))
    x = edges.join(chain, edges["edge_id"] == chain["node_id"]).drop("node_id")
    outer = ends.join(inner.select("node_id"), "node_id", "left_anti").join(chain.withColumnRenamed("node_id", "edge_id"), "edge_id")
    tips = outer.groupBy("root").agg(F.array_sort(F.collect_list("node_id")).alias("tips"))  # at most two
    sums = x.groupBy("root").agg(F.sum("length").alias("length"), F.count("*").alias("n_edges"))
    return sums.join(tips, "root", "left").select(F.col("tips")[0].alias("u"), F.try_element_at("tips", F.lit(2)).alias("v"), "length", "n_edges")
