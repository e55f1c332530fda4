"""Inputs of a model of costs to go: twenty features of a node and a destination, and padded graph tensors under a byte budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from roadweave.plans.loops import cut

#: The inputs by name, in order.
INPUTS = (
    "relative_x_by_spatial_diagonal",
    "relative_y_by_spatial_diagonal",
    "euclidean_distance_by_spatial_diagonal",
    "node_in_degree_by_max",
    "node_out_degree_by_max",
    "destination_in_degree_by_max",
    "destination_out_degree_by_max",
    "usable_outgoing_travel_time_min_by_max",
    "usable_outgoing_travel_time_mean_by_max",
    "usable_incoming_travel_time_mean_by_max",
    "outgoing_effective_capacity_sum_by_max",
    "incoming_effective_capacity_sum_by_max",
    "outgoing_blocked_link_fraction",
    "incoming_blocked_link_fraction",
    "global_max_travel_time_by_one_tick",
    "global_mean_travel_time_by_max",
    "global_blocked_link_fraction",
    "has_usable_outgoing",
    "has_usable_incoming",
    "is_destination",
)
#: Features of a link, besides one for each road class.
LINK_INPUTS = ("length_by_diagonal", "speed_by_max", "lanes_by_max", "travel_time_by_max", "effective_capacity_by_max", "incident_multiplier", "is_blockable")
#: Memory that building a batch takes, by its padded bytes.
PEAK = 2


def _state(links: DataFrame) -> DataFrame:
    effective = F.col("capacity") * F.col("multiplier")
    return links.withColumn("effective", effective).withColumn("blocked", (effective <= 0) & F.col("blockable"))


def model_inputs(nodes: DataFrame, links: DataFrame, destinations: DataFrame) -> DataFrame:
    """(network, destination_id, node_id, the twenty INPUTS) of each node of a network with a destination.

    nodes: network, node_id, x, y. links: network, link_id, src, dst, travel (above 0), capacity, multiplier (0 to 1), blockable. destinations:
    network, destination_id. What they are divided by is of the network itself. A node without links has zeros; a destination that is no node, no rows.
    """
    x = _state(links)
    usable, shut = F.when(~F.col("blocked"), F.col("travel")), F.avg(F.col("blocked").cast("double"))
    side = lambda end, p: x.groupBy("network", F.col(end).alias("node_id")).agg(F.count("*").alias(f"{p}_degree"), F.min(usable).alias(f"{p}_min"), F.avg(usable).alias(f"{p}_mean"), F.sum("effective").alias(f"{p}_cap"), shut.alias(f"{p}_blocked"))
    f = nodes.join(side("src", "out"), ["network", "node_id"], "left").join(side("dst", "in"), ["network", "node_id"], "left")
    f = f.withColumns({f"has_{p}": F.col(f"{p}_min").isNotNull().cast("double") for p in ("out", "in")}).fillna(0).fillna(0.0)
    f = cut(f)
    span = F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    of_nodes = f.groupBy("network").agg(F.greatest(F.max("out_degree"), F.max("in_degree"), F.lit(1)).alias("top_degree"), F.greatest(F.max("out_cap"), F.max("in_cap"), F.lit(1e-6)).alias("top_cap"), F.greatest(span, F.lit(1.0)).alias("diagonal"))
    top = F.greatest(F.max("travel"), F.lit(1e-6))
    of_links = x.groupBy("network").agg(top.alias("top_travel"), (F.avg("travel") / top).alias("mean_travel"), shut.alias("shut"))
    scale = of_nodes.join(of_links, "network", "left").fillna(1e-6, ["top_travel"]).fillna(0.0, ["mean_travel", "shut"])
    goal = f.select("network", F.col("node_id").alias("destination_id"), F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("in_degree").alias("goal_in"), F.col("out_degree").alias("goal_out"))
    goal = destinations.select("network", "destination_id").distinct().join(goal, ["network", "destination_id"]).join(scale, "network")
    c = F.col
    dx, dy = c("x") - c("gx"), c("y") - c("gy")
    values = (
        dx / c("diagonal"), dy / c("diagonal"), F.hypot(dx, dy) / c("diagonal"),
        c("in_degree") / c("top_degree"), c("out_degree") / c("top_degree"), c("goal_in") / c("top_degree"), c("goal_out") / c("top_degree"),
        c("out_min") / c("top_travel"), c("out_mean") / c("top_travel"), c("in_mean") / c("top_travel"), c("out_cap") / c("top_cap"), c("in_cap") / c("top_cap"),
        c("out_blocked"), c("in_blocked"), c("top_travel"), c("mean_travel"), c("shut"), c("has_out"), c("has_in"), (c("node_id") == c("destination_id")).cast("double"),
    )
    return f.join(goal, "network").select("network", "destination_id", "node_id", *[v.alias(name) for v, name in zip(values, INPUTS, strict=True)])


def link_inputs(links: DataFrame, nodes: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """links with `inputs`: LINK_INPUTS and one for each of the classes, and `blocked`. links as for model_inputs, with length, speed, lanes and road_class."""
    x = _state(links)
    span = nodes.groupBy("network").agg(F.greatest(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")), F.lit(1.0)).alias("diagonal"))
    top = lambda c, least: F.greatest(F.max(c), F.lit(least)).alias(f"top_{c}")
    scale = x.groupBy("network").agg(top("speed", 1e-6), top("lanes", 1), top("travel", 1e-6), top("effective", 1e-6)).join(span, "network")
    values = [F.col("length") / F.col("diagonal"), *[F.col(c) / F.col(f"top_{c}") for c in ("speed", "lanes", "travel", "effective")], F.col("multiplier"), F.col("blockable").cast("double")]
    values += [(F.col("road_class") == name).cast("double") for name in classes]
    return x.join(scale, "network").select(*x.columns, F.array(*[v.cast("float") for v in values]).alias("inputs"))


def graph_samples(nodes: DataFrame, links: DataFrame, inputs: DataFrame, labels: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """One row for each network and destination: node_ids, node_features, edge_index (places of the links' ends), edge_features, blocked, targets, target_mask, destination.

    inputs: of model_inputs; labels: destination_id, node_id, cost (a node without one can't reach it). Nodes are in order of id, links by link_id. A
    row holds a network, as a sample must.
    """
    row = inputs.join(labels, ["destination_id", "node_id"], "left")
    row = row.select("network", "destination_id", F.struct("node_id", F.array(*[F.col(c).cast("float") for c in INPUTS]).alias("f"), F.col("cost").cast("float").alias("t")).alias("n"))
    of_nodes = row.groupBy("network", "destination_id").agg(F.array_sort(F.collect_list("n")).alias("n"))
    ids = nodes.groupBy("network").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
    at = lambda end: (F.array_position("ids", F.col(end)) - 1).cast("int").alias(end)
    e = link_inputs(links, nodes, classes).join(ids, "network").select("network", F.struct("link_id", at("src"), at("dst"), "blocked", "inputs").alias("e"))
    of_links = e.groupBy("network").agg(F.array_sort(F.collect_list("e")).alias("e"))
    x = of_nodes.join(of_links, "network")
    part = lambda xs, name: F.transform(xs, lambda v: v[name])
    return x.select(
        "network", "destination_id", part("n", "node_id").alias("node_ids"), part("n", "f").alias("node_features"), F.array(part("e", "src"), part("e", "dst")).alias("edge_index"), part("e", "inputs").alias("edge_features"),
        part("e", "blocked").alias("blocked"), F.transform("n", lambda v: F.coalesce(v["t"], F.lit(0.0).cast("float"))).alias("targets"), F.transform("n", lambda v: v["t"].isNotNull()).alias("target_mask"),
        (F.array_position(part("n", "node_id"), F.col("destination_id")) - 1).cast("int").alias("destination"),
    )


def padded_bytes(samples: int, nodes: int, edges: int, edge_features: int) -> int:
    """Bytes of a batch: 4 for each number, 1 for each mask."""
    return samples * (nodes * (4 * len(INPUTS) + 4 + 1 + 1) + edges * (4 * 2 + 4 * edge_features + 1 + 1) + 3 * 4)


_BATCH = (
    "batch string, validation boolean, networks array<long>, destinations array<long>, node_counts array<int>, edge_counts array<int>, max_nodes int, max_edges int, bytes long, node_features array<float>, edge_index array<int>, edge_features array<float>, "
    "blocked array<boolean>, targets array<float>, node_mask array<boolean>, edge_mask array<boolean>, target_mask array<boolean>, destination array<int>"
)


def _batch(rows: list, name: str, width: int) -> pd.DataFrame:
    n, m = max(len(r.node_ids) for r in rows), max(len(r.blocked) for r in rows)
    k = len(rows)
    nodes, index, edges = np.zeros((k, n, len(INPUTS)), np.float32), np.full((k, 2, m), -1, np.int32), np.zeros((k, m, width), np.float32)
    blocked, node_mask, edge_mask, target_mask, targets = (np.zeros(s, t) for s, t in (((k, m), bool), ((k, n), bool), ((k, m), bool), ((k, n), bool), ((k, n), np.float32)))
    for i, r in enumerate(rows):
        a, b = len(r.node_ids), len(r.blocked)
        nodes[i, :a], targets[i, :a], target_mask[i, :a], node_mask[i, :a] = np.stack(r.node_features), r.targets, r.target_mask, True
        index[i, :, :b], edges[i, :b], blocked[i, :b], edge_mask[i, :b] = np.stack(r.edge_index), np.stack(r.edge_features), r.blocked, True
    flat = {"node_features": nodes, "edge_index": index, "edge_features": edges, "blocked": blocked, "targets": targets, "node_mask": node_mask, "edge_mask": edge_mask, "target_mask": target_mask}
    row = {
        "batch": name, "validation": rows[0].validation, "networks": [r.network for r in rows], "destinations": [r.destination_id for r in rows], "node_counts": [len(r.node_ids) for r in rows], "edge_counts": [len(r.blocked) for r in rows],
        "max_nodes": n, "max_edges": m, "bytes": padded_bytes(k, n, m, width), "destination": [r.destination for r in rows],
    }
    return pd.DataFrame({c: [v] for c, v in (row | {c: v.ravel() for c, v in flat.items()}).items()})


def graph_batches(samples: DataFrame, held_out: DataFrame, most_bytes: int, classes: int) -> DataFrame:
    """Samples padded to batches whose building takes at most most_bytes (PEAK times their padded bytes); columns as in _BATCH, arrays flat in C order.

    held_out: network; their samples are in batches of their own (validation). Samples are sorted by that and by size into ranges, and a range fills
    one batch after another as it is read, so neighbours in a batch are of similar size. Padding is 0, false, and -1 for the ends of links. A sample too large
    for a batch of its own: ValueError.
    """
    width = len(LINK_INPUTS) + classes
    x = samples.join(held_out.select("network").distinct().withColumn("validation", F.lit(True)), "network", "left").fillna(False, ["validation"])
    order = ["validation", F.size("node_ids"), F.size("blocked"), "network", "destination_id"]
    x = x.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                n, m = (max([len(v(h)) for h in held] + [len(v(r))]) for v in (lambda h: h.node_ids, lambda h: h.blocked))
                if held and (held[0].validation != r.validation or PEAK * padded_bytes(len(held) + 1, n, m, width) > most_bytes):
                    yield _batch(held, f"{held[0].network}:{held[0].destination_id}", width)
                    held = []
                held.append(r)
                if PEAK * padded_bytes(1, len(r.node_ids), len(r.blocked), width) > most_bytes:
                    raise ValueError(f"the sample of network {r.network} is larger than a batch may be")
        if held:
            yield _batch(held, f"{held[0].network}:{held[0].destination_id}", width)

    return x.mapInPandas(run, _BATCH)
