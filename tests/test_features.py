"""The twenty inputs and the padded graph tensors, against arrays built one network at a time."""

import numpy as np
import pytest

from roadweave.operators import features, graph
from roadweave.queries import aggregates, datasets
from roadweave.sources.traffic import Traffic
from tests.test_operators import dijkstra

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def quarters(spark):
    nodes, links, goals = aggregates.quarters(Traffic(spark, SF))
    return nodes.collect(), links.collect(), {(r.network, r.destination_id) for r in goals.collect()}


def plain(network, goal, nodes, links):
    """Arrays of one sample, as float32."""
    n = sorted(r for r in nodes if r.network == network)
    n.sort(key=lambda r: r.node_id)
    e = sorted((r for r in links if r.network == network), key=lambda r: r.link_id)
    at = {r.node_id: i for i, r in enumerate(n)}
    shut = [r.capacity * r.multiplier <= 0 and r.blockable for r in e]
    xy = np.array([(r.x, r.y) for r in n])
    diagonal = max(float(np.hypot(*(xy.max(0) - xy.min(0)))), 1.0)
    travel = np.array([r.travel for r in e])
    out = [[k for k, r in enumerate(e) if at[r.src] == i] for i in range(len(n))]
    into = [[k for k, r in enumerate(e) if at[r.dst] == i] for i in range(len(n))]
    top_degree = max(max(map(len, out)), max(map(len, into)), 1)
    cap = lambda ks: sum(e[k].capacity * e[k].multiplier for k in ks)
    top_cap, top = max(*(cap(k) for k in out + into), 1e-6), travel.max()
    rows = []
    for i in range(len(n)):
        d = xy[i] - xy[at[goal]]
        uo, ui = ([travel[k] for k in ks if not shut[k]] for ks in (out[i], into[i]))
        part = lambda ks: np.mean([shut[k] for k in ks]) if ks else 0.0
        g = at[goal]
        rows.append([
            d[0] / diagonal, d[1] / diagonal, np.hypot(*d) / diagonal, len(into[i]) / top_degree, len(out[i]) / top_degree, len(into[g]) / top_degree, len(out[g]) / top_degree, min(uo, default=0) / top, (np.mean(uo) if uo else 0) / top,
            (np.mean(ui) if ui else 0) / top, cap(out[i]) / top_cap, cap(into[i]) / top_cap, part(out[i]), part(into[i]), top, travel.mean() / top, np.mean(shut), float(bool(uo)), float(bool(ui)), float(i == g),
        ])
    best = dijkstra([(k, at[r.src], at[r.dst], r.travel, shut[k]) for k, r in enumerate(e)], at[goal])
    targets = np.array([best.get(i, 0.0) for i in range(len(n))])
    reached = np.array([i in best for i in range(len(n))])
    tops = [max(r.speed for r in e), max(*(r.lanes for r in e), 1), top, max(*(r.capacity * r.multiplier for r in e), 1e-6)]
    edges = [[r.length / diagonal, r.speed / tops[0], r.lanes / tops[1], r.travel / tops[2], r.capacity * r.multiplier / tops[3], r.multiplier, float(r.blockable), float(r.road_class == "local"), float(r.road_class == "arterial")] for r in e]
    return np.array(rows), np.array([[at[r.src] for r in e], [at[r.dst] for r in e]]), np.array(edges), np.array(shut), targets, reached, at[goal]


@pytest.mark.parametrize("budget", [60_000, 400_000])
def test_batches(spark, quarters, budget):
    """Every sample is in one batch, with its own values in front and padding behind; batches keep the budget and don't mix held-out networks."""
    nodes, links, goals = quarters
    seen, held, kept = [], set(), set()
    batches = datasets.tensor_batches(Traffic(spark, SF), budget).collect()
    for b in batches:
        k, n, m = len(b.networks), b.max_nodes, b.max_edges
        width = len(features.LINK_INPUTS) + 2
        shape = {"node_features": (k, n, 20), "edge_index": (k, 2, m), "edge_features": (k, m, width), "blocked": (k, m), "targets": (k, n), "node_mask": (k, n), "edge_mask": (k, m), "target_mask": (k, n)}
        t = {c: np.array(b[c]).reshape(s) for c, s in shape.items()}
        assert b.bytes == sum(x.size * (1 if x.dtype == bool else 4) for x in t.values()) + 3 * 4 * k and 2 * b.bytes <= budget
        (held if b.validation else kept).update(b.networks)
        for i, key in enumerate(zip(b.networks, b.destinations, strict=True)):
            seen.append(key)
            x, index, edges, shut, targets, reached, goal = plain(*key, nodes, links)
            a, c = len(x), len(edges)
            assert (b.node_counts[i], b.edge_counts[i], b.destination[i]) == (a, c, goal)
            assert t["node_mask"][i].tolist() == [True] * a + [False] * (n - a) and t["edge_mask"][i].tolist() == [True] * c + [False] * (m - c)
            np.testing.assert_allclose(t["node_features"][i, :a], x, atol=1e-5)
            np.testing.assert_allclose(t["edge_features"][i, :c], edges, atol=1e-5)
            np.testing.assert_allclose(t["targets"][i, :a], targets, atol=1e-3)
            assert (t["edge_index"][i, :, :c] == index).all() and (t["blocked"][i, :c] == shut).all() and (t["target_mask"][i, :a] == reached).all()
            assert not t["node_features"][i, a:].any() and not t["target_mask"][i, a:].any() and (t["edge_index"][i, :, c:] == -1).all() and not t["edge_features"][i, c:].any()
    assert sorted(seen) == sorted(goals) and len(set(seen)) == len(seen)
    assert held and kept and not held & kept
    assert max(len(b.networks) for b in batches) > 1 and len(batches) > 2


def test_a_sample_too_large(spark):
    with pytest.raises(Exception, match="larger than a batch"):
        datasets.tensor_batches(Traffic(spark, "/root/testdata/sf0.001"), 1000).collect()


def test_inputs_of_odd_networks(spark):
    """A node without links, one place only, everything blocked, a destination that isn't there, and no rows."""
    nodes = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 4.0), (1, 3, 0.0, 0.0), (2, 9, 5.0, 5.0)], "network long, node_id long, x double, y double")
    links = spark.createDataFrame([(1, 1, 1, 2, 2.0, 0.0, 1.0, True)], "network long, link_id long, src long, dst long, travel double, capacity double, multiplier double, blockable boolean")
    goals = spark.createDataFrame([(1, 2), (1, 99), (2, 9)], "network long, destination_id long")
    got = {(r.destination_id, r.node_id): r for r in features.model_inputs(nodes, links, goals).collect()}
    assert set(got) == {(2, 1), (2, 2), (2, 3), (9, 9)}
    assert got[2, 1].outgoing_blocked_link_fraction == 1 and got[2, 1].has_usable_outgoing == 0 and got[2, 1].euclidean_distance_by_spatial_diagonal == 1
    assert got[2, 3].node_in_degree_by_max == 0 and got[9, 9].is_destination == 1 and got[9, 9].global_mean_travel_time_by_max == 0
    assert all(v is not None for r in got.values() for v in r)
    assert not features.model_inputs(nodes.where("false"), links, goals).collect()
    assert not graph.cost_to_go(links.select(links.src.alias("src_node_id"), links.dst.alias("dst_node_id"), links.travel.alias("cost"), links.blockable.alias("blocked")), goals.where("false").select("destination_id")).collect()
