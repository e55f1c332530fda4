"""Components and bridges that are told within blocks of ids first, against plain Python; and how little is left for the rounds over the whole network."""

import random

import numpy as np
import pytest

from roadweave.operators import forest, graph, regions


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        if u in up and v in up and u is not None and v is not None:
            a, b = sorted((top(u), top(v)))
            up[b] = a
    return {n: top(n) for n in nodes}


def parting(edges):
    whole = lambda e: len({*roots({n for _, u, v in edges for n in (u, v)}, [(u, v) for _, u, v in e]).values()})
    return {x[0] for x in edges if x[1] != x[2] and whole([y for y in edges if y is not x]) > whole(edges)}


@pytest.mark.parametrize("seed", range(3))
def test_blocks_of_any_ids(spark, monkeypatch, seed):
    """Blocks of four ids, read in pieces of three edges; ids far apart and below 0, loops, parallel edges, ends that aren't among the nodes."""
    monkeypatch.setattr(regions, "BITS", 2)
    monkeypatch.setattr(regions, "EDGES", 3)
    r = random.Random(seed)
    ids = [*range(-7, 30), 2**62, 2**62 + 1, -(2**61)]
    near = lambda u: r.choice([x for x in ids if abs(x - u) < 6 or r.random() < 0.03])
    edges = [(k, u, near(u)) for k, u in enumerate(r.choices(ids, k=34))]
    edges += [(100 + k, u, v) for k, (_, u, v) in enumerate(edges[:3])]
    e = spark.createDataFrame(edges, "edge_id long, u long, v long")
    nodes = r.sample(ids, 33)
    found = graph.weak_components(spark.createDataFrame([(n,) for n in nodes], "node_id long"), e).collect()
    assert {x.node_id: x.root for x in found} == roots(nodes, [x[1:] for x in edges]) and len(found) == len(nodes)
    ways = forest.bridges(e).collect()
    assert sorted(x.edge_id for x in ways) == sorted(parting(edges))


def test_little_is_left_of_a_long_network(spark, monkeypatch):
    """A ladder of 3,000 rungs with a dead end at each tenth: what goes through the rounds is what crosses between blocks, not the network."""
    monkeypatch.setattr(regions, "BITS", 10)
    n = 3000
    edges = [(k, 2 * k, 2 * k + 1) for k in range(n)] + [(n + 2 * k + s, 2 * k + s, 2 * k + 2 + s) for k in range(n - 1) for s in (0, 1)]
    edges += [(3 * n + k, 20 * k, 2 * n + k) for k in range(n // 10)]
    e = spark.createDataFrame(edges, "edge_id long, u long, v long")
    sizes, kept = [], {m: getattr(*m) for m in ((graph, "_labelled"), (forest, "_marked_bridges"))}
    monkeypatch.setattr(graph, "_labelled", lambda nodes, left: sizes.append(left.count()) or kept[graph, "_labelled"](nodes, left))
    monkeypatch.setattr(forest, "_marked_bridges", lambda left: sizes.append(left.count()) or kept[forest, "_marked_bridges"](left))
    nodes = spark.range(2 * n + n // 10 + 1).withColumnRenamed("id", "node_id")
    found = {x.node_id: x.root for x in graph.weak_components(nodes, e).collect()}
    assert set(found.values()) == {0, 2 * n + n // 10} and len(found) == 2 * n + n // 10 + 1
    assert sorted(x.edge_id for x in forest.bridges(e).collect()) == [3 * n + k for k in range(n // 10)]
    assert max(sizes) < 700 < len(edges) // 10


def test_least_labels():
    r = np.random.default_rng(1)
    for n in (1, 5, 60):
        u, v = r.integers(0, n, n // 2), r.integers(0, n, n // 2)
        want = roots(range(n), zip(u.tolist(), v.tolist(), strict=True))
        assert regions.least_labels(n, u, v).tolist() == [want[k] for k in range(n)]
