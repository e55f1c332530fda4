"""Operators that SQL can't express, against plain Python on small tables."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import agents, flow, graph, spatial
from roadweave.plans import simulation
from roadweave.sources import files, osm
from roadweave.sources.traffic import Traffic

SF = "/root/testdata/sf0.001"


def network(seed: int, nodes: int = 7, links: int = 16):
    r = random.Random(seed)
    pairs = r.sample([(a, b) for a in range(nodes) for b in range(nodes) if a != b], links)
    return [(i, a, b, float(r.randint(1, 9)), r.random() < 0.15) for i, (a, b) in enumerate(pairs)]


def frames(spark, links):
    link = spark.createDataFrame(links, "link_id int, src_node_id int, dst_node_id int, cost double, blocked boolean")
    turns = [(a[0], b[0], a[2], a[1] == b[2]) for a in links for b in links if a[2] == b[1]]
    return link, spark.createDataFrame(turns, "from_link_id int, to_link_id int, node_id int, is_forbidden boolean"), turns


def dijkstra(links, goal):
    into = {}
    for _, a, b, c, blocked in links:
        if not blocked:
            into.setdefault(b, []).append((a, c))
    best, heap = {}, [(0.0, goal)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = d
        for a, c in into.get(n, []):
            heapq.heappush(heap, (d + c, a))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_cost_to_go(spark, seed):
    links = network(seed)
    link, _, _ = frames(spark, links)
    got = {(r["destination_id"], r["node_id"]): r["cost"] for r in graph.cost_to_go(link, spark.createDataFrame([(0,), (3,)], "destination_id int")).collect()}
    want = {(g, n): c for g in (0, 3) for n, c in dijkstra(links, g).items()}
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_ranked_paths_are_the_cheapest(spark, seed):
    links = network(seed)
    link, turn, turns = frames(spark, links)
    goals = spark.createDataFrame([(0,)], "destination_id int")
    ods = spark.createDataFrame([(n, n, 0) for n in range(1, 7)], "od_id int, origin_id int, destination_id int")
    got = {}
    for r in graph.ranked_paths(ods, link, turn, graph.cost_to_go(link, goals), 3, 6).collect():
        got.setdefault(r["od_id"], []).append(r["cost"])
    legal = {(a, b) for a, b, _, no in turns if not no}

    def walks(node, path, seen, cost):
        if node == 0 and path:
            yield cost
            return
        if len(path) == 6:
            return
        for i, a, b, c, blocked in links:
            if a == node and not blocked and b not in seen and (not path or (path[-1], i) in legal):
                yield from walks(b, [*path, i], seen | {b}, cost + c)

    for n in range(1, 7):
        assert got.get(n, []) == sorted(walks(n, [], {n}, 0.0))[:3]


def test_greedy_route_costs_its_potential(spark):
    t = Traffic(spark, SF)
    from roadweave.queries.graphs import network as net

    n = net(t)
    goals = spark.createDataFrame([(12,)], "destination_id int")
    costs = graph.cost_to_go(n, goals)
    ods = t.node().select(F.col("node_id").alias("od_id"), F.col("node_id").alias("origin_id"), F.lit(12).alias("destination_id")).where("origin_id <> 12")
    out = graph.greedy_routes(ods, n, t.turn(t.link()), costs, 24).collect()
    price = {r["link_id"]: r["cost"] for r in n.collect()}
    least = {r["node_id"]: r["cost"] for r in costs.collect()}
    legal = {(r[0], r[1]) for r in t.turn(t.link()).where("NOT is_forbidden").select("from_link_id", "to_link_id").collect()}
    assert len(out) == 24
    for r in out:
        if r["path"]:
            assert sum(price[x] for x in r["path"]) >= least[r["origin_id"]] - 1e-9
            assert all(p in legal for p in itertools.pairwise(r["path"]))


@pytest.mark.parametrize("seed", range(3))
def test_components_and_contraction(spark, seed):
    r = random.Random(seed)
    edges = sorted({tuple(sorted(r.sample(range(14), 2))) for _ in range(14)})
    rows = [(i, a, b, float(1 + i % 3)) for i, (a, b) in enumerate(edges)]
    df = spark.createDataFrame(rows, "edge_id long, u int, v int, length double")
    nodes = spark.createDataFrame([(n,) for n in range(14)], "node_id int")

    def parts(es):
        label = {n: n for n in range(14)}
        for _ in range(14):
            for _, a, b, _ in es:
                label[a] = label[b] = min(label[a], label[b])
        return label

    got = {x["node_id"]: x["root"] for x in graph.weak_components(nodes, df).collect()}
    assert got == parts(rows)
    chains = graph.contracted(df).collect()
    assert sum(c["n_edges"] for c in chains) == len(rows) and abs(sum(c["length"] for c in chains) - sum(e[3] for e in rows)) < 1e-9
    degree = {n: sum(n in e[1:3] for e in rows) for n in range(14)}
    for c in chains:
        assert c["u"] is None or degree[c["u"]] != 2 and degree[c["v"]] != 2


def test_token_arbitration_by_hand(spark):
    link = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 2.0), (3, 0.0, 1.0)], "link_id int, queue_vehicles double, capacity double")
    turn = spark.createDataFrame([(1, 3, 9, False, 1.0, 4.0), (2, 3, 9, False, 1.0, 4.0)], "from_link_id int, to_link_id int, node_id int, is_forbidden boolean, base_priority double, turn_demand double")
    got = {(r["from_link_id"], r["to_link_id"]): r["realized"] for r in flow.token_arbitration(turn, link).collect()}
    assert got == {(1, 3): 1, (2, 3): 0}  # one place ahead; of equal credits the first movement
    sinks = spark.createDataFrame([(1, 3.0)], "link_id int, demand double")
    out = {(r["from_link_id"], r["is_sink"]): r["realized"] for r in flow.token_arbitration(turn, link, sinks).collect()}
    assert out[1, True] == 2 and out[1, False] == 0 and out[2, False] == 1


def test_token_arbitration_keeps_its_bounds(spark):
    t = Traffic(spark, SF)
    link = t.link().select("link_id", "queue_vehicles", F.col("capacity_veh_per_tick").alias("capacity")).persist()
    out = flow.token_arbitration(t.turn(), link)
    sent = out.groupBy("from_link_id").agg(F.sum("realized").alias("n")).join(link, F.col("from_link_id") == F.col("link_id"))
    assert sent.where("n > capacity + 1e-9 OR n > queue_vehicles").isEmpty()
    came = out.where("NOT is_sink").groupBy("to_link_id").agg(F.sum("realized").alias("n")).join(link, F.col("to_link_id") == F.col("link_id"))
    assert came.where("n > capacity + 1e-9").isEmpty()


def test_reservations_equal_one_by_one(spark):
    r = random.Random(5)
    routes = [(od, c, r.uniform(0, 10), r.uniform(0.5, 4)) for od in range(5) for c in range(4)]
    demand = [(od, r.randint(0, 10)) for od in range(5)]
    got = {(x["od_id"], x["candidate_id"]): x["n"] for x in agents.reservations(spark.createDataFrame(routes, "od_id int, candidate_id int, base double, capacity double"), spark.createDataFrame(demand, "od_id int, demand int"), 2.0).collect()}
    for od, d in demand:
        own = {c: [b, k, 0] for o, c, b, k in routes if o == od}
        for _ in range(d):
            c = min(own, key=lambda c: (own[c][0] + 2.0 * (own[c][2] + 1) / own[c][1], c))
            own[c][2] += 1
        assert {c: v[2] for c, v in own.items()} == {c: got[od, c] for c in own}


def test_admission_stops_at_the_last_slot(spark):
    trips = spark.createDataFrame([(1, 7), (2, None), (3, 7), (4, 8), (5, None), (6, 8)], "trip_id int, link_id int")
    space = spark.createDataFrame([(7, 1.0), (8, 5.0)], "link_id int, space double")
    got = {r["trip_id"]: r["outcome"] for r in agents.admission(trips, space, 2).collect()}
    assert got == {1: "admitted", 2: "no_route", 3: "waiting", 4: "admitted", 5: "waiting", 6: "waiting"}


def test_nearest_pair(spark):
    r = random.Random(3)
    a = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(30)]
    b = [(100 + i, r.uniform(150, 300), r.uniform(0, 100)) for i in range(30)]
    schema = "node_id int, x double, y double"
    got = spatial.nearest_pair(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).first()
    assert tuple(got) == min(((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2, p[0], q[0]) for p in a for q in b)[1:]


def test_replay_and_pause(spark):
    from roadweave.queries import load

    assert tuple(load()[0]["replay"](spark, SF).first()) == (2, True)
    with pytest.raises(ValueError):
        simulation.Schedule(5, 2, 20)


OSM = """<osm><node id="1" lat="48.0" lon="2.0"/><node id="2" lat="48.001" lon="2.0"/><node id="3" lat="48.002" lon="2.0"/><node id="4" lat="48.001" lon="2.002"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/></way><way id="11"><nd ref="2"/><nd ref="4"/><tag k="highway" v="residential"/><tag k="oneway" v="yes"/></way>
<way id="12"><nd ref="1"/><nd ref="4"/><tag k="highway" v="footway"/></way></osm>"""


def test_osm(spark, tmp_path):
    path = tmp_path / "x.osm"
    path.write_text(OSM)
    for nodes, ways in (osm.read_osm(spark, str(path)), osm.parse_osm(spark, OSM)):
        road, links = osm.compile_roads(nodes, ways)
        got = sorted((r["u"], r["v"], r["road_class"]) for r in links.collect())
        assert got == [(1, 2, "arterial"), (2, 1, "arterial"), (2, 3, "arterial"), (2, 4, "local"), (3, 2, "arterial")]
        assert sorted(r["node_id"] for r in road.collect()) == [1, 2, 3, 4]
        assert all(100 < r["length_m"] < 160 for r in links.collect())
    with pytest.raises(ValueError):
        osm.parse_osm(spark, "<!DOCTYPE osm><osm/>")


def test_files(spark, tmp_path):
    df = files.fingerprinted(spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string"))
    files.write_labels(df, str(tmp_path / "labels"))
    back = files.read_report(spark, str(tmp_path / "labels"), "k int, name string")
    assert files.same_rows(df, back.select(*df.columns))
    changed = spark.createDataFrame([(1, "a", "x")], "k int, name string, fingerprint string")
    changed.write.json(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="changed"):
        files.read_report(spark, str(tmp_path / "bad"), "k int, name string").collect()
    assert files.read_budget(spark, None).first()["total_seconds"] == 960.0
