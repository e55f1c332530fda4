"""Spanning forests, thinning, bridges, planar graphs, ranked paths and distributed ranks against plain Python."""

import heapq
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from roadweave.operators import forest, graph, planar, ranks, rings, spatial
from tests.test_operators import dijkstra


def parts(nodes, edges):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            label[n] = label[label[n]]
            n = label[n]
        return n

    for _, a, b in edges:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def some_edges(seed, nodes=14, edges=16):
    r = random.Random(seed)
    rows = [(i, *r.sample(range(nodes), 2)) for i in range(edges)]
    return [*rows, (edges, 3, 3), (edges + 1, rows[0][2], rows[0][1])]  # a loop, and one street twice


def edge_frame(spark, rows):
    return spark.createDataFrame(rows, "edge_id long, u long, v long")


@pytest.mark.parametrize("seed", range(3))
def test_forest_is_kruskals(spark, seed):
    rows = some_edges(seed)
    got = {r.edge_id for r in forest.spanning_forest(edge_frame(spark, rows), F.col("edge_id") % 4).collect()}
    want, kept = set(), []
    for e in sorted(rows, key=lambda e: (e[0] % 4, e[0])):
        p = parts(range(14), kept)
        if p[e[1]] != p[e[2]]:
            kept.append(e)
            want.add(e[0])
    assert got == want


@pytest.mark.parametrize(("seed", "fraction"), [(0, 0.2), (1, 0.9), (2, 0.0)])
def test_thinning_is_one_by_one(spark, seed, fraction):
    """As if each street in turn were removed and put back if the rest falls apart."""
    rows = [e for e in some_edges(seed, edges=30) if e[1] != e[2]]
    df = edge_frame(spark, rows)
    order = [r.edge_id for r in df.orderBy(F.xxhash64(F.lit(7), "edge_id"), "edge_id").collect()]
    left, target = {e[0]: e for e in rows}, int(len(rows) * fraction)
    whole = len(set(parts(range(14), rows).values()))
    for i in order:
        if len(rows) - len(left) >= target:
            break
        rest = [e for k, e in left.items() if k != i]
        if len(set(parts(range(14), rest).values())) == whole:
            del left[i]
    got = forest.thinned(df, fraction, 7)
    assert got.columns == ["edge_id", "u", "v", "kept"]
    assert {r.edge_id for r in got.where("kept").collect()} == set(left) and got.count() == len(rows)
    with pytest.raises(ValueError):
        forest.thinned(df, 1.0, 7)


@pytest.mark.parametrize(("seed", "edges"), [(0, 14), (1, 18), (2, 10), (3, 40)])
def test_bridges(spark, seed, edges, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 4)
    rows = some_edges(seed, edges=edges)
    got = sorted(r.edge_id for r in forest.bridges(edge_frame(spark, rows)).collect())
    n = len(set(parts(range(14), rows).values()))
    assert got == [e[0] for e in rows if len(set(parts(range(14), [x for x in rows if x != e]).values())) > n]


def test_empty_networks(spark):
    none = edge_frame(spark, [])
    assert not forest.spanning_forest(none, F.lit(0)).collect()
    assert not forest.bridges(none).collect() and not forest.thinned(none, 0.5, 1).collect()


def test_rings(spark):
    r = random.Random(4)
    ids = list(range(40))
    r.shuffle(ids)
    cycles = [ids[:1], ids[1:3], ids[3:10], ids[10:]]
    steps = [(c[i], c[i - 1]) for c in cycles for i in range(len(c))]
    got = {x.h: (x.ring, x["at"]) for x in rings.rings(spark.createDataFrame(steps, "h long, prev long")).collect()}
    for c in cycles:
        k = c.index(min(c))
        assert all(got[h] == (min(c), (i - k) % len(c)) for i, h in enumerate(c))


def test_ranks(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(5), r.choice("abc")) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a int, b string").repartition(5)
    got = {x.i: (x["rank"], x.n) for x in ranks.ranked(df, F.desc("a"), "b", "i", total="n").collect()}
    assert got == {x[0]: (k, 200) for k, x in enumerate(sorted(rows, key=lambda x: (-x[1], x[2], x[0])), 1)}
    assert not ranks.ranked(df.where("i < 0"), "i").collect()


def test_compressed_rows(spark):
    """Nodes without links, several links between two nodes, a loop; links of unknown nodes are refused."""
    nodes = spark.createDataFrame([(5,), (9,), (7,), (3,), (11,)], "node_id long")
    links = [(1, 9, 5), (2, 9, 5), (3, 3, 9), (4, 9, 9), (5, 7, 3)]
    df = spark.createDataFrame(links, "link_id long, src long, dst long")
    by_node, by_link = graph.compressed(nodes, df)
    order, index = sorted([3, 5, 7, 9, 11]), {n: i for i, n in enumerate(sorted([3, 5, 7, 9, 11]))}
    out, into = (sorted(links, key=lambda e: (e[k], e[0])) for k in (1, 2))
    got = {r.link_id: (r.src_index, r.dst_index, r.out_at, r.in_at) for r in by_link.collect()}
    assert got == {e[0]: (index[e[1]], index[e[2]], out.index(e), into.index(e)) for e in links}
    for r in by_node.collect():
        assert r.node_index == index[r.node_id]
        assert [e[0] for e in out[r.out_begin : r.out_end]] == [e[0] for e in out if e[1] == r.node_id]
        assert [e[0] for e in into[r.in_begin : r.in_end]] == [e[0] for e in into if e[2] == r.node_id]
    assert len(order) == by_node.count()
    with pytest.raises(ValueError):
        graph.compressed(nodes.where("node_id <> 7"), df)


# --- planar graphs ----------------------------------------------------------


def test_cells_along_a_segment(spark):
    """Every cell that points of a segment lie in, and far fewer than its box has."""
    r = random.Random(2)
    segs = [(i, *[r.uniform(-900, 900) for _ in range(4)]) for i in range(30)] + [(30, 5.0, -700.0, 5.0, 700.0), (31, -700.0, 5.0, 700.0, 5.0), (32, 0.0, 0.0, 0.0, 0.0), (33, -800.0, -800.0, 800.0, 800.0)]
    df = spark.createDataFrame(segs, "segment_id int, ax double, ay double, bx double, by double")
    got = {}
    for x in spatial.segment_cells(df, 50.0).select("segment_id", "cx", "cy").collect():
        got.setdefault(x.segment_id, set()).add((x.cx, x.cy))
    for i, ax, ay, bx, by in segs:
        on = {(math.floor((ax + k / 500 * (bx - ax)) / 50), math.floor((ay + k / 500 * (by - ay)) / 50)) for k in range(501)}
        assert on <= got[i] and len(got[i]) <= 3 * len(on) + 6


def streets_frame(spark, rows):
    return spark.createDataFrame(rows, "street_id long, ax long, ay long, bx long, by long, layer int")


def side(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def meetings(pieces):
    """Pairs of pieces of a layer that cross inside, and ends that lie on another's inside."""
    out = 0
    for p, q in itertools.permutations(pieces, 2):
        if p.layer != q.layer:
            continue
        a, b, c, d = (p.ax, p.ay), (p.bx, p.by), (q.ax, q.ay), (q.bx, q.by)
        out += side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
        for e in (c, d):
            along = (e[0] - a[0]) * (b[0] - a[0]) + (e[1] - a[1]) * (b[1] - a[1])
            out += side(a, b, e) == 0 and 0 < along < (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    return out


def test_planarise_by_hand(spark):
    """A cross, a T, an overlap, a bridge above, a street without length and one without a place."""
    rows = [(1, 0, 0, 10_000, 0, 0), (2, 5000, -5000, 5000, 5000, 0), (3, 2000, 0, 2000, 3000, 0), (4, 8000, 0, 12_000, 0, 0), (5, 0, -1000, 10_000, 1000, 1), (6, 7, 7, 7, 7, 0), (7, None, 0, 1, 1, 0)]
    pieces, nodes = planar.planarise(streets_frame(spark, rows), 3000.0)
    got = sorted((x.ax, x.ay, x.bx, x.by, x.street_id, list(x.streets), x.layer) for x in pieces.collect())
    assert got == [
        (0, -1000, 10_000, 1000, 5, [5], 1), (0, 0, 2000, 0, 1, [1], 0), (2000, 0, 2000, 3000, 3, [3], 0), (2000, 0, 5000, 0, 1, [1], 0), (5000, -5000, 5000, 0, 2, [2], 0),
        (5000, 0, 5000, 5000, 2, [2], 0), (5000, 0, 8000, 0, 1, [1], 0), (8000, 0, 10_000, 0, 1, [1, 4], 0), (10_000, 0, 12_000, 0, 4, [4], 0),
    ]
    places = {x.node_id: (x.x, x.y, x.layer) for x in nodes.collect()}
    assert sorted(places) == list(range(len(places))) and len(set(places.values())) == len(places)
    assert all(places[x.u] == (x.ax, x.ay, x.layer) and places[x.v] == (x.bx, x.by, x.layer) for x in pieces.collect())
    assert not planar.planarise(streets_frame(spark, []), 10.0)[0].collect()


def walked(pieces):
    """Faces by walking half-edges one by one."""
    around, place = {}, {}
    for p in pieces:
        place[p.u], place[p.v] = (p.ax, p.ay), (p.bx, p.by)
        around.setdefault(p.u, []).append((math.atan2(p.by - p.ay, p.bx - p.ax), p.v, p.piece_id))
        around.setdefault(p.v, []).append((math.atan2(p.ay - p.by, p.ax - p.bx), p.u, p.piece_id))
    for n in around:
        around[n] = [x[1] for x in sorted(around[n])]
    seen, faces = set(), []
    for start in ((n, m) for n in around for m in around[n]):
        if start in seen:
            continue
        walk, (n, m) = [], start
        while (n, m) not in seen:
            seen.add((n, m))
            walk.append(n)
            i = around[m].index(n)
            n, m = m, around[m][i - 1]
        faces.append(walk)
    return faces, place


def area2(ring, place):
    return sum(place[a][0] * place[b][1] - place[b][0] * place[a][1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def simple(walk):
    """A walk cut into rings without a node twice."""
    first = {}
    for i, n in enumerate(walk):
        if n in first:
            return simple(walk[first[n] : i]) + simple(walk[: first[n]] + walk[i:])
        first[n] = i
    return [walk]


@pytest.mark.parametrize("seed", range(4))
def test_faces_and_blocks(spark, seed):
    """Planar and whole: no meeting is left, Euler's formula holds, faces and blocks are those of a walk."""
    r = random.Random(seed)
    if seed == 3:  # rings in rings that touch in a node, and streets that end inside
        rows = [(0, 0, 0, 90, 0), (1, 90, 0, 90, 90), (2, 90, 90, 0, 90), (3, 0, 90, 0, 0), (4, 0, 0, 30, 20), (5, 30, 20, 20, 30), (6, 20, 30, 0, 0), (7, 90, 90, 70, 60), (8, 70, 60, 60, 60), (9, 60, 60, 60, 50), (10, 60, 50, 70, 60), (11, 40, 0, 40, 10)]
        rows = [(i, *[1000 * c for c in p], 0) for i, *p in rows]
    else:
        rows = [(i, *[r.randrange(0, 60) * 500 for _ in range(4)], int(r.random() < 0.1)) for i in range(25)]
    pieces, nodes = planar.planarise(streets_frame(spark, rows), 4000.0)
    made = pieces.collect()
    assert not meetings(made)
    edges = pieces.withColumnRenamed("piece_id", "edge_id")
    faces, place = walked(made)
    got = planar.faces(edges).collect()
    assert sorted((f.n_edges, f.twice_area) for f in got) == sorted((len(w), area2(w, place)) for w in faces)
    n_parts = len(set(parts(place, [(0, p.u, p.v) for p in made]).values()))
    assert nodes.count() - len(made) + len(got) == 2 * n_parts
    rings_ = [w for f in faces for w in simple(f) if len(w) >= 3 and area2(w, place) > 0]
    blocks = planar.blocks(edges).collect()
    assert sorted(b.twice_area for b in blocks) == sorted(area2(w, place) for w in rings_)
    turned = {min(tuple(w[i:] + w[:i]) for i in range(len(w))) for w in ([place[n] for n in ring] for ring in rings_)}
    assert {min(tuple(w[i:] + w[:i]) for i in range(len(w))) for w in ([(p.x, p.y) for p in b.ring] for b in blocks)} == turned
    assert all(b.n_edges == len(b.ring) == len(b.edge_ids) for b in blocks)


@pytest.mark.parametrize("seed", range(4))
def test_cuts_of_new_pieces_only(spark, seed):
    """Later passes compare what the last one split; nothing that meets is missed, and every pair is told once for both."""
    r = random.Random(seed)
    rows = [(i, *[r.randrange(0, 40) * 250 for _ in range(4)], int(r.random() < 0.2)) for i in range(30)]
    first = streets_frame(spark, rows).selectExpr("cast(street_id AS string) AS segment_id", "ax", "ay", "bx", "by", "layer").where("ax <> bx OR ay <> by")
    then = planar.split(first, planar.cuts(first, 4000.0, 20)).cache()
    assert {x.new for x in then.collect()} == {True, False}
    assert sorted(planar.cuts(then, 4000.0, 20).collect()) == sorted(planar.cuts(then.drop("new"), 4000.0, 20).collect())


@pytest.mark.parametrize("top", [13_500_000_000, 9 * 10**14])
def test_area_of_a_walk_far_from_the_origin(spark, top):
    """A walk's products, or their sum, pass 64 bits on the way; its area doesn't."""
    wide, n = 4_000_000, 400
    corners = [(0 if i % 2 == 0 else wide, top + 100 * i) for i in range(2 * n)] + [(wide, top + 200 * n + i % 7) for i in range(2)]
    walk = list(zip(corners, corners[1:] + corners[:1], strict=True))
    walk.sort(key=lambda e: e[0][0] >= e[1][0])  # sums may come in any order
    rows = spark.createDataFrame([(*a, *b) for a, b in walk], "ax long, ay long, bx long, by long").coalesce(1)
    assert rows.agg(planar.twice_area()).head()[0] == sum(a[0] * b[1] - b[0] * a[1] for a, b in walk)


# --- ranked paths -----------------------------------------------------------


def searched(links, turns, origin, goal, k, hops, bound):
    """Best first, one partial path at a time."""
    rest = dijkstra(links, goal)
    legal = {(a, b) for a, b, _, no in turns if not no}
    out = {}
    for i, a, b, c, blocked in links:
        if not blocked:
            out.setdefault(a, []).append((i, b, c))
    heap, found, looked = [(rest[origin], 0.0, [], origin, {origin})] if origin in rest else [], [], 0
    while heap and len(found) < k and looked < bound:
        _, cost, path, node, seen = heapq.heappop(heap)
        looked += 1
        if node == goal:
            found.append((cost, path))
            continue
        for i, to, c in out.get(node, []) if len(path) < hops else []:
            if to in rest and to not in seen and (not path or (path[-1], i) in legal):
                heapq.heappush(heap, (cost + c + rest[to], cost + c, [*path, i], to, seen | {to}))
    return found, bool(heap) and len(found) < k


@pytest.mark.parametrize("bound", [None, 12])
def test_ranked_paths_on_a_city(spark, bound):
    """2,100 links: the same paths in the same order as the search one by one, and the ods that met the bound."""
    r, side_ = random.Random(6), 23
    pairs = [(x + side_ * y, x + dx + side_ * (y + dy)) for x in range(side_) for y in range(side_) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1)) if 0 <= x + dx < side_ and 0 <= y + dy < side_]
    pairs += [(r.randrange(side_**2), r.randrange(side_**2)) for _ in range(100)]
    links = [(i, a, b, float(r.randint(1, 9)) + i / 8192, r.random() < 0.05) for i, (a, b) in enumerate(pairs) if a != b]
    assert len(links) > 2000
    link, turn, turns = frames_of(spark, links)
    goals = (0, 264)
    ods = [(10_000 * g + n, n, g) for g in goals for n in r.sample(range(side_**2), 8)] + [(1, 0, 0)]
    costs = graph.cost_to_go(link, spark.createDataFrame([(g,) for g in goals], "destination_id int"))
    got, met = {}, set()
    for x in graph.ranked_paths(spark.createDataFrame(ods, "od_id int, origin_id int, destination_id int"), link, turn, costs, 3, 30, bound).collect():
        if x["rank"] is not None:
            got.setdefault(x.od_id, {})[x["rank"]] = (x.cost, list(x.path))
        if x.met_bound:
            met.add(x.od_id)
    limit = bound or 3 * max(16, 4 * len(links))
    flagged = 0
    for i, a, b in ods:
        want, full = searched(links, turns, a, b, 3, 30, limit) if a != b else ([], False)
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want
        assert (i in met) == full
        flagged += full
    assert bool(flagged) == bool(bound)


def frames_of(spark, links):
    out = {}
    for x in links:
        out.setdefault(x[1], []).append(x)
    turns = [(a[0], b[0], a[2], a[1] == b[2]) for a in links for b in out.get(a[2], [])]
    link = spark.createDataFrame(links, "link_id int, src_node_id int, dst_node_id int, cost double, blocked boolean")
    return link, spark.createDataFrame(turns, "from_link_id int, to_link_id int, node_id int, is_forbidden boolean"), turns


# --- hubs, long boxes, and cycles followed by blocks ----------------------------


@pytest.mark.parametrize(("most", "waves"), [(64, 16), (1, 3)])
def test_reachability_through_hubs(spark, most, waves):
    """Whatever the waves settle, the pairs are those of plain searches; a hub, a chain of hubs and cycles of one-way edges among the networks."""
    r = random.Random(most + waves)
    edges = {(r.randrange(30), r.randrange(30)) for _ in range(34)} | {(100 + k, 150) for k in range(9)} | {(150, 160 + k) for k in range(9)} | {(150, 151), (151, 152), (152, 170), (152, 171)} | {(k, (k + 1) % 5 + 200) for k in range(200, 205)}
    out = {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
    nodes = sorted({n for e in edges for n in e})

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for v in out.get(todo.pop(), []):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen

    pairs = [(a, b) for a in nodes for b in nodes if (a + b) % 3 or a > 90] + [(999, 999), (999, 1)]
    got = graph.reachable_pairs(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(sorted(edges), "u long, v long"), most, waves).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, b in reach(a)) for a, b in pairs)


def test_pairs_of_all_orders(spark):
    """directed_reachability asks for every order and the next one, whatever their status; a pair with a null isn't reached."""
    from roadweave.queries import graphs
    from roadweave.sources.traffic import Traffic

    orders = sorted((o.o_orderkey, o.o_custkey) for o in spark.read.parquet("/root/testdata/sf0.001/orders.parquet").collect())
    got = graphs.directed_reachability(Traffic(spark, "/root/testdata/sf0.001")).collect()
    assert sorted((x.a, x.b) for x in got) == sorted({(a, b) for (k, a), (n, b) in itertools.pairwise(orders) if n == k + 1})
    got = graph.reachable_pairs(spark.createDataFrame([(1, 2), (None, 2), (1, None), (None, None)], "a long, b long"), spark.createDataFrame([(1, 2)], "u long, v long")).collect()
    assert [x.reached for x in got if x.a and x.b] == [True] and [x.reached for x in got if not (x.a and x.b)] == [False] * 3


def test_starts_are_not_followed_through_a_hub(spark, monkeypatch):
    """Many starts lead to a hub that leads to many places: no table holds a row for each start and place."""
    sizes = []

    def counted(df, cut=graph.cut):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    edges = [(k, 0) for k in range(1, 101)] + [(0, k) for k in range(101, 201)]
    got = graph.reachable_pairs(spark.createDataFrame([(k, k + 100) for k in range(1, 101)], "a long, b long"), spark.createDataFrame(edges, "u long, v long"))
    assert all(x.reached for x in got.collect()) and max(sizes) <= 2 * len(edges)


def test_nearest_in_a_long_box_takes_small_cells(spark, monkeypatch):
    """A strip of 1 by 4,000: about a target a cell, so a point meets few of them."""
    sizes = []

    def first(low, high, n=4000):
        return [(k, float(k % 4) * 0.25, float(k)) for k in range(low, high)]

    def counted(df):
        out = cut(df)
        plan = df._jdf.queryExecution().logical().toString()
        sizes.extend(float(x) for x in re.findall(r"/ (\d+\.\d+)", plan))
        return out

    cut = spatial.cut
    monkeypatch.setattr(spatial, "cut", counted)
    points = spark.createDataFrame([(k, k, x + 0.1, y) for k, x, y in first(0, 4000, 40)][::40], "g long, node_id long, x double, y double")
    targets = spark.createDataFrame(first(0, 4000), "node_id long, x double, y double")
    got = spatial.nearest(points, targets, "g").collect()
    assert sorted((x.a, x.b) for x in got) == [(k, k) for k in range(0, 4000, 40)] and min(sizes) < 2


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_rings_by_blocks(spark, block):
    """Cycles within a block, over some, and over all of them."""
    r = random.Random(block)
    ids = r.sample(range(10**6), 300)
    bounds = [0, 1, 3, 4, 10, 60, 63, 64, 300]
    cycles = [ids[a:b] for a, b in itertools.pairwise(bounds)]
    steps = [(c[i], c[i - 1]) for c in cycles for i in range(len(c))]
    place = {h: i for i, h in enumerate(ids)}
    df = spark.createDataFrame([(h, p, place[h]) for h, p in steps], "h long, prev long, place long")
    for near in ("h", F.col("place")):
        got = {x.h: (x.ring, x["at"]) for x in rings.rings(df, near, block).collect()}
        assert len(got) == 300
        for c in cycles:
            k = c.index(min(c))
            assert all(got[h] == (min(c), (i - k) % len(c)) for i, h in enumerate(c))


def test_a_long_cycle_is_followed_in_blocks(spark, monkeypatch):
    """Steps next to each other are one chain: only chains are joined, not every step in every round."""
    rows = []

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    cut = rings.cut
    monkeypatch.setattr(rings, "cut", counted)
    n = 4000
    df = spark.createDataFrame([(k, (k - 1) % n) for k in range(n)], "h long, prev long")
    got = rings.rings(df, "h", 1000).collect()
    assert sorted((x.h, x.ring, x["at"]) for x in got) == [(k, 0, k) for k in range(n)] and sum(rows) < 3 * n


# --- queries on the street network ------------------------------------------


def test_street_queries_grow_with_the_tables(spark):
    """None is empty, and none has the same rows at another scale."""
    from roadweave.queries import load

    queries = load()[0]
    for name in ("weak_components", "component_order", "connectivity_repair", "degree_two_contraction", "graph_bridges", "planar_pieces"):
        small, large = (queries[name](spark, f"/root/testdata/{sf}").count() for sf in ("sf0.001", "sf0.01"))
        assert 0 < small < large, name


def test_streets_split_once_as_in_sql(spark, tmp_path):
    """Where a second pass finds a meeting: pieces and faces are those of one pass, as their SQL says; blocks take all."""
    duckdb = pytest.importorskip("duckdb")
    from roadweave.queries import graphs, load
    from roadweave.sources.traffic import Traffic

    spark.read.parquet("/root/testdata/sf0.1/customer.parquet").where("c_custkey BETWEEN 720 AND 1080").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for name in ("region", "nation", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    found, sql = load()
    for name in ("planar_pieces", "planar_faces"):
        rows = con.execute(sql[name])
        columns = [c[0] for c in rows.description]
        assert sorted(map(tuple, found[name](spark, str(tmp_path)).select(columns).collect())) == sorted(rows.fetchall()), name
    t = Traffic(spark, str(tmp_path))
    key = lambda p: (p.layer, p.ax, p.ay, p.bx, p.by)
    once, whole = ({key(p): list(p.streets) for p in graphs.planar(t, n).collect()} for n in (1, None))
    assert once != whole


def test_street_blocks_and_thinning(spark):
    """The registered queries that have no SQL."""
    from roadweave.queries import graphs
    from roadweave.sources.traffic import Traffic

    t = Traffic(spark, "/root/testdata/sf0.001")
    pieces = graphs.planar(t).collect()
    faces, place = walked_by_layer(pieces)
    want = sorted(area2(w, place) / 2e6 for f in faces for w in simple(f) if len(w) >= 3 and area2(w, place) > 0)
    got = graphs.city_blocks(t).collect()
    assert sorted(b.area_m2 for b in got) == want and len(got) > 20
    streets = {(min(p.u, p.v), max(p.u, p.v)): list(p.streets) for p in pieces}
    by_place = {xy: n for n, xy in place.items()}
    for b in got:
        ring = [by_place[p.x, p.y] for p in b.ring]
        front = {s for n, m in zip(ring, ring[1:] + ring[:1], strict=True) for s in streets.get((min(n, m), max(n, m)), [])}
        assert front <= set(b.frontage)
    rows = [(r.edge_id, r.u, r.v, r.kept) for r in graphs.null_thinning(t).collect()]
    nodes = {n for r in rows for n in r[1:3]}
    assert len(set(parts(nodes, [r[:3] for r in rows]).values())) == len(set(parts(nodes, [r[:3] for r in rows if r[3]]).values()))
    spare = len(rows) - len(nodes) + len(set(parts(nodes, [r[:3] for r in rows]).values()))
    assert sum(not r[3] for r in rows) == min(spare, len(rows) // 3)


def walked_by_layer(pieces):
    """Faces of each layer; places of layers that share a place are told apart by their nodes."""
    faces, place = [], {}
    for layer in {p.layer for p in pieces}:
        f, at = walked([p for p in pieces if p.layer == layer])
        faces += f
        place |= at
    return faces, place
