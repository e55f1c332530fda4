"""Clipping and simplifying against plain Python, and roads of a clipped map."""

import random

import numpy as np
import pytest

from roadweave.operators import lines
from roadweave.sources import osm
from tests.test_operators import OSM

KIND = "line_id int, points array<struct<x: double, y: double>>"


def sampled(points, bounds, n=400):
    """Runs of points of a line inside the box, by going along it in small steps."""
    runs, inside = [], False
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        for k in range(n + 1):
            x, y = ax + k / n * (bx - ax), ay + k / n * (by - ay)
            now = bounds[0] <= x <= bounds[2] and bounds[1] <= y <= bounds[3]
            if now and not inside:
                runs.append([])
            if now:
                runs[-1].append((x, y))
            inside = now
    return [r for r in runs if len(set(r)) > 3]


def test_clip(spark):
    r, box = random.Random(3), (0.0, 0.0, 10.0, 6.0)
    rows = [(i, [(r.uniform(-5, 15), r.uniform(-5, 11)) for _ in range(r.randint(1, 6))]) for i in range(80)]
    rows += [(100, [(2.0, 3.0), (4.0, 3.0)]), (101, [(-1.0, 3.0), (11.0, 3.0)]), (102, [(2.0, -1.0), (2.0, 7.0)]), (103, [(-1.0, 8.0), (12.0, 8.0)]), (104, [(-2.0, -2.0), (-1.0, 9.0)]), (105, []), (106, [(5.0, 3.0), (5.0, 9.0), (7.0, 9.0), (7.0, 3.0)]), (107, None), (108, [(0.0, 0.0), (10.0, 0.0)])]
    got = {}
    for x in lines.clip(spark.createDataFrame(rows, KIND), box).collect():
        got.setdefault(x.line_id, {})[x.fragment] = ([(p.x, p.y) for p in x.points], x.cut_start, x.cut_end)
    assert [got[106][k][1:] for k in (0, 1)] == [(False, True), (True, False)] and got[101][0] == ([(0.0, 3.0), (10.0, 3.0)], True, True)
    assert not {103, 104, 105, 107} & set(got) and got[100] == {0: ([(2.0, 3.0), (4.0, 3.0)], False, False)}
    for i, points in rows:
        runs = sampled(points or [], box)
        mine = [got.get(i, {})[k][0] for k in sorted(got.get(i, {}))]
        # a stretch too short for the samples may be missing there
        mine = [m for m in mine if sum(np.hypot(bx - ax, by - ay) for (ax, ay), (bx, by) in zip(m, m[1:], strict=False)) > 0.3]
        runs = [q for q in runs if sum(np.hypot(bx - ax, by - ay) for (ax, ay), (bx, by) in zip(q, q[1:], strict=False)) > 0.2]
        assert len(mine) <= len(got.get(i, {})) and abs(len(mine) - len(runs)) <= 1
        if len(mine) == len(runs):
            for m, q in zip(mine, runs, strict=True):
                assert np.hypot(*(np.array(m[0]) - q[0])) < 0.1 and np.hypot(*(np.array(m[-1]) - q[-1])) < 0.1
    with pytest.raises(ValueError):
        lines.clip(spark.createDataFrame(rows, KIND), (0, 0, 0, 1))


def farthest(points, a, b):
    chord = points[b] - points[a]
    out = []
    for k in range(a + 1, b):
        t = np.clip((points[k] - points[a]) @ chord / (chord @ chord), 0, 1) if chord @ chord else 0.0
        out.append(np.hypot(*(points[k] - points[a] - t * chord)))
    return out


def recursive(points, a, b, tolerance):
    away = farthest(points, a, b)
    if not away or max(away) <= tolerance:
        return [a, b]
    k = a + 1 + int(np.argmax(away))
    return recursive(points, a, k, tolerance)[:-1] + recursive(points, k, b, tolerance)


def test_simplify(spark):
    r = random.Random(4)
    rows = [(i, [(float(r.randrange(20)), float(r.randrange(20))) for _ in range(r.randint(2, 30))]) for i in range(60)] + [(90, []), (91, None), (92, [(1.0, 1.0)] * 5)]
    df = spark.createDataFrame(rows, KIND)
    for tolerance in (0.5, 3.0, 100.0):
        got = {x.line_id: None if x.points is None else [(p.x, p.y) for p in x.points] for x in lines.simplify(df, tolerance).collect()}
        for i, points in rows:
            if points is None or len(points) < 3:
                assert got[i] == points
                continue
            xy = np.array(points)
            assert got[i] == [points[k] for k in recursive(xy, 0, len(xy) - 1, tolerance)]
    assert lines.simplify(df, 0.0) is df
    with pytest.raises(ValueError):
        lines.simplify(df, -1.0)


def test_roads_in_a_box(spark):
    """Half of the map: cut roads end in nodes of their own, which both directions share."""
    nodes, ways = osm.parse_osm(spark, OSM)
    road, links = (x.collect() for x in osm.compile_roads(nodes, ways))
    place = {r.node_id: (r.x, r.y) for r in road}
    middle = sum(y for _, y in place.values()) / len(place)
    box = (-1e6, middle - 30.0, 1e6, 1e6)
    some, cut = (x.collect() for x in osm.compile_roads(nodes, ways, box))
    assert all(r.y >= box[1] - 1e-6 for r in some) and any(r.node_id < 0 for r in some)
    assert {x for r in cut for x in (r.u, r.v)} == {r.node_id for r in some}
    assert sum(r.length_m for r in cut) < sum(r.length_m for r in links)
    both = {(r.u, r.v) for r in cut if r.road_class == "arterial"}
    assert both == {(v, u) for u, v in both}
    with pytest.raises(ValueError):
        osm.compile_roads(nodes, ways, (1e5, 1e5, 2e5, 2e5))
    plain = osm.compile_roads(nodes, ways, None, 1000.0)[1].collect()
    assert all(len(r.points) == 2 for r in plain) and len(plain) == len(links)
