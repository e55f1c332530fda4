"""Candidate cache, rerouting and chained vehicle tokens against plain Python; morphology and audits by hand."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import candidates, flow, morphology
from roadweave.sources.traffic import Traffic

SF = "/root/testdata/sf0.001"
REQUEST = "od_id int, origin_id int, destination_id int, incident boolean, forced boolean"
CACHE = "od_id int, origin_id int, destination_id int, refreshed_at int, version int, path string"


def test_reasons_and_merge(spark):
    cache = spark.createDataFrame([(1, 1, 2, 10, 3, "a"), (2, 1, 3, 10, 1, "b"), (3, 1, 4, 4, 1, "c"), (4, 1, 5, 30, 1, "d"), (5, 1, 6, 10, 1, "e"), (6, 1, 7, 10, 1, "f"), (9, 9, 9, 0, 1, "i")], CACHE)
    asked = [(1, 1, 2, True, True), (2, 1, 3, True, None), (3, 1, 4, False, False), (4, 1, 5, None, False), (5, 2, 6, False, False), (6, 1, 7, False, False), (7, 1, 8, True, False)]
    requests = spark.createDataFrame(asked, REQUEST)
    build = lambda ods: ods.where("od_id <> 7").select("od_id", F.concat(F.lit("new"), "od_id").alias("path"))
    after, decisions = candidates.refreshed(requests, cache, 12, build)
    assert {r.od_id: r.reason for r in decisions.collect()} == {1: "forced", 2: "incident", 3: "interval", 4: "clock", 5: "missing", 6: None, 7: "missing"}
    assert {r.od_id: (r.origin_id, r.refreshed_at, r.version, r.path) for r in after.collect()} == {
        1: (1, 12, 4, "new1"), 2: (1, 12, 2, "new2"), 3: (1, 12, 2, "new3"), 4: (1, 12, 2, "new4"), 5: (2, 12, 2, "new5"), 6: (1, 10, 1, "f"), 7: (1, 12, 1, None), 9: (9, 0, 1, "i"),
    }
    calm = {r.od_id: r.reason for r in candidates.refresh_reasons(requests, cache, 12, 9, incident_refreshes=False).collect()}
    assert calm[2] is None and calm[3] is None
    empty = candidates.refreshed(requests.where("false"), cache.where("false"), 1, build)
    assert not empty[0].collect() and not empty[1].collect()
    with pytest.raises(ValueError):
        candidates.refresh_reasons(requests, cache, 1, 0)
    kept, counts = candidates.pruned(cache.withColumn("x", F.when(F.col("od_id") < 3, 1)), ("x", F.lit(None).cast("int")), ("version", F.lit(1)))
    assert sorted(r.od_id for r in kept.collect()) == [3, 4, 5, 6, 9] and tuple(counts.first()) == (5, 2)


def test_splicing(spark):
    """Pointers that are right, behind, beyond the path, and links that aren't on it."""
    keen, idle = (1.0, 3.0, 1.0, 0.0), (0.0, 0.0, 0.0, 5.0)
    rows = [
        (1, [10, 11, 12], 0, 10, 7, 0, *keen), (2, [10, 11, 12], 2, 10, 7, 0, *keen), (3, [10, 11, 12], 9, 11, 7, 0, *keen), (4, [10, 11, 12], 0, 99, 7, 0, *keen), (5, [10, 11, 12], 0, 10, 7, 2, *keen),
        (6, [10, 11, 12], 2, 12, 7, 0, *keen), (7, [10, 20], 0, 10, 7, 0, *keen), (8, [10, 11, 12], 0, 10, 8, 0, *keen), (9, [10, 11, 12], 0, 10, 7, 0, *idle), (10, [], 0, 10, 7, 0, *keen), (11, [10, 55], 0, 10, 7, 0, *keen),
    ]
    agents = spark.createDataFrame(rows, "agent_id int, path array<int>, at int, current_link_id int, destination_id int, cooldown int, willingness double, delay_sensitivity double, exploration double, persistence double")
    tails = spark.createDataFrame([(10, 7, [20], 1.0), (11, 7, [21, 22], 2.0)], "incoming_link_id int, destination_id int, path array<int>, cost double")
    costs = spark.createDataFrame([(11, 50.0), (12, 50.0), (20, 1.0)], "link_id int, cost double")
    got = {r.agent_id: (list(r.route), r.reason, r.next_cooldown) for r in candidates.rerouted(agents, tails, costs).collect()}
    old = [10, 11, 12]
    assert got == {
        1: ([10, 20], "reroute", 3), 2: ([10, 20], "reroute", 3), 3: ([10, 11, 21, 22], "reroute", 3), 4: (old, "no_tail", 0), 5: (old, "cooldown", 1), 6: (old, "no_tail", 0), 7: ([10, 20], "same_tail", 0),
        8: (old, "no_tail", 0), 9: (old, "persistence", 0), 10: ([], "no_tail", 0), 11: ([10, 55], "invalid_costs", 0),
    }
    links = spark.createDataFrame([(10, 3), (11, 7), (12, 8)], "link_id int, dst_node_id int")
    asked = {(r.incoming_link_id, r.origin_id, r.destination_id) for r in candidates.tail_requests(agents, links).collect()}
    assert asked == {(10, 3, 7), (10, 3, 8)}  # one search for many agents; none where the link ends at the goal


def test_spliced_routes_are_legal(spark):
    """Every route of the registered query is a chain of legal turns that ends where the old one did."""
    from roadweave.queries import interfaces

    t = Traffic(spark, SF)
    legal = {(r[0], r[1]) for r in t.turn(t.link()).where("NOT is_forbidden").select("from_link_id", "to_link_id").collect()}
    end = {r.link_id: r.dst_node_id for r in t.link().collect()}
    rows = interfaces._drivers(t).select("path", "route", "reason").collect()
    new = [r for r in rows if r.reason == "reroute"]
    assert new and all(r.route == r.path for r in rows if r.reason != "reroute")
    for r in new:
        assert all(p in legal for p in itertools.pairwise(r.route)) and end[r.route[-1]] == end[r.path[-1]] and r.route[0] == r.path[0]


def one_tick(links, turns, sinks, state):
    """Vehicles of a tick, one at a time over all links. links: id -> [queue, capacity]; turns: (from, to) -> demand, flow; state: residuals, carries, credits."""
    open_ = {k: v for k, v in turns.items() if v[0] > 0 and v[1] > 0}
    sends = {a for a, _ in open_} | {k for k, d in sinks.items() if d > 0}
    takes = {b for _, b in open_}
    left, rest = {}, {}
    for side, has in (("service", sends), ("receiving", takes)):
        for k, (_, cap) in links.items():
            gained = state[side][k] + cap if k in has else 0.0
            whole = math.floor(gained + 1e-9)
            rest[side, k] = 0.0 if abs(gained - whole) <= 1e-9 else gained - whole
            left[side, k] = whole + (round(state[f"{side}_carry"][k]) if k in has and cap > 0 else 0)
    credit = {}
    for k, (_, cap) in links.items():
        inner, fraction, outer = sum(v[0] for (a, _), v in open_.items() if a == k), sum(v[1] for (a, _), v in open_.items() if a == k), sinks.get(k, 0)
        inner_credit = min(cap * inner / (inner + outer) if inner + outer else 0.0, fraction)
        if outer > 0:
            credit[k, -1] = state["credit"].get((k, -1), 0.0) + min(outer, max(cap - inner_credit, 0.0))
        for (a, b), (d, f) in turns.items():
            if a == k and d > 0:
                credit[a, b] = state["credit"].get((a, b), 0.0) + (f * inner_credit / fraction if f > 0 else 0.0)
    want = {m: math.floor(sinks[m[0]] if m[1] == -1 else turns[m][0] if m in open_ else 0) for m in credit}
    cars = {k: math.floor(q + 1e-6) for k, (q, _) in links.items()}
    done = dict.fromkeys(credit, 0)
    ok = lambda m: want[m] > done[m] and left["service", m[0]] > 0 and cars[m[0]] > 0 and (m[1] == -1 or left["receiving", m[1]] > 0)
    heap = [(-c, m[1] != -1, m) for m, c in credit.items() if ok(m)]
    heapq.heapify(heap)
    while heap:
        _, _, m = heapq.heappop(heap)
        if ok(m):
            done[m] += 1
            credit[m] -= 1.0
            left["service", m[0]] -= 1
            cars[m[0]] -= 1
            if m[1] != -1:
                left["receiving", m[1]] -= 1
            if ok(m):
                heapq.heappush(heap, (-credit[m], m[1] != -1, m))
    queue = {k: max(0.0, q - sum(n for (a, _), n in done.items() if a == k) + sum(n for (_, b), n in done.items() if b == k)) for k, (q, _) in links.items()}
    carry = lambda side, has: {k: float(max(0, min(left[side, k], 1))) if k in has and c > 0 else 0.0 for k, (_, c) in links.items()}
    state = {"service": {k: rest["service", k] for k in links}, "receiving": {k: rest["receiving", k] for k in links}, "service_carry": carry("service", sends), "receiving_carry": carry("receiving", takes), "credit": credit}
    return queue, done, state


def test_three_ticks_of_tokens(spark):
    """Queues, residuals, carries and credits after each of three ticks are those of one vehicle after another."""
    t = Traffic(spark, SF)
    link, turn = t.link(), t.turn().persist()
    now = link.select("link_id", "queue_vehicles", (F.col("capacity_veh_per_tick") / 16.0).alias("capacity")).persist()
    sinks = link.select("link_id", (F.col("lanes") - 1).cast("double").alias("demand"))
    out = {r.link_id: int(r.demand) for r in sinks.collect()}
    state = {k: dict.fromkeys(out, 0.0) for k in ("service", "receiving", "service_carry", "receiving_carry")} | {"credit": {}}
    moves = links = None
    moved = 0
    for _ in range(3):
        rows = {r.link_id: (r.queue_vehicles, r.capacity) for r in now.collect()}
        turns = {(r.from_link_id, r.to_link_id): (r.turn_demand, r.flow) for r in flow.turn_flows(turn, now).where("NOT is_forbidden").collect()}
        queue, done, state = one_tick(rows, turns, out, state)
        moves, links = flow.token_tick(turn, now, sinks, moves, links)
        got = {(r.from_link_id, r.to_link_id): r for r in moves.collect()}
        assert {m: r.realized for m, r in got.items()} == done
        assert all(abs(r.credit - state["credit"][m]) < 1e-9 for m, r in got.items())
        for r in links.collect():
            assert r.queue_vehicles == queue[r.link_id]
            want = [state[k][r.link_id] for k in ("service", "receiving", "service_carry", "receiving_carry")]
            assert [r.service_residual, r.receiving_residual, r.service_carry, r.receiving_carry] == pytest.approx(want, abs=1e-9)
        moved += sum(done.values())
        now = links.select("link_id", "queue_vehicles", "capacity")
    assert moved > 100


def test_hull(spark):
    r = random.Random(1)
    points = [(float(r.randrange(50)), float(r.randrange(50))) for _ in range(300)] + [(0.0, 0.0), (0.0, 60.0), (60.0, 0.0), (30.0, 30.0), (60.0, 60.0), (60.0, 30.0)] * 2
    df = spark.createDataFrame(points, "x double, y double").repartition(7)
    assert [(p.x, p.y) for p in morphology.hull(df).first()["ring"]] == [(0.0, 0.0), (60.0, 0.0), (60.0, 60.0), (0.0, 60.0)]
    assert morphology.hull(df.where("x < 0")).first()["ring"] == []
    assert len(morphology.hull(df.where("x = 60 AND y = 60")).first()["ring"]) == 1


def test_audit_finds_planted_faults(spark):
    kind = "road_id int, u int, v int, ax long, ay long, bx long, by long, layer int"
    sound = [(1, 0, 1, 0, 0, 100, 0, 0), (2, 1, 2, 100, 0, 100, 100, 0), (3, 2, 0, 100, 100, 0, 0, 0)]
    names = ("proper_crossings", "collinear_overlaps", "t_touches", "repeated_roads", "false_junctions")
    cases = {
        (): sound,
        ("proper_crossings",): [*sound, (4, 3, 2, 20, -30, 100, 100, 0)],
        ("collinear_overlaps", "t_touches"): [*sound, (4, 1, 3, 100, 0, 60, 0, 0)],
        ("t_touches",): [*sound, (4, 3, 1, 50, 0, 100, -90, 0), (5, 3, 0, 50, 0, 0, -80, 1)],
        ("repeated_roads", "collinear_overlaps"): [*sound, (4, 1, 0, 100, 0, 0, 0, 0)],
        ("false_junctions",): [*sound, (4, 9, 1, 0, 0, 100, 0, 1)],
    }
    for faults, rows in cases.items():
        got = morphology.audit(spark.createDataFrame(rows, kind), 30.0).first()
        assert {n for n in names if got[n]} == set(faults), (faults, got)
        assert got.is_connected
    assert not morphology.audit(spark.createDataFrame([*sound, (9, 7, 8, 500, 500, 600, 600, 0)], kind), 30.0).first().is_connected
