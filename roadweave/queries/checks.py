"""Invariants, contracts, and gates; set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadweave.functions.traffic import storage_capacity
from roadweave.operators import contracts as K, graph as G, morphology as M
from roadweave.sources.traffic import Traffic

from . import query
from .aggregates import agent_paths, zone_times
from .graphs import _PARTS, junctions, ways

_c = F.col


def _r(x, n: int = 6):
    return F.round(x, n)


@query("SELECT DISTINCT least(src_node_id, dst_node_id) AS u, greatest(src_node_id, dst_node_id) AS v FROM tf_link")
def undirected_edges(t: Traffic) -> DataFrame:
    return t.link().select(F.least("src_node_id", "dst_node_id").alias("u"), F.greatest("src_node_id", "dst_node_id").alias("v")).distinct()


@query("SELECT stage, count(*) AS n, count(DISTINCT trip_request_id) = count(*) AS ids_unique FROM tf_trip GROUP BY stage")
def bucket_union(t: Traffic) -> DataFrame:
    """Three buckets merged; ids are unique."""
    trip = t.trip().select("trip_request_id", "stage")
    x = trip.where("stage = 'pending'").unionByName(trip.where("stage = 'active'")).unionByName(trip.where("stage = 'completed'"))
    return x.groupBy("stage").agg(F.count("*").alias("n"), (F.count_distinct("trip_request_id") == F.count("*")).alias("ids_unique"))


@query("WITH a AS (SELECT link_id, queue_vehicles FROM tf_link), b AS (SELECT link_id, queue_vehicles FROM tf_link WHERE link_id % 40 <> 1) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS n_missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS n_extra")
def reconcile_artifacts(t: Traffic) -> DataFrame:
    a = t.link().select("link_id", "queue_vehicles")
    b = a.where("link_id % 40 <> 1")
    return a.exceptAll(b).agg(F.count("*").alias("n_missing")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("n_extra")))  # single rows


@query("SELECT (SELECT count(*) FROM (SELECT trip_request_id FROM tf_trip WHERE stage = 'pending' INTERSECT SELECT trip_request_id FROM tf_trip WHERE stage = 'completed')) AS n_both, (SELECT count(*) FROM (SELECT trip_request_id FROM tf_trip EXCEPT SELECT trip_request_id FROM tf_trip WHERE stage IN ('pending', 'active', 'completed'))) AS n_lost")
def lifecycle_disjointness(t: Traffic) -> DataFrame:
    ids = lambda *s: t.trip().where(_c("stage").isin(*s)).select("trip_request_id")
    both = ids("pending").intersect(ids("completed")).agg(F.count("*").alias("n_both"))
    lost = t.trip().select("trip_request_id").subtract(ids("pending", "active", "completed")).agg(F.count("*").alias("n_lost"))
    return both.crossJoin(lost)  # single rows


@query("SELECT NOT EXISTS (SELECT link_id FROM tf_link EXCEPT SELECT from_link_id FROM tf_turn) AND NOT EXISTS (SELECT from_link_id FROM tf_turn EXCEPT SELECT link_id FROM tf_link) AS same_keys")
def key_identity(t: Traffic) -> DataFrame:
    link = t.link()
    a, b = link.select("link_id"), t.turn(link).select(_c("from_link_id").alias("link_id"))
    n = a.subtract(b).unionByName(b.subtract(a)).agg((F.count("*") == 0).alias("same_keys"))
    return n


_BAD = "b AS (SELECT link_id, queue_vehicles - CASE WHEN link_id % 30 = 2 THEN 1e6 ELSE 0 END AS q, CAST(greatest(floor(length_m * lanes / 7.5), 1) AS DOUBLE) AS storage, capacity_veh_per_tick AS cap FROM tf_link)"


def _bad(t: Traffic) -> DataFrame:
    return t.link().select("link_id", (_c("queue_vehicles") - F.when(_c("link_id") % 30 == 2, 1e6).otherwise(0)).alias("q"), storage_capacity(_c("length_m"), _c("lanes")).alias("storage"), _c("capacity_veh_per_tick").alias("cap"))


@query(f"WITH {_BAD} SELECT count(*) AS n, min(link_id) AS first_link, round(min(q), 4) AS least FROM b WHERE q < 0 OR NOT isfinite(q)")
def non_negative_queue(t: Traffic) -> DataFrame:
    return _bad(t).where("q < 0 OR isnan(q)").agg(F.count("*").alias("n"), F.min("link_id").alias("first_link"), _r(F.min("q"), 4).alias("least"))


@query(f"WITH {_BAD} SELECT link_id, round(q - storage, 4) AS excess FROM b WHERE storage >= 1 AND q > storage + 1e-6")
def finite_storage(t: Traffic) -> DataFrame:
    return _bad(t).where("storage >= 1 AND q > storage + 1e-6").select("link_id", _r(_c("q") - _c("storage"), 4).alias("excess"))


@query(f"WITH {_BAD} SELECT link_id, q > cap + 1e-6 AS flag, (q > cap + 1e-6) = (link_id % 2 = 0) AS as_told FROM b")
def capacity_flags(t: Traffic) -> DataFrame:
    over = _c("q") > _c("cap") + 1e-6
    return _bad(t).select("link_id", over.alias("flag"), (over == (_c("link_id") % 2 == 0)).alias("as_told"))


@query("""WITH a AS (SELECT CAST(origin_node_id * 25 + (origin_node_id + 1) % 25 AS INT) AS link_id, count(*) AS n FROM tf_trip WHERE stage = 'active' GROUP BY 1) SELECT l.link_id, coalesce(a.n, 0) AS n_agents, CAST(floor(l.queue_vehicles) AS BIGINT) AS queue, coalesce(a.n, 0) = floor(l.queue_vehicles) AS agrees FROM tf_link l FULL JOIN a ON a.link_id = l.link_id""")
def queue_authority(t: Traffic) -> DataFrame:
    """Agents of each link against its queue."""
    o = _c("origin_node_id")
    a = t.trip().where("stage = 'active'").groupBy((o * 25 + (o + 1) % 25).cast("int").alias("link_id")).agg(F.count("*").alias("n"))
    n, q = F.coalesce("n", F.lit(0)), F.floor("queue_vehicles")
    return t.link().join(a, "link_id", "full_outer").select("link_id", n.alias("n_agents"), q.alias("queue"), (n == q).alias("agrees"))


@query("""WITH k AS (SELECT link_id, capacity_veh_per_tick / 16.0 AS share FROM tf_link), n AS (SELECT k.link_id, r.tick, share, floor(share * r.tick + 1e-9) - floor(share * (r.tick - 1) + 1e-9) AS tokens, share * r.tick - floor(share * r.tick + 1e-9) AS residual FROM k CROSS JOIN (SELECT unnest(range(1, 5)) AS tick) r)
SELECT link_id, CAST(tick AS INT) AS tick, CAST(tokens AS BIGINT) AS tokens, round(residual, 6) AS residual, residual > -1e-6 AND residual < 1 AS residual_ok, abs(tokens - share) < 1 AS tokens_ok FROM n""")
def token_authority(t: Traffic) -> DataFrame:
    """Four ticks of a link's whole tokens: the residual stays in [0, 1), and no tick is a token or more away from the share."""
    share = _c("capacity_veh_per_tick") / 16.0
    x = t.link().select("link_id", share.alias("share"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("tick"))
    whole = lambda k: F.floor(_c("share") * k + 1e-9)
    x = x.withColumn("tokens", whole(_c("tick")) - whole(_c("tick") - 1)).withColumn("residual", _c("share") * _c("tick") - whole(_c("tick")))
    return x.select("link_id", "tick", "tokens", _r("residual").alias("residual"), ((_c("residual") > -1e-6) & (_c("residual") < 1)).alias("residual_ok"), (F.abs(_c("tokens") - _c("share")) < 1).alias("tokens_ok"))


@query("""WITH ag AS (SELECT trip_request_id AS agent_id, citizen_id, trip_request_id % 5 % 2 AS pos FROM tf_trip WHERE stage = 'active'), k AS (SELECT citizen_id, count(*) AS n_agents, count(DISTINCT agent_id) AS n_ids, count(CASE WHEN pos NOT IN (0, 1) THEN 1 END) AS n_outside FROM ag GROUP BY citizen_id)
SELECT n_agents, count(*) AS n_citizens, CAST(sum(n_agents - n_ids) AS BIGINT) AS n_repeated, CAST(sum(n_outside) AS BIGINT) AS n_outside, n_agents > 1 AS several FROM k GROUP BY n_agents""")
def pool_consistency(t: Traffic) -> DataFrame:
    """Travellers by how many vehicles they have under way at once; ids that repeat, and places outside a path."""
    a = agent_paths(t).join(t.trip().select(_c("trip_request_id").alias("agent_id"), "citizen_id"), "agent_id")
    k = a.groupBy("citizen_id").agg(F.count("*").alias("n_agents"), F.count_distinct("agent_id").alias("n_ids"), F.count_if((_c("at") < 0) | (_c("at") >= F.size("path"))).alias("n_outside"))
    return k.groupBy("n_agents").agg(F.count("*").alias("n_citizens"), F.sum(_c("n_agents") - _c("n_ids")).alias("n_repeated"), F.sum("n_outside").alias("n_outside")).withColumn("several", _c("n_agents") > 1)


_STATE = """ag AS (SELECT trip_request_id AS agent_id, trip_request_id % 5 % 2 AS pos, CAST(origin_node_id * 25 + (origin_node_id + 1) % 25 AS INT) AS a, CAST(((origin_node_id + 1) % 25) * 25 + (origin_node_id + 1 + CASE WHEN trip_request_id % 2 = 0 THEN 5 ELSE 24 END) % 25 AS INT) AS b FROM tf_trip WHERE stage = 'active'), here AS (SELECT CASE WHEN pos = 0 THEN a ELSE b END AS link_id, count(*) AS n FROM ag GROUP BY 1),
o AS (SELECT from_link_id AS link_id, sum(turn_demand) AS f FROM tf_turn WHERE NOT is_forbidden GROUP BY 1), i AS (SELECT to_link_id AS link_id, sum(turn_demand) AS f FROM tf_turn WHERE NOT is_forbidden GROUP BY 1),
st AS (SELECT l.link_id, queue_vehicles AS q, CAST(greatest(floor(length_m * lanes / 7.5), 1) AS DOUBLE) AS storage, coalesce(o.f, 0.0) AS outflow, coalesce(i.f, 0.0) AS inflow, capacity_veh_per_tick AS cap, capacity_veh_per_tick / 16.0 - floor(capacity_veh_per_tick / 16.0) AS residual FROM tf_link l LEFT JOIN o ON o.link_id = l.link_id LEFT JOIN i ON i.link_id = l.link_id),
v AS (SELECT 'active_agent_pool_consistency' AS check, 'place_outside_path' AS code, CAST(agent_id AS VARCHAR) AS subject FROM ag WHERE pos > 1
UNION ALL SELECT 'non_negative_queue', 'negative_queue', CAST(link_id AS VARCHAR) FROM st WHERE q < 0 UNION ALL SELECT 'finite_link_storage', 'storage_exceeded', CAST(link_id AS VARCHAR) FROM st WHERE q > storage + 1e-6
UNION ALL SELECT 'runtime_vehicle_queue_authority', 'queue_is_not_agents', CAST(coalesce(st.link_id, h.link_id) AS VARCHAR) FROM st FULL JOIN here h ON h.link_id = st.link_id WHERE coalesce(floor(st.q + 1e-6), 0) <> coalesce(h.n, 0)
UNION ALL SELECT 'runtime_token_authority', 'service_residual_outside_unit', CAST(link_id AS VARCHAR) FROM st WHERE residual < 0 OR residual >= 1
UNION ALL SELECT 'capacity_flags', 'capacity_exceeded', CAST(link_id AS VARCHAR) FROM st WHERE outflow > cap + 1e-6 OR inflow > cap + 1e-6 UNION ALL SELECT 'capacity_flags', 'flag_mismatch', CAST(link_id AS VARCHAR) FROM st WHERE (outflow > cap + 1e-6) <> (outflow > cap + 1e-6 OR inflow > cap + 1e-6)
UNION ALL SELECT 'conservation', 'conservation_mismatch', 'trips' FROM (SELECT count(*) AS n, count(CASE WHEN stage IN ('pending', 'active', 'completed') THEN 1 END) AS m FROM tf_trip) WHERE n <> m
UNION ALL SELECT 'trip_lifecycle_disjoint', 'trip_in_two_stages', CAST(trip_request_id AS VARCHAR) FROM tf_trip GROUP BY trip_request_id HAVING count(DISTINCT stage) > 1)"""


def _broken_invariants(t: Traffic) -> DataFrame:
    """The eight checks on the links, turns, travellers and trips as they are; the flag looks at what flows out only, as a runtime might."""
    turn = t.turn().where("NOT is_forbidden")
    flow = lambda end, name: turn.groupBy(_c(end).alias("link_id")).agg(F.sum("turn_demand").alias(name))
    cap = _c("capacity_veh_per_tick")
    share = cap / 16.0
    link = t.link().join(flow("from_link_id", "outflow"), "link_id", "left").join(flow("to_link_id", "inflow"), "link_id", "left").fillna(0.0, ["outflow", "inflow"])
    link = link.select(
        "link_id", _c("queue_vehicles").alias("queue"), storage_capacity(_c("length_m"), _c("lanes")).alias("storage"), "outflow", "inflow", cap.alias("capacity"), cap.alias("receiving"), (_c("outflow") > cap + 1e-6).alias("flag"),
        (share - F.floor(share)).alias("service_residual"), (share - F.floor(share)).alias("receiving_residual"), F.floor(share).cast("double").alias("service_tokens"), F.floor(share).cast("double").alias("receiving_tokens"),
    )
    agents = agent_paths(t).select("agent_id", "path", "at", F.element_at("path", _c("at") + 1).alias("link_id"))
    trips = t.trip().select(_c("trip_request_id").alias("trip_id"), "stage")
    totals = trips.agg(F.count("*").alias("generated"), *[F.count_if(_c("stage") == x).alias(x) for x in ("pending", "active", "completed", "failed")])
    return K.invariants(link, agents, trips, totals)


@query(f"WITH {_STATE} SELECT * FROM v")
def invariant_violations(t: Traffic) -> DataFrame:
    """Every broken invariant, with its subject."""
    return _broken_invariants(t)


@query(f"WITH {_STATE} SELECT k.check, count(v.check) AS n, count(v.check) = 0 AS passed FROM (SELECT unnest({list(K.INVARIANTS)}) AS check) k LEFT JOIN v ON v.check = k.check GROUP BY k.check")
def invariant_runner(t: Traffic) -> DataFrame:
    """The eight checks, and how many rows break each."""
    return K.report(_broken_invariants(t), K.INVARIANTS)


@query("SELECT link_id, length_m > 0 AND lanes >= 1 AND capacity_veh_per_tick > 0 AND queue_vehicles >= 0 AND src_node_id <> dst_node_id AS ok FROM tf_link")
def link_state_checks(t: Traffic) -> DataFrame:
    return t.link().select("link_id", ((_c("length_m") > 0) & (_c("lanes") >= 1) & (_c("capacity_veh_per_tick") > 0) & (_c("queue_vehicles") >= 0) & (_c("src_node_id") != _c("dst_node_id"))).alias("ok"))


_WORLD = """e AS (SELECT *, length_m / free_flow_speed_mps + queue_vehicles / capacity_veh_per_tick AS travel, greatest(floor(length_m * lanes / 7.5), 1) AS stock FROM tf_link), m AS (SELECT a.zone_id AS o, b.zone_id AS d, avg(abs(a.x - b.x) + abs(a.y - b.y)) / 10.0 AS cost FROM tf_node a CROSS JOIN tf_node b GROUP BY a.zone_id, b.zone_id),
s AS (SELECT CAST(sum(population_capacity) AS BIGINT) AS population, (SELECT count(*) FROM tf_trip WHERE stage = 'active') AS active, (SELECT max(planned_depart_tick) FROM tf_trip) AS step, (SELECT max(start_tick) FROM tf_event) AS snapshot FROM tf_zone),
v AS (SELECT 'graph' AS check, 'edge_src_unknown' AS code, CAST(link_id AS VARCHAR) AS subject FROM e WHERE src_node_id NOT IN (SELECT node_id FROM tf_node) UNION ALL SELECT 'graph', 'edge_dst_unknown', CAST(link_id AS VARCHAR) FROM e WHERE dst_node_id NOT IN (SELECT node_id FROM tf_node) UNION ALL SELECT 'graph', 'edge_class_missing', CAST(link_id AS VARCHAR) FROM e WHERE road_class IS NULL
UNION ALL SELECT 'graph', 'edge_id_repeated', CAST(link_id AS VARCHAR) FROM e GROUP BY link_id HAVING count(*) > 1
UNION ALL SELECT 'traffic', 'negative_queue', CAST(link_id AS VARCHAR) FROM e WHERE queue_vehicles < 0 UNION ALL SELECT 'traffic', 'negative_travel_time', CAST(link_id AS VARCHAR) FROM e WHERE travel < 0 UNION ALL SELECT 'traffic', 'queue_over_stock', CAST(link_id AS VARCHAR) FROM e WHERE queue_vehicles > stock
UNION ALL SELECT 'traffic', 'negative_movement', from_link_id || '-' || to_link_id FROM tf_turn WHERE turn_demand < 0
UNION ALL SELECT 'demand', 'active_over_population', 'world' FROM s WHERE active > population UNION ALL SELECT 'demand', 'home_unknown', CAST(citizen_id AS VARCHAR) FROM tf_profile WHERE home_node_id NOT IN (SELECT node_id FROM tf_node)
UNION ALL SELECT 'landuse', 'negative_housing', CAST(zone_id AS VARCHAR) FROM tf_zone WHERE population_capacity < 0 UNION ALL SELECT 'landuse', 'negative_jobs', CAST(zone_id AS VARCHAR) FROM tf_zone WHERE job_capacity < 0
UNION ALL SELECT 'accessibility', 'row_length', CAST(o AS VARCHAR) FROM m GROUP BY o HAVING count(*) <> (SELECT count(*) FROM tf_zone) UNION ALL SELECT 'accessibility', 'negative_cost', o || '-' || d FROM m WHERE cost < 0 UNION ALL SELECT 'accessibility', 'snapshot_not_lagged', 'world' FROM s WHERE snapshot >= step
UNION ALL SELECT 'events', 'severity_outside_unit', CAST(event_id AS VARCHAR) FROM tf_event WHERE severity < 0 OR severity > 1 UNION ALL SELECT 'events', 'ends_before_start', CAST(event_id AS VARCHAR) FROM tf_event WHERE end_tick < start_tick UNION ALL SELECT 'events', 'target_unknown', CAST(event_id AS VARCHAR) FROM tf_event WHERE link_id NOT IN (SELECT link_id FROM tf_link))"""


@query(f"WITH {_WORLD} SELECT * FROM v")
def world_contract(t: Traffic) -> DataFrame:
    """Every rule of the world's tables that a row breaks: graph, traffic, demand, land use, accessibility, events."""
    e = t.link().withColumn("travel", _c("length_m") / _c("free_flow_speed_mps") + _c("queue_vehicles") / _c("capacity_veh_per_tick")).withColumn("stock", storage_capacity(_c("length_m"), _c("lanes")))
    node, zone, event, turn = t.node(), t.zone(), t.event(), t.turn()
    costs = zone_times(t)
    full = costs.groupBy("o").agg(F.count("*").alias("n")).join(F.broadcast(zone.agg(F.count("*").alias("zones"))), F.lit(True))  # one row
    one = zone.agg(F.sum("population_capacity").alias("population")).join(t.trip().agg(F.count_if(_c("stage") == "active").alias("active"), F.max("planned_depart_tick").alias("step")), F.lit(True)).join(event.agg(F.max("start_tick").alias("snapshot")), F.lit(True))  # one row each
    return K.together([
        K.without(e.withColumn("node_id", _c("src_node_id")), "graph", "edge_src_unknown", "link_id", node, ["node_id"]), K.without(e.withColumn("node_id", _c("dst_node_id")), "graph", "edge_dst_unknown", "link_id", node, ["node_id"]),
        K.broken(e, "graph", _c("link_id"), {"edge_class_missing": _c("road_class").isNull()}), K.repeated(e, "graph", "edge_id_repeated", "link_id"),
        K.broken(e, "traffic", _c("link_id"), {"negative_queue": _c("queue_vehicles") < 0, "negative_travel_time": _c("travel") < 0, "queue_over_stock": _c("queue_vehicles") > _c("stock")}),
        K.broken(turn, "traffic", F.concat_ws("-", "from_link_id", "to_link_id"), {"negative_movement": _c("turn_demand") < 0}),
        K.broken(one, "demand", F.lit("world"), {"active_over_population": _c("active") > _c("population")}), K.without(t.profile().withColumn("node_id", _c("home_node_id")), "demand", "home_unknown", "citizen_id", node, ["node_id"]),
        K.broken(zone, "landuse", _c("zone_id"), {"negative_housing": _c("population_capacity") < 0, "negative_jobs": _c("job_capacity") < 0}),
        K.broken(full, "accessibility", _c("o"), {"row_length": _c("n") != _c("zones")}), K.broken(costs, "accessibility", F.concat_ws("-", "o", "d"), {"negative_cost": _c("tt") < 0}), K.broken(one, "accessibility", F.lit("world"), {"snapshot_not_lagged": _c("snapshot") >= _c("step")}),
        K.broken(event, "events", _c("event_id"), {"severity_outside_unit": (_c("severity") < 0) | (_c("severity") > 1), "ends_before_start": _c("end_tick") < _c("start_tick")}), K.without(event, "events", "target_unknown", "event_id", e, ["link_id"]),
    ])


_MAP = """j AS (SELECT junction_id, x, y FROM tf_junction), s AS (SELECT * FROM tf_street),
v AS (SELECT 'topology' AS check, 'street_repeated' AS code, CAST(street_id AS VARCHAR) AS subject FROM s GROUP BY street_id HAVING count(*) > 1 UNION ALL SELECT 'topology', 'loop', CAST(street_id AS VARCHAR) FROM s WHERE u = v UNION ALL SELECT 'topology', 'end_unknown', CAST(street_id AS VARCHAR) FROM s WHERE u NOT IN (SELECT junction_id FROM j) OR v NOT IN (SELECT junction_id FROM j)
UNION ALL SELECT 'topology', 'place_repeated', x || ',' || y FROM (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM j) GROUP BY x, y HAVING count(*) > 1
UNION ALL SELECT 'connectivity', 'junction_without_street', CAST(junction_id AS VARCHAR) FROM j WHERE junction_id NOT IN (SELECT u FROM s UNION SELECT v FROM s) UNION ALL SELECT 'connectivity', 'part_apart', CAST(root AS VARCHAR) FROM w GROUP BY root HAVING root <> (SELECT root FROM w GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)
UNION ALL SELECT 'geometry', 'no_length', CAST(street_id AS VARCHAR) FROM s WHERE ax = bx AND ay = by_ UNION ALL SELECT 'geometry', 'start_not_anchored', CAST(street_id AS VARCHAR) FROM s JOIN j ON j.junction_id = s.u WHERE abs(s.ax - j.x) > 0.25 OR abs(s.ay - j.y) > 0.25
UNION ALL SELECT 'access', 'no_way_out', CAST(junction_id AS VARCHAR) FROM j WHERE junction_id IN (SELECT u FROM s UNION SELECT v FROM s) AND junction_id NOT IN (SELECT u FROM s UNION SELECT v FROM s WHERE NOT one_way) UNION ALL SELECT 'access', 'no_way_in', CAST(junction_id AS VARCHAR) FROM j WHERE junction_id IN (SELECT u FROM s UNION SELECT v FROM s) AND junction_id NOT IN (SELECT v FROM s UNION SELECT u FROM s WHERE NOT one_way))"""


@query(f"WITH {_PARTS}, {_MAP} SELECT * FROM v")
def map_contract(t: Traffic) -> DataFrame:
    """Every rule of the street map that is broken: topology, connectivity, geometry, access."""
    j, s = t.junction().select(_c("junction_id").alias("node_id"), "x", "y"), t.street()
    ends = s.select("street_id", F.explode(F.array("u", "v")).alias("node_id"))
    parts = G.weak_components(j.select("node_id"), s)
    apart = G.component_order(parts).where("component_id > 0")
    used = j.join(ends.select("node_id").distinct(), "node_id", "left_semi")
    out, into = (ways(t).select(_c(c).alias("node_id")) for c in "uv")
    known = K.without(ends, "topology", "end_unknown", "street_id", j, ["node_id"]).distinct()
    start = s.join(j.withColumnRenamed("node_id", "u"), "u")
    return K.together([
        K.repeated(s, "topology", "street_repeated", "street_id"), K.broken(s, "topology", _c("street_id"), {"loop": _c("u") == _c("v")}), known,
        K.repeated(j.withColumn("place", F.concat_ws(",", _c("x").cast("long"), _c("y").cast("long"))), "topology", "place_repeated", "place"),
        K.without(j, "connectivity", "junction_without_street", "node_id", ends, ["node_id"]), K.broken(apart, "connectivity", _c("root"), {"part_apart": F.lit(True)}),
        K.broken(s, "geometry", _c("street_id"), {"no_length": (_c("ax") == _c("bx")) & (_c("ay") == _c("by"))}), K.broken(start, "geometry", _c("street_id"), {"start_not_anchored": (F.abs(_c("ax") - _c("x")) > 0.25) | (F.abs(_c("ay") - _c("y")) > 0.25)}),
        K.without(used, "access", "no_way_out", "node_id", out, ["node_id"]), K.without(used, "access", "no_way_in", "node_id", into, ["node_id"]),
    ])


@query("WITH g AS (SELECT l.link_id, a.x + CASE WHEN l.link_id % 20 = 0 THEN 3 ELSE 0.1 END AS gx, a.x AS nx FROM tf_link l JOIN tf_node a ON a.node_id = l.src_node_id) SELECT link_id FROM g WHERE abs(gx - nx) > 0.25")
def geometry_anchors(t: Traffic) -> DataFrame:
    """Links whose line doesn't begin at their node."""
    n = t.node().select(_c("node_id").alias("src_node_id"), "x")
    g = t.link().join(n, "src_node_id").withColumn("gx", _c("x") + F.when(_c("link_id") % 20 == 0, 3).otherwise(0.1))
    return g.where(F.abs(_c("gx") - _c("x")) > 0.25).select("link_id")


_SHAPE = f"""{_PARTS}, e AS (SELECT street_id, u, v, ax, ay, bx, by_, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS length, street_id % 8 < 4 AS local FROM tf_street),
g AS (SELECT floor(junction_id / 40) AS k, x, y FROM tf_junction), s1 AS (SELECT p.k, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM g p JOIN g q ON q.k = p.k AND (q.x <> p.x OR q.y <> p.y) WHERE NOT EXISTS (SELECT 1 FROM g r WHERE r.k = p.k AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0))),
g2 AS (SELECT DISTINCT ax AS x, ay AS y FROM s1 UNION SELECT bx, by_ FROM s1 UNION SELECT x, y FROM g WHERE k NOT IN (SELECT k FROM s1)),
s2 AS (SELECT p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM g2 p JOIN g2 q ON q.x <> p.x OR q.y <> p.y WHERE NOT EXISTS (SELECT 1 FROM g2 r WHERE (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0 OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND ((r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) < 0 OR (r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) > (q.x - p.x) ** 2 + (q.y - p.y) ** 2)))),
box AS (SELECT min(ax) AS x0, min(ay) AS y0, max(ax) - min(ax) AS w, max(ay) - min(ay) AS h, sum(ax * by_ - bx * ay) / 2 AS area FROM s2),
cell AS (SELECT n, cx, cy, x0 + (cx + 0.5) * w / n AS x, y0 + (cy + 0.5) * h / n AS y FROM box, (VALUES (24), (12)) v(n), range(0, 24) a(cx), range(0, 24) b(cy) WHERE cx < n AND cy < n),
good AS (SELECT * FROM cell c WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE (bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) < 0)),
steps AS (SELECT e.*, x0, y0, w, h, greatest(1, CAST(ceil(greatest(abs(bx - ax) / (w / 24), abs(by_ - ay) / (h / 24)) * 2.0) AS INT)) AS n FROM e, box),
dots AS (SELECT DISTINCT local, least(23, greatest(0, CAST(trunc((ax + (bx - ax) * (i / n) - x0) / (w / 24)) AS INT))) AS cx, least(23, greatest(0, CAST(trunc((ay + (by_ - ay) * (i / n) - y0) / (h / 24)) AS INT))) AS cy FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM steps)),
deg AS (SELECT j.junction_id, count(t.n) AS d, count(CASE WHEN t.local THEN 1 END) AS dl FROM tf_junction j LEFT JOIN (SELECT u AS n, local FROM e UNION ALL SELECT v, local FROM e) t ON t.n = j.junction_id GROUP BY j.junction_id),
hub AS (SELECT x, y FROM tf_junction WHERE junction_id IN (SELECT junction_id FROM deg WHERE dl >= 3)),
zone AS (SELECT floor(junction_id / 400) AS z, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM tf_junction GROUP BY 1), spot AS (SELECT ax AS x, ay AS y FROM e UNION SELECT bx, by_ FROM e UNION SELECT (ax + bx) * 0.5, (ay + by_) * 0.5 FROM e),
quad AS (SELECT z, count(DISTINCT CASE WHEN s.x IS NOT NULL THEN (CASE WHEN s.x >= (x0 + x1) * 0.5 THEN 1 ELSE 0 END) * 2 + CASE WHEN s.y >= (y0 + y1) * 0.5 THEN 1 ELSE 0 END END) AS q FROM zone LEFT JOIN spot s ON s.x BETWEEN x0 AND x1 AND s.y BETWEEN y0 AND y1 GROUP BY z),
b2 AS (SELECT street_id, u, v FROM tf_street UNION ALL SELECT street_id, v, u FROM tf_street), r2(street_id, n) AS (SELECT street_id, u FROM tf_street UNION SELECT r2.street_id, b2.v FROM r2 JOIN b2 ON b2.u = r2.n AND b2.street_id <> r2.street_id),
sums AS (SELECT sum(length) AS total, sum(CASE WHEN NOT EXISTS (SELECT 1 FROM r2 WHERE r2.street_id = e.street_id AND r2.n = e.v) THEN length ELSE 0.0 END) AS cut, sum(CASE WHEN local THEN length ELSE 0.0 END) AS narrow, sum(CASE WHEN local THEN 0.0 ELSE length END) AS wide, coalesce(median(CASE WHEN local THEN length END), 0.0) AS ml, coalesce(median(CASE WHEN NOT local THEN length END), 0.0) AS mc, count(*) AS n FROM e),
shape AS (SELECT area AS convex_hull_area_m2, total AS physical_road_length_m, total * 1000.0 / area AS street_density_km_per_km2, 1.0 - cut / total AS block_continuity, cut / total AS bridge_length_share, wide / greatest(narrow, 1e-12) AS connector_to_local_length_ratio, ml AS median_local_length_m, mc AS median_connector_length_m,
(SELECT avg(CASE WHEN d = 1 THEN 1.0 ELSE 0.0 END) FROM deg) AS degree_one_share, (SELECT avg(CASE WHEN d = 2 THEN 1.0 ELSE 0.0 END) FROM deg) AS degree_two_share, (SELECT avg(CASE WHEN d = 3 THEN 1.0 ELSE 0.0 END) FROM deg) AS degree_three_share, (SELECT avg(CASE WHEN d = 4 THEN 1.0 ELSE 0.0 END) FROM deg) AS degree_four_share, (SELECT avg(CASE WHEN d >= 5 THEN 1.0 ELSE 0.0 END) FROM deg) AS degree_five_plus_share,
(SELECT avg(q / 4.0) FROM quad) AS district_quadrant_presence_share, (SELECT count(*) FROM zone) AS district_count,
(SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM dots d WHERE d.cx = g.cx AND d.cy = g.cy) THEN 1.0 ELSE 0.0 END) FROM good g WHERE n = 24) AS global_street_cell_presence_share, (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM dots d WHERE d.cx = g.cx AND d.cy = g.cy AND d.local) THEN 1.0 ELSE 0.0 END) FROM good g WHERE n = 24) AS global_local_street_cell_presence_share,
(SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM hub WHERE sqrt((hub.x - g.x) ** 2 + (hub.y - g.y) ** 2) <= sqrt((w / 12) ** 2 + (h / 12) ** 2) * 0.5) THEN 1.0 ELSE 0.0 END) FROM good g WHERE n = 12) AS global_local_junction_proximity_share,
(SELECT count(DISTINCT root) FROM w) AS weak_component_count, sums.n AS physical_segment_count FROM box, sums)"""
_MEASURES = (
    "convex_hull_area_m2", "physical_road_length_m", "street_density_km_per_km2", "block_continuity", "bridge_length_share", "connector_to_local_length_ratio", "median_local_length_m", "median_connector_length_m",
    "degree_one_share", "degree_two_share", "degree_three_share", "degree_four_share", "degree_five_plus_share", "district_quadrant_presence_share", "global_street_cell_presence_share", "global_local_street_cell_presence_share", "global_local_junction_proximity_share",
)
_COUNTS = ("district_count", "weak_component_count", "physical_segment_count")


def _shape(t: Traffic) -> DataFrame:
    """Measures of the street network; its districts are the boxes of ten rows of junctions."""
    edges = t.street().select(_c("street_id").alias("edge_id"), "u", "v", "ax", "ay", "bx", "by", F.hypot(_c("bx") - _c("ax"), _c("by") - _c("ay")).alias("length"), (_c("street_id") % 8 < 4).alias("local"))
    box = t.junction().groupBy(F.floor(_c("junction_id") / 400).alias("district_id")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    corner = lambda x, y: F.struct(_c(x).alias("x"), _c(y).alias("y"))
    districts = box.select("district_id", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("ring"))
    return M.metrics(junctions(t), edges, districts, 500.0)


@query(f"WITH {_SHAPE} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in _MEASURES)}, {', '.join(_COUNTS)} FROM shape")
def morphology_metrics(t: Traffic) -> DataFrame:
    return _shape(t).select(*[_r(c).alias(c) for c in _MEASURES], *_COUNTS)


@query(f"""WITH {_SHAPE}, style AS (SELECT unnest(['standard', 'river_constrained', 'polycentric_tod', 'superblock_mixed']) AS style), f AS (SELECT style, list_filter([CASE WHEN weak_component_count <> 1 THEN 'weak_component_count' END, CASE WHEN global_local_street_cell_presence_share < 0.4 THEN 'global_local_street_cell_presence_share' END,
CASE WHEN global_local_junction_proximity_share < 0.4 THEN 'global_local_junction_proximity_share' END, CASE WHEN street_density_km_per_km2 < 5.951 THEN 'street_density_km_per_km2' END, CASE WHEN block_continuity < 0.85 THEN 'block_continuity' END, CASE WHEN degree_one_share > CASE WHEN style = 'river_constrained' THEN 0.13 ELSE 0.15 END THEN 'degree_one_share' END,
CASE WHEN district_count > 0 AND district_quadrant_presence_share < 0.9 THEN 'district_quadrant_presence_share' END, CASE WHEN style IN ('polycentric_tod', 'superblock_mixed') AND degree_four_share > 0.62 THEN 'mixed_grid_four_way_share' END, CASE WHEN style = 'river_constrained' AND block_continuity < 0.87 THEN 'river_block_continuity' END], lambda x: x IS NOT NULL) AS failed,
CASE WHEN street_density_km_per_km2 > 21.323 THEN 'street_density_km_per_km2' ELSE '' END AS advisories FROM shape, style) SELECT style, array_to_string(failed, ',') AS failures, advisories, len(failed) = 0 AS accepted FROM f""")
def morphology_gate(t: Traffic) -> DataFrame:
    """The gate's rules on the street network, for four styles."""
    x = _shape(t).withColumn("_style", F.explode(F.array(*map(F.lit, ("standard", "river_constrained", "polycentric_tod", "superblock_mixed")))))
    return M.gate(x, _c("_style")).select("style", F.array_join("failures", ",").alias("failures"), F.array_join("advisories", ",").alias("advisories"), "accepted")


@query("SELECT od_id, CASE WHEN avg(CASE WHEN outcome = 'completed' THEN 1.0 ELSE 0.0 END) < 0.7 THEN 'connectivity' WHEN avg(observed_travel_time) > 52 THEN 'retention' WHEN count(*) > 520 THEN 'iterations' ELSE 'pass' END AS verdict FROM tf_outcome GROUP BY od_id")
def incident_stress_gate(t: Traffic) -> DataFrame:
    done = F.avg((_c("outcome") == "completed").cast("double"))
    return t.outcome().groupBy("od_id").agg(F.when(done < 0.7, "connectivity").when(F.avg("observed_travel_time") > 52, "retention").when(F.count("*") > 520, "iterations").otherwise("pass").alias("verdict"))


@query("WITH s AS (SELECT sum(observed_travel_time) / 1000 AS total, quantile_cont(observed_travel_time, 0.9) AS p90, max(observed_travel_time) AS most FROM tf_outcome) SELECT total > 960 AS over_total, p90 > 18 AS over_p90, most > 35 AS over_max FROM s")
def seed_budget_gate(t: Traffic) -> DataFrame:
    from roadweave.sources.files import BUDGET

    s = t.outcome().agg((F.sum("observed_travel_time") / 1000).alias("total"), F.percentile("observed_travel_time", 0.9).alias("p90"), F.max("observed_travel_time").alias("most"))
    return s.select((_c("total") > BUDGET["total_seconds"]).alias("over_total"), (_c("p90") > BUDGET["p90_seconds"]).alias("over_p90"), (_c("most") > BUDGET["max_seconds"]).alias("over_max"))


@query(f"""WITH {_PARTS}, s AS (SELECT street_id AS id, u, v, layer, CAST(ax * 1000 AS BIGINT) AS ax, CAST(ay * 1000 AS BIGINT) AS ay, CAST(bx * 1000 AS BIGINT) AS bx, CAST(by_ * 1000 AS BIGINT) AS by_ FROM tf_street),
p AS (SELECT p.ax, p.ay, p.bx, p.by_, q.ax AS cx, q.ay AS cy, q.bx AS dx, q.by_ AS dy FROM s p JOIN s q ON q.id > p.id AND q.layer = p.layer AND least(p.ax, p.bx) <= greatest(q.ax, q.bx) AND greatest(p.ax, p.bx) >= least(q.ax, q.bx) AND least(p.ay, p.by_) <= greatest(q.ay, q.by_) AND greatest(p.ay, p.by_) >= least(q.ay, q.by_)),
o AS (SELECT *, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS sc, (bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax) AS sd, (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx) AS sa, (dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx) AS sb, (cx - ax) * (bx - ax) + (cy - ay) * (by_ - ay) AS tc, (dx - ax) * (bx - ax) + (dy - ay) * (by_ - ay) AS td, (ax - cx) * (dx - cx) + (ay - cy) * (dy - cy) AS ta, (bx - cx) * (dx - cx) + (by_ - cy) * (dy - cy) AS tb, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS l2, (dx - cx) * (dx - cx) + (dy - cy) * (dy - cy) AS m2 FROM p),
m AS (SELECT count(CASE WHEN sign(sc) * sign(sd) < 0 AND sign(sa) * sign(sb) < 0 THEN 1 END) AS proper_crossings, count(CASE WHEN sc = 0 AND sd = 0 AND greatest(tc, td) > 0 AND least(tc, td) < l2 THEN 1 END) AS collinear_overlaps,
CAST(count(CASE WHEN sc = 0 AND tc > 0 AND tc < l2 THEN 1 END) + count(CASE WHEN sd = 0 AND td > 0 AND td < l2 THEN 1 END) + count(CASE WHEN sa = 0 AND ta > 0 AND ta < m2 THEN 1 END) + count(CASE WHEN sb = 0 AND tb > 0 AND tb < m2 THEN 1 END) AS BIGINT) AS t_touches FROM o),
ends AS (SELECT layer, u AS n, ax AS x, ay AS y FROM s UNION SELECT layer, v, bx, by_ FROM s)
SELECT (SELECT count(DISTINCT root) FROM w WHERE node_id IN (SELECT n FROM ends)) = 1 AS is_connected, proper_crossings, collinear_overlaps, t_touches, (SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM s GROUP BY layer, least(u, v), greatest(u, v))) AS repeated_roads, (SELECT count(*) FROM (SELECT 1 FROM ends GROUP BY x, y HAVING count(DISTINCT layer) > 1 AND count(DISTINCT n) > 1)) AS false_junctions FROM m""")
def structural_audit(t: Traffic) -> DataFrame:
    """Faults of the street network before it is made planar."""
    return M.audit(t.street().select(_c("street_id").alias("road_id"), "u", "v", *[(_c(k) * 1000).cast("long").alias(k) for k in ("ax", "ay", "bx", "by")], "layer"), 200_000.0)


@query("WITH r AS (SELECT o_orderkey AS route_id, o_custkey AS stop_id FROM orders) SELECT count(*) AS n_routes, CAST(sum(CASE WHEN c.c_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dangling FROM r LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) c ON c.c_custkey = r.stop_id")
def transit_schema_check(t: Traffic) -> DataFrame:
    """Routes whose stop isn't there."""
    r = t.table("orders").select(_c("o_custkey").alias("c_custkey"))
    stops = t.table("customer").where("c_custkey % 7 <> 0").select("c_custkey", F.lit(True).alias("there"))
    return r.join(stops, "c_custkey", "left").agg(F.count("*").alias("n_routes"), F.count_if(_c("there").isNull()).alias("n_dangling"))


@query("WITH m AS (SELECT od_id, avg(observed_travel_time) AS v FROM tf_outcome GROUP BY od_id), e AS (SELECT min(v) * 1.02 AS lo, max(v) * 0.98 AS hi FROM m) SELECT od_id, v BETWEEN lo AND hi AS inside FROM m CROSS JOIN e")
def score_morphology(t: Traffic) -> DataFrame:
    m = t.outcome().groupBy("od_id").agg(F.avg("observed_travel_time").alias("v"))
    e = m.agg((F.min("v") * 1.02).alias("lo"), (F.max("v") * 0.98).alias("hi"))
    return m.crossJoin(F.broadcast(e)).select("od_id", _c("v").between(_c("lo"), _c("hi")).alias("inside"))  # one row
