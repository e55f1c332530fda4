"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadweave.operators import flow as Flow
from roadweave.sources.traffic import Traffic

from . import query

_c = F.col


def state(t: Traffic) -> DataFrame:
    """Links as the flow operators take them."""
    return t.link().select("link_id", "queue_vehicles", _c("capacity_veh_per_tick").alias("capacity"), (_c("length_m") / _c("free_flow_speed_mps")).alias("base_ticks"), "is_blockable")


@query("SELECT t.from_link_id, t.to_link_id, a.queue_vehicles AS from_queue, a.capacity_veh_per_tick AS from_capacity, b.capacity_veh_per_tick AS to_capacity FROM tf_turn t JOIN tf_link a ON a.link_id = t.from_link_id JOIN tf_link b ON b.link_id = t.to_link_id")
def turn_link_gather(t: Traffic) -> DataFrame:
    link = t.link().withColumnRenamed("capacity_veh_per_tick", "capacity")
    return Flow.turn_links(t.turn(link), link).select("from_link_id", "to_link_id", "from_queue", "from_capacity", "to_capacity")


@query("SELECT l.link_id AS incoming_link_id, o.link_id AS outgoing_link_id FROM tf_link l JOIN tf_link o ON o.src_node_id = l.dst_node_id WHERE EXISTS (SELECT 1 FROM tf_turn t WHERE t.from_link_id = l.link_id AND t.to_link_id = o.link_id AND NOT t.is_forbidden)")
def legal_turn_successors(t: Traffic) -> DataFrame:
    link = t.link().select("link_id", "src_node_id", "dst_node_id")
    pairs = link.select(_c("link_id").alias("incoming_link_id"), _c("dst_node_id").alias("n")).join(link.select(_c("link_id").alias("outgoing_link_id"), _c("src_node_id").alias("n")), "n")
    legal = t.turn(t.link()).where("NOT is_forbidden").select(_c("from_link_id").alias("incoming_link_id"), _c("to_link_id").alias("outgoing_link_id"))
    return pairs.join(legal, ["incoming_link_id", "outgoing_link_id"], "left_semi").drop("n")


_SCOPED = "e AS (SELECT event_id, start_tick, end_tick, effect_model, severity, CASE WHEN event_id % 3 <> 0 THEN link_id END AS link_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 4 AS INT) END AS bridge_group_id FROM tf_event)"


def _scoped(t: Traffic) -> DataFrame:
    """Events that name a link, or for every third a bridge group."""
    k = _c("event_id")
    return t.event().withColumn("bridge_group_id", F.when(k % 3 == 0, (k % 4).cast("int"))).withColumn("link_id", F.when(k % 3 != 0, _c("link_id")))


@query(f"WITH {_SCOPED} SELECT event_id, link_id FROM e WHERE link_id IS NOT NULL UNION ALL SELECT e.event_id, l.link_id FROM e JOIN tf_link l ON l.bridge_group_id = e.bridge_group_id WHERE e.link_id IS NULL")
def event_target_links(t: Traffic) -> DataFrame:
    e = _scoped(t)
    groups = t.link().where("bridge_group_id IS NOT NULL").select("bridge_group_id", "link_id")
    return e.where("link_id IS NOT NULL").select("event_id", "link_id").unionByName(e.where("link_id IS NULL").select("event_id", "bridge_group_id").join(groups, "bridge_group_id").select("event_id", "link_id"))


_EFFECTS = """fx AS (SELECT l.link_id, count(e.event_id) AS n_events, least(1.0, coalesce(min(CASE WHEN e.effect_model = 'closure' AND NOT l.is_blockable THEN NULL WHEN e.effect_model = 'closure' THEN 0.0 WHEN e.effect_model = 'capacity_reduction' THEN 1.0 - e.severity END), 1.0)) AS multiplier
FROM tf_link l LEFT JOIN x e ON e.link_id = l.link_id AND 30 BETWEEN e.start_tick AND e.end_tick GROUP BY l.link_id)"""
_AIMED = f"{_SCOPED}, x AS (SELECT event_id, link_id, start_tick, end_tick, effect_model, severity FROM e WHERE link_id IS NOT NULL UNION ALL SELECT e.event_id, l.link_id, start_tick, end_tick, effect_model, severity FROM e JOIN tf_link l ON l.bridge_group_id = e.bridge_group_id WHERE e.link_id IS NULL)"


@query(f"WITH {_AIMED}, {_EFFECTS} SELECT link_id, n_events, round(multiplier, 4) AS multiplier FROM fx")
def event_effects(t: Traffic) -> DataFrame:
    link = t.link()
    groups = link.where("bridge_group_id IS NOT NULL").select("bridge_group_id", "link_id")
    return Flow.event_effects(link, _scoped(t), 30, groups).withColumn("multiplier", F.round("multiplier", 4))


@query(f"""WITH x AS (SELECT event_id, link_id, start_tick, end_tick, effect_model, severity FROM tf_event), {_EFFECTS}
SELECT l.link_id, round(multiplier, 4) AS multiplier, l.queue_vehicles > l.capacity_veh_per_tick * multiplier + 1e-6 AS over_capacity FROM tf_link l JOIN fx ON fx.link_id = l.link_id""")
def apply_event_effects(t: Traffic) -> DataFrame:
    link = t.link()
    fx = Flow.event_effects(link, t.event(), 30)
    return link.join(fx, "link_id").select("link_id", F.round("multiplier", 4).alias("multiplier"), (_c("queue_vehicles") > _c("capacity_veh_per_tick") * _c("multiplier") + 1e-6).alias("over_capacity"))


@query("SELECT t.trip_request_id, a.node_id AS origin, b.node_id AS destination, a.zone_id AS origin_zone, b.zone_id AS destination_zone FROM tf_trip t JOIN tf_node a ON a.node_id = t.origin_node_id JOIN tf_node b ON b.node_id = t.destination_node_id WHERE a.zone_id <> b.zone_id")
def trip_od_nodes(t: Traffic) -> DataFrame:
    n = t.node()
    a = n.select(_c("node_id").alias("origin"), _c("zone_id").alias("origin_zone"))
    b = n.select(_c("node_id").alias("destination"), _c("zone_id").alias("destination_zone"))
    trip = t.trip().select("trip_request_id", _c("origin_node_id").alias("origin"), _c("destination_node_id").alias("destination"))
    return trip.join(a, "origin").join(b, "destination").where("origin_zone <> destination_zone")


@query("SELECT trip_request_id FROM tf_trip WHERE planned_depart_tick <= 30 AND stage <> 'completed' AND trip_request_id NOT IN (SELECT trip_id FROM tf_outcome WHERE outcome = 'failed')")
def route_relevant_trips(t: Traffic) -> DataFrame:
    gone = t.outcome().where("outcome = 'failed'").select(_c("trip_id").alias("trip_request_id"))
    return t.trip().where("planned_depart_tick <= 30 AND stage <> 'completed'").select("trip_request_id").join(gone, "trip_request_id", "left_anti")


@query("SELECT from_link_id, to_link_id, CAST(count(*) AS BIGINT) AS n, count(*) > 1 AS duplicate FROM tf_turn WHERE NOT is_forbidden GROUP BY from_link_id, to_link_id")
def turn_pair_lookup(t: Traffic) -> DataFrame:
    return t.turn().where("NOT is_forbidden").groupBy("from_link_id", "to_link_id").agg(F.count("*").alias("n"), (F.count("*") > 1).alias("duplicate"))


@query("""WITH p AS (SELECT trip_request_id, destination_node_id AS d, CAST(origin_node_id * 25 + (origin_node_id + 1) % 25 AS INT) AS a, CAST(((origin_node_id + 1) % 25) * 25 + (origin_node_id + 1 + CASE trip_request_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 24 ELSE 3 END) % 25 AS INT) AS b FROM tf_trip)
SELECT p.trip_request_id, l2.link_id IS NOT NULL AND t.from_link_id IS NOT NULL AS legal, coalesce(l2.dst_node_id = p.d, false) AS arrives FROM p LEFT JOIN tf_link l2 ON l2.link_id = p.b LEFT JOIN tf_turn t ON t.from_link_id = p.a AND t.to_link_id = p.b AND NOT t.is_forbidden""")
def route_path_legality(t: Traffic) -> DataFrame:
    """Whether each pair of neighbouring links of a path is a legal turn of existing links, and where the path ends."""
    o, k = _c("origin_node_id"), _c("trip_request_id")
    step = F.when(k % 3 == 0, 5).when(k % 3 == 1, 24).otherwise(3)
    path = F.array((o * 25 + (o + 1) % 25).cast("int"), (((o + 1) % 25) * 25 + (o + 1 + step) % 25).cast("int"))
    trip = t.trip().select("trip_request_id", "destination_node_id", path.alias("path"))
    link = t.link()
    hops = trip.select("trip_request_id", F.posexplode("path").alias("pos", "link_id"), F.size("path").alias("n"), "path", "destination_node_id").withColumn("next", F.try_element_at("path", _c("pos") + 2))
    legal = t.turn(link).where("NOT is_forbidden").select(_c("from_link_id").alias("link_id"), _c("to_link_id").alias("next"), F.lit(True).alias("turn"))
    ends = link.select("link_id", _c("dst_node_id"))
    x = hops.join(legal, ["link_id", "next"], "left").join(ends, "link_id", "left")
    last = _c("pos") == _c("n") - 1
    ok = F.when(last, _c("dst_node_id").isNotNull()).otherwise(F.coalesce("turn", F.lit(False)) & _c("dst_node_id").isNotNull())
    return x.groupBy("trip_request_id").agg(F.bool_and(ok).alias("legal"), F.bool_or(last & F.coalesce(_c("dst_node_id") == _c("destination_node_id"), F.lit(False))).alias("arrives"))


_SCHEDULES = "s(schedule_id, day_type, name) AS (VALUES (0, 'weekday', 'office'), (1, 'weekend', 'leisure'), (2, 'weekday', 'shift'), (3, 'weekday', 'school'))"


@query(f"""WITH {_SCHEDULES}, f AS (SELECT *, row_number() OVER (ORDER BY schedule_id) - 1 AS i, count(*) OVER () AS n FROM s WHERE day_type = 'weekday')
SELECT p.citizen_id, coalesce(CASE WHEN s.day_type = 'weekday' THEN s.name END, f.name) AS schedule FROM tf_profile p LEFT JOIN s ON s.schedule_id = p.behavior_profile_id % 5 JOIN f ON f.i = (p.citizen_id - 1 + f.n) % f.n""")
def citizen_schedule(t: Traffic) -> DataFrame:
    """A citizen's schedule; if it isn't for the day type, the one that its id falls on among those that are."""
    s = t.spark.createDataFrame([(0, "weekday", "office"), (1, "weekend", "leisure"), (2, "weekday", "shift"), (3, "weekday", "school")], "schedule_id int, day_type string, name string")
    fallback = s.where("day_type = 'weekday'").agg(F.transform(F.array_sort(F.collect_list(F.struct("schedule_id", "name"))), lambda x: x["name"]).alias("names"))
    p = t.profile().select("citizen_id", (_c("behavior_profile_id") % 5).alias("schedule_id")).join(F.broadcast(s), "schedule_id", "left").crossJoin(F.broadcast(fallback))  # one row
    return p.select("citizen_id", F.coalesce(F.when(_c("day_type") == "weekday", _c("name")), F.element_at("names", F.pmod(_c("citizen_id") - 1, F.size("names")).cast("int") + 1)).alias("schedule"))


@query("SELECT citizen_id, coalesce(nullif(CASE WHEN citizen_id % 3 = 0 THEN CAST(citizen_id % 25 AS INT) END, home_node_id), nullif(CASE WHEN citizen_id % 2 = 0 THEN CAST((citizen_id * 7) % 25 AS INT) END, home_node_id), CAST((home_node_id + 1) % 25 AS INT)) AS destination FROM tf_profile")
def destination_choice(t: Traffic) -> DataFrame:
    """Work, else a preferred place, else any; never where the citizen is."""
    k, home = _c("citizen_id"), _c("home_node_id")
    options = (F.when(k % 3 == 0, (k % 25).cast("int")), F.when(k % 2 == 0, ((k * 7) % 25).cast("int")))
    return t.profile().select("citizen_id", F.coalesce(*[F.nullif(o, home) for o in options], ((home + 1) % 25).cast("int")).alias("destination"))


@query("""SELECT n.zone_id, count(*) AS n_pois, CAST(sum(CASE WHEN p.c_nationkey % 5 = n.zone_id THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM customer p JOIN tf_node n ON n.node_id = p.c_nationkey JOIN tf_zone z ON z.zone_id = n.zone_id GROUP BY n.zone_id""")
def poi_access_validity(t: Traffic) -> DataFrame:
    """Places by the zone of their node, and those whose own zone is that one."""
    poi = t.table("customer").select(_c("c_nationkey").cast("int").alias("node_id"), (_c("c_nationkey") % 5).alias("poi_zone"))
    x = poi.join(t.node(), "node_id").join(t.zone().select("zone_id"), "zone_id")
    return x.groupBy("zone_id").agg(F.count("*").alias("n_pois"), F.count_if(_c("poi_zone") == _c("zone_id")).alias("n_valid"))


@query("""WITH a AS (SELECT citizen_id, home_node_id AS n FROM tf_profile WHERE citizen_id % 10 <> 0), b AS (SELECT citizen_id, CASE WHEN citizen_id % 4 = 0 THEN CAST((home_node_id + 1) % 25 AS INT) ELSE home_node_id END AS n FROM tf_profile WHERE citizen_id % 11 <> 0)
SELECT count(*) AS n_total, CAST(sum(CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL AND a.n = b.n THEN 1 ELSE 0 END) AS BIGINT) AS n_same, CAST(sum(CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL AND a.n <> b.n THEN 1 ELSE 0 END) AS BIGINT) AS n_moved,
CAST(sum(CASE WHEN b.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped, CAST(sum(CASE WHEN a.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_added FROM a FULL JOIN b ON a.citizen_id = b.citizen_id""")
def placement_comparison(t: Traffic) -> DataFrame:
    p = t.profile()
    a = p.where("citizen_id % 10 <> 0").select("citizen_id", _c("home_node_id").alias("before"))
    b = p.where("citizen_id % 11 <> 0").select("citizen_id", F.when(_c("citizen_id") % 4 == 0, ((_c("home_node_id") + 1) % 25).cast("int")).otherwise(_c("home_node_id")).alias("after"))
    x = a.join(b, "citizen_id", "full_outer")
    return x.agg(F.count("*").alias("n_total"), F.count_if(_c("before") == _c("after")).alias("n_same"), F.count_if(_c("before") != _c("after")).alias("n_moved"), F.count_if(_c("after").isNull()).alias("n_dropped"), F.count_if(_c("before").isNull()).alias("n_added"))


@query("""WITH f AS (SELECT link_id, length_m / free_flow_speed_mps AS cost, queue_vehicles AS x FROM tf_link), s AS (SELECT link_id, length_m / free_flow_speed_mps + CASE WHEN link_id % 3 = 0 THEN 5 ELSE 0 END AS cost, queue_vehicles + CASE WHEN link_id % 4 = 0 THEN 1 ELSE 0 END AS x FROM tf_link WHERE link_id % 50 <> 7)
SELECT count(*) AS n_pairs, CAST(sum(CASE WHEN f.x <> s.x THEN 1 ELSE 0 END) AS BIGINT) AS n_feature, CAST(sum(CASE WHEN f.cost <> s.cost THEN 1 ELSE 0 END) AS BIGINT) AS n_target, CAST(sum(CASE WHEN f.x <> s.x AND f.cost <> s.cost THEN 1 ELSE 0 END) AS BIGINT) AS n_joint,
(SELECT count(*) FROM f WHERE link_id NOT IN (SELECT link_id FROM s)) AS n_missing FROM f JOIN s ON f.link_id = s.link_id""")
def dynamic_response_pairing(t: Traffic) -> DataFrame:
    link = t.link()
    base = _c("length_m") / _c("free_flow_speed_mps")
    free = link.select("link_id", base.alias("cost"), _c("queue_vehicles").alias("x"))
    k = _c("link_id")
    stressed = link.where("link_id % 50 <> 7").select("link_id", (base + F.when(k % 3 == 0, 5).otherwise(0)).alias("cost2"), (_c("queue_vehicles") + F.when(k % 4 == 0, 1).otherwise(0)).alias("x2"))
    x = free.join(stressed, "link_id", "left")
    a, b = _c("x") != _c("x2"), _c("cost") != _c("cost2")
    return x.agg(F.count("cost2").alias("n_pairs"), F.count_if(a).alias("n_feature"), F.count_if(b).alias("n_target"), F.count_if(a & b).alias("n_joint"), F.count_if(_c("cost2").isNull()).alias("n_missing"))


_PATHS = """p AS (SELECT l1.src_node_id AS o, l2.dst_node_id AS d, l1.link_id AS a, l2.link_id AS b, l1.length_m AS la, l2.length_m AS lb FROM tf_link l1 JOIN tf_link l2 ON l2.src_node_id = l1.dst_node_id WHERE l1.src_node_id <> l2.dst_node_id)"""


def two_link_paths(t: Traffic) -> DataFrame:
    """Paths of two links between two nodes."""
    l = t.link().select("link_id", "src_node_id", "dst_node_id", "length_m", "queue_vehicles")
    a = l.select(_c("src_node_id").alias("o"), _c("dst_node_id").alias("m"), _c("link_id").alias("a"), _c("length_m").alias("la"), _c("queue_vehicles").alias("qa"))
    b = l.select(_c("src_node_id").alias("m"), _c("dst_node_id").alias("d"), _c("link_id").alias("b"), _c("length_m").alias("lb"), _c("queue_vehicles").alias("qb"))
    return a.join(b, "m").where("o <> d")


@query(f"""WITH {_PATHS}, u AS (SELECT o, d, a, b, la + lb AS total, a AS l, la AS len FROM p UNION ALL SELECT o, d, a, b, la + lb, b, lb FROM p), n AS (SELECT *, count(*) OVER (PARTITION BY o, d, l) AS usage FROM u)
SELECT o, d, a, b, round(greatest(sum(len / total / usage), 1e-12), 6) AS path_size FROM n GROUP BY o, d, a, b""")
def candidate_path_size(t: Traffic) -> DataFrame:
    """A path's links by their share of its length and how many paths of the pair use them."""
    p = two_link_paths(t).withColumn("total", _c("la") + _c("lb")).select("o", "d", "a", "b", "total", F.explode(F.array(F.struct(_c("a").alias("l"), _c("la").alias("len")), F.struct(_c("b").alias("l"), _c("lb").alias("len")))).alias("x"))
    p = p.withColumn("usage", F.count("*").over(Window.partitionBy("o", "d", "x.l")))
    return p.groupBy("o", "d", "a", "b").agg(F.round(F.greatest(F.sum(_c("x.len") / _c("total") / _c("usage")), F.lit(1e-12)), 6).alias("path_size"))


_RUNS = "r AS (SELECT od_id, arm % 2 AS adaptive, count(*) AS n, sum(CASE WHEN outcome = 'completed' THEN 1 ELSE 0 END) AS done, avg(observed_travel_time) AS tt FROM tf_outcome GROUP BY od_id, arm % 2)"


@query(f"""WITH {_RUNS} SELECT a.od_id, CAST(b.n - a.n AS BIGINT) AS d_generated, CAST(b.done - a.done AS BIGINT) AS d_completed, round(b.done / b.n - a.done / a.n, 6) AS d_rate, round(b.tt - a.tt, 6) AS d_travel_time FROM r a JOIN r b ON a.od_id = b.od_id WHERE a.adaptive = 0 AND b.adaptive = 1""")
def run_comparison(t: Traffic) -> DataFrame:
    """Baseline and adaptive runs of one scenario, and what differs."""
    r = t.outcome().groupBy("od_id", (_c("arm") % 2).alias("adaptive")).agg(F.count("*").alias("n"), F.count_if(_c("outcome") == "completed").alias("done"), F.avg("observed_travel_time").alias("tt"))
    a, b = (r.where(f"adaptive = {k}").select("od_id", F.struct("n", "done", "tt").alias(x)) for k, x in ((0, "a"), (1, "b")))
    d = lambda x: _c(f"b.{x}") - _c(f"a.{x}")
    return a.join(b, "od_id").select("od_id", d("n").alias("d_generated"), d("done").alias("d_completed"), F.round(_c("b.done") / _c("b.n") - _c("a.done") / _c("a.n"), 6).alias("d_rate"), F.round(d("tt"), 6).alias("d_travel_time"))


_ZONES = "z AS (SELECT zone_id, avg(x) AS cx, avg(y) AS cy FROM tf_node GROUP BY zone_id)"


@query(f"WITH {_ZONES}, d AS (SELECT n.node_id, z.zone_id, row_number() OVER (PARTITION BY n.node_id ORDER BY (n.x - z.cx) * (n.x - z.cx) + (n.y - z.cy) * (n.y - z.cy), z.zone_id) AS r FROM tf_node n CROSS JOIN z) SELECT node_id, zone_id FROM d WHERE r = 1")
def nearest_zone(t: Traffic) -> DataFrame:
    """The zone with the nearest centre; the few zones are each node's candidates."""
    z = t.node().groupBy("zone_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    centres = z.agg(F.collect_list(F.struct("zone_id", "cx", "cy")).alias("centres"))
    d = lambda c: (_c("x") - c["cx"]) * (_c("x") - c["cx"]) + (_c("y") - c["cy"]) * (_c("y") - c["cy"])
    n = t.node().select("node_id", "x", "y").crossJoin(F.broadcast(centres))  # one row
    return n.select("node_id", F.array_min(F.transform("centres", lambda c: F.struct(d(c).alias("d"), c["zone_id"].alias("zone_id"))))["zone_id"].alias("zone_id"))


@query("""WITH a AS (SELECT node_id, x, y FROM tf_node WHERE zone_id < 2), b AS (SELECT node_id, x, y FROM tf_node WHERE zone_id >= 2)
SELECT a.node_id AS a, b.node_id AS b FROM a CROSS JOIN b ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), a.node_id, b.node_id LIMIT 1""")
def nearest_component_pair(t: Traffic) -> DataFrame:
    """The nearest nodes of two components, by growing rings of grid cells."""
    from roadweave.operators.spatial import nearest_pair

    n = t.node().select("node_id", "x", "y")
    part = t.node().select("node_id", "zone_id")
    x = n.join(part, "node_id")
    return nearest_pair(x.where("zone_id < 2"), x.where("zone_id >= 2"))


_STAGES = "s(stage, target) AS (VALUES ('routing', 'gpu'), ('flow', 'gpu'), ('agents', 'cpu'))"


@query(f"WITH {_STAGES}, w AS (SELECT link_id, CASE link_id % 4 WHEN 0 THEN 'routing' WHEN 1 THEN 'flow' WHEN 2 THEN 'agents' ELSE 'other' END AS stage, road_class FROM tf_link) SELECT s.stage, s.target, count(*) AS n_workloads, string_agg(DISTINCT road_class, ',' ORDER BY road_class) AS classes FROM w JOIN s ON s.stage = w.stage GROUP BY s.stage, s.target")
def workload_cards(t: Traffic) -> DataFrame:
    """Workloads joined to the card of their stage, with the distinct classes."""
    cards = t.spark.createDataFrame([("routing", "gpu"), ("flow", "gpu"), ("agents", "cpu")], "stage string, target string")
    k = _c("link_id") % 4
    w = t.link().select(F.when(k == 0, "routing").when(k == 1, "flow").when(k == 2, "agents").otherwise("other").alias("stage"), "road_class")
    return w.join(F.broadcast(cards), "stage").groupBy("stage", "target").agg(F.count("*").alias("n_workloads"), F.array_join(F.array_sort(F.collect_set("road_class")), ",").alias("classes"))
