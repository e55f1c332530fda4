"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadweave.functions import geometry as G, learning as L
from roadweave.operators import features as X, flow as Flow
from roadweave.sources.traffic import Traffic

from . import query
from .elementwise import _REWARD
from .joins import _PATHS, state, two_link_paths

_c = F.col


def _r(x, n: int = 6):
    return F.round(x, n)


@query("SELECT l.link_id, round(coalesce(sum(t.turn_demand), 0.0), 6) AS turn_demand FROM tf_link l LEFT JOIN tf_turn t ON t.from_link_id = l.link_id AND t.turn_demand > 8 GROUP BY l.link_id")
def segment_sum(t: Traffic) -> DataFrame:
    link = t.link()
    return Flow.segment_sum(link.select(_c("link_id")), t.turn(link).where("turn_demand > 8").select(_c("from_link_id").alias("link_id"), "turn_demand"), "link_id", "turn_demand").withColumn("turn_demand", _r("turn_demand"))


_FLOW = """w AS (SELECT *, CASE WHEN is_forbidden THEN 0.0 ELSE turn_demand * base_priority END AS wd FROM tf_turn),
s AS (SELECT w.*, sum(wd) OVER (PARTITION BY from_link_id) AS fd, sum(wd) OVER (PARTITION BY to_link_id) AS td FROM w),
f AS (SELECT s.*, CASE WHEN is_forbidden THEN 0.0 ELSE least(least(lf.queue_vehicles, lf.capacity_veh_per_tick) * CASE WHEN fd > 0 THEN wd / fd ELSE 0.0 END, lt.capacity_veh_per_tick * CASE WHEN td > 0 THEN wd / td ELSE 0.0 END) END AS supply
FROM s JOIN tf_link lf ON s.from_link_id = lf.link_id JOIN tf_link lt ON s.to_link_id = lt.link_id),
g AS (SELECT *, least(turn_demand, supply) AS flow FROM f),
o AS (SELECT from_link_id AS link_id, sum(flow) AS outflow FROM g GROUP BY from_link_id), i AS (SELECT to_link_id AS link_id, sum(flow) AS inflow FROM g GROUP BY to_link_id)"""


@query(f"""WITH {_FLOW} SELECT l.link_id, round(coalesce(o.outflow, 0.0), 6) AS outflow, round(coalesce(i.inflow, 0.0), 6) AS inflow, round(greatest(0.0, l.queue_vehicles - coalesce(o.outflow, 0.0) + coalesce(i.inflow, 0.0)), 6) AS queue_next,
round(greatest(l.length_m / l.free_flow_speed_mps, 1e-3) + greatest(0.0, l.queue_vehicles - coalesce(o.outflow, 0.0) + coalesce(i.inflow, 0.0)) / greatest(l.capacity_veh_per_tick, 1e-3), 6) AS travel_time_next, coalesce(o.outflow, 0.0) > l.capacity_veh_per_tick + 1e-6 AS over_capacity
FROM tf_link l LEFT JOIN o ON l.link_id = o.link_id LEFT JOIN i ON l.link_id = i.link_id""")
def point_queue_step(t: Traffic) -> DataFrame:
    out = Flow.point_queue_step(t.turn(), state(t))
    return out.select("link_id", *[_r(x, 6).alias(x) for x in ("outflow", "inflow", "queue_next", "travel_time_next")], "over_capacity")


@query(f"WITH {_FLOW} SELECT from_link_id, to_link_id, round(supply, 6) AS supply, round(flow, 6) AS flow FROM g")
def turn_flows(t: Traffic) -> DataFrame:
    return Flow.turn_flows(t.turn(), state(t)).select("from_link_id", "to_link_id", _r("supply").alias("supply"), _r("flow").alias("flow"))


@query(f"""WITH {_FLOW}, x AS (SELECT from_link_id AS link_id, turn_demand > 0 AND flow > 0 AS e, true AS s FROM g UNION ALL SELECT to_link_id, turn_demand > 0 AND flow > 0, false FROM g)
SELECT l.link_id, coalesce(bool_or(e AND s), false) AS sends, coalesce(bool_or(e AND NOT s), false) AS receives FROM tf_link l LEFT JOIN x ON x.link_id = l.link_id GROUP BY l.link_id""")
def demand_flags(t: Traffic) -> DataFrame:
    return Flow.demand_flags(t.turn(), state(t))


def agent_paths(t: Traffic) -> DataFrame:
    """Active trips with a path of two links and the place of their vehicle in it."""
    o, k = _c("origin_node_id"), _c("trip_request_id")
    step = F.when(k % 2 == 0, 5).otherwise(24)
    path = F.array((o * 25 + (o + 1) % 25).cast("int"), (((o + 1) % 25) * 25 + (o + 1 + step) % 25).cast("int"))
    return t.trip().where("stage = 'active'").select(k.alias("agent_id"), path.alias("path"), (k % 5 % 2).cast("int").alias("at"), (k % 7 != 0).alias("ready"))


@query("""WITH a AS (SELECT CAST(origin_node_id * 25 + (origin_node_id + 1) % 25 AS INT) AS a, CAST(((origin_node_id + 1) % 25) * 25 + (origin_node_id + 1 + CASE WHEN trip_request_id % 2 = 0 THEN 5 ELSE 24 END) % 25 AS INT) AS b, trip_request_id % 5 % 2 AS pos FROM tf_trip WHERE stage = 'active' AND trip_request_id % 7 <> 0)
SELECT CASE WHEN pos = 0 THEN a ELSE b END AS from_link_id, CASE WHEN pos = 0 THEN b END AS to_link_id, count(*) AS n_agents FROM a GROUP BY 1, 2""")
def turn_demand_rebuild(t: Traffic) -> DataFrame:
    return Flow.turn_demand_of(agent_paths(t))


_TIMES = "m AS (SELECT a.zone_id AS o, b.zone_id AS d, avg(abs(a.x - b.x) + abs(a.y - b.y)) / 10.0 AS tt FROM tf_node a CROSS JOIN tf_node b GROUP BY a.zone_id, b.zone_id)"


def zone_times(t: Traffic) -> DataFrame:
    """Mean street distance of the nodes of two zones, as time. Sums over each zone's coordinates suffice: |x - y| splits at the sorted values."""
    n = t.node()
    axis = lambda c: n.groupBy("zone_id").agg(F.collect_list(c).alias(c))
    z = axis("x").join(axis("y"), "zone_id")
    zones = z.agg(F.collect_list(F.struct("zone_id", "x", "y")).alias("all"))
    p = z.crossJoin(F.broadcast(zones)).select(_c("zone_id").alias("o"), "x", "y", F.explode("all").alias("z"))  # zones by zones
    mean = lambda a, b: F.aggregate(a, F.lit(0.0), lambda s, p: s + F.aggregate(b, F.lit(0.0), lambda r, q: r + F.abs(p - q))) / (F.size(a) * F.size(b))
    return p.select("o", _c("z.zone_id").alias("d"), ((mean(_c("x"), _c("z.x")) + mean(_c("y"), _c("z.y"))) / 10.0).alias("tt"))


@query(f"WITH {_TIMES} SELECT o, d, round(tt / greatest(job_capacity / 1000.0, 1), 6) AS cost FROM m JOIN tf_zone z ON z.zone_id = m.d")
def accessibility_matrix(t: Traffic) -> DataFrame:
    z = t.zone().select(_c("zone_id").alias("d"), F.greatest(_c("job_capacity") / 1000.0, F.lit(1.0)).alias("jobs"))
    return zone_times(t).join(F.broadcast(z), "d").select("o", "d", _r(_c("tt") / _c("jobs")).alias("cost"))


@query(f"WITH {_TIMES} SELECT o AS zone_id, round(1 / greatest(avg(tt), 1e-6), 6) AS accessibility FROM m GROUP BY o")
def zonal_accessibility(t: Traffic) -> DataFrame:
    return zone_times(t).groupBy(_c("o").alias("zone_id")).agg(_r(1 / F.greatest(F.avg("tt"), F.lit(1e-6))).alias("accessibility"))


@query("""WITH p AS (SELECT l1.link_id AS a, l2.link_id AS b, l1.queue_vehicles + l2.queue_vehicles AS cost, l1.src_node_id AS o, l2.dst_node_id AS d FROM tf_link l1 JOIN tf_link l2 ON l2.src_node_id = l1.dst_node_id) SELECT a, b, round(cost, 4) AS cost FROM p WHERE o <> d""")
def path_cost(t: Traffic) -> DataFrame:
    return two_link_paths(t).select("a", "b", _r(F.aggregate(F.array("qa", "qb"), F.lit(0.0), lambda s, x: s + x), 4).alias("cost"))


@query(f"WITH {_PATHS} SELECT a, b, round(CASE WHEN la + lb <= 0 THEN 1.0 ELSE greatest(la / (la + lb) / 3 + lb / (la + lb) / 3, 1e-12) END, 6) AS factor FROM p")
def path_size_simple(t: Traffic) -> DataFrame:
    from roadweave.functions.routing import path_size_factor

    return two_link_paths(t).select("a", "b", _r(path_size_factor(F.array("la", "lb"), F.lit(3))).alias("factor"))


_STREETS = """e AS (SELECT DISTINCT least(src_node_id, dst_node_id) AS u, greatest(src_node_id, dst_node_id) AS v FROM tf_link), g AS (SELECT u, v, b.x - a.x AS dx, b.y - a.y AS dy FROM e JOIN tf_node a ON a.node_id = u JOIN tf_node b ON b.node_id = v),
k AS (SELECT (degrees(atan2(dx, dy)) + 360) % 360 AS bearing FROM g UNION ALL SELECT (degrees(atan2(-dx, -dy)) + 360) % 360 FROM g),
h AS (SELECT floor(((bearing + 5) % 360) / 10) AS bin, count(*) AS n FROM k GROUP BY 1), ent AS (SELECT -sum(n / t * ln(n / t)) AS e FROM (SELECT n, sum(n) OVER () AS t FROM h)),
d AS (SELECT node, count(*) AS deg FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node)"""


def streets(t: Traffic, link: DataFrame | None = None) -> DataFrame:
    """Undirected streets of the links (of all, unless some are given) with the vector between their ends."""
    e = (t.link() if link is None else link).select(F.least("src_node_id", "dst_node_id").alias("u"), F.greatest("src_node_id", "dst_node_id").alias("v")).distinct()
    n = t.node()
    a = n.select(_c("node_id").alias("u"), _c("x").alias("ax"), _c("y").alias("ay"))
    b = n.select(_c("node_id").alias("v"), _c("x").alias("bx"), _c("y").alias("by"))
    return e.join(a, "u").join(b, "v")


@query(f"""WITH {_STREETS} SELECT round((SELECT e FROM ent), 6) AS entropy, round(1 - (((SELECT e FROM ent) - ln(4)) / (ln(36) - ln(4))) ** 2, 6) AS orientation_order, round((SELECT median(sqrt(dx * dx + dy * dy)) FROM g), 4) AS median_length,
round((SELECT avg(deg) FROM d), 6) AS mean_degree, round((SELECT avg(CASE WHEN deg = 1 THEN 1.0 ELSE 0.0 END) FROM d), 6) AS dead_end_share, round((SELECT avg(CASE WHEN deg = 4 THEN 1.0 ELSE 0.0 END) FROM d), 6) AS four_way_share""")
def street_morphometrics(t: Traffic) -> DataFrame:
    """Orientation entropy over 36 bins in both directions, median length and node degrees."""
    s = streets(t)
    dx, dy = _c("bx") - _c("ax"), _c("by") - _c("ay")
    both = s.select(F.explode(F.array(G.bearing(dx, dy), G.bearing(-dx, -dy))).alias("b"))
    counts = both.groupBy(G.bearing_bin(_c("b")).alias("bin")).agg(F.count("*").alias("n")).agg(F.collect_list("n").alias("n"), F.sum("n").alias("t"))
    entropy = counts.select(F.aggregate("n", F.lit(0.0), lambda a, x: a - x / _c("t") * F.log(x / _c("t"))).alias("entropy"))
    length = s.agg(F.median(F.hypot(dx, dy)).alias("median_length"))
    degree = s.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    shares = degree.agg(F.avg("deg").alias("mean_degree"), F.avg((_c("deg") == 1).cast("double")).alias("dead_end_share"), F.avg((_c("deg") == 4).cast("double")).alias("four_way_share"))
    x = entropy.crossJoin(length).crossJoin(shares)  # single rows
    order = 1 - F.pow((_c("entropy") - F.log(F.lit(4.0))) / (F.log(F.lit(36.0)) - F.log(F.lit(4.0))), 2)
    return x.select(_r("entropy").alias("entropy"), _r(order).alias("orientation_order"), _r("median_length", 4).alias("median_length"), *[_r(c).alias(c) for c in ("mean_degree", "dead_end_share", "four_way_share")])


@query(f"""WITH {_STREETS}, q AS (SELECT DISTINCT floor((a.x + i * dx / 20.0) / 500) AS cx, floor((a.y + i * dy / 20.0) / 500) AS cy FROM g JOIN tf_node a ON a.node_id = g.u CROSS JOIN range(0, 21) r(i))
SELECT count(*) AS n_cells, round(count(*) / 81.0, 6) AS share FROM q""")
def grid_cell_presence(t: Traffic) -> DataFrame:
    """Cells hit by points sampled along each street, and their share of the cells of the whole area."""
    p = streets(t).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20))))
    at = lambda a, b: F.floor((_c(a) + _c("i") * (_c(b) - _c(a)) / 20.0) / 500)
    n = p.select(at("ax", "bx").alias("cx"), at("ay", "by").alias("cy")).distinct().agg(F.count("*").alias("n_cells"))
    return n.select("n_cells", _r(_c("n_cells") / 81.0).alias("share"))


_FEATURES = """l AS (SELECT *, length_m / free_flow_speed_mps + queue_vehicles / capacity_veh_per_tick AS cost, capacity_veh_per_tick * CASE WHEN link_id % 6 = 0 THEN 0.0 ELSE 1.0 END AS cap FROM tf_link), b AS (SELECT *, cap <= 0 AND is_blockable AS blocked FROM l),
o AS (SELECT src_node_id AS node_id, count(*) AS out_degree, min(CASE WHEN NOT blocked THEN cost END) AS out_min, avg(CASE WHEN NOT blocked THEN cost END) AS out_mean, sum(cap) AS out_cap, avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END) AS out_blocked FROM b GROUP BY src_node_id),
i AS (SELECT dst_node_id AS node_id, count(*) AS in_degree, avg(CASE WHEN NOT blocked THEN cost END) AS in_mean, sum(cap) AS in_cap, avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END) AS in_blocked FROM b GROUP BY dst_node_id)"""


def node_features(t: Traffic) -> DataFrame:
    """Degrees, costs, capacities and blocked shares of each node's links."""
    cap = _c("capacity_veh_per_tick") * F.when(_c("link_id") % 6 == 0, 0.0).otherwise(1.0)
    b = t.link().withColumn("cost", _c("length_m") / _c("free_flow_speed_mps") + _c("queue_vehicles") / _c("capacity_veh_per_tick")).withColumn("cap", cap).withColumn("blocked", (_c("cap") <= 0) & _c("is_blockable"))
    usable = F.when(~_c("blocked"), _c("cost"))
    gone = F.avg(_c("blocked").cast("double"))
    o = b.groupBy(_c("src_node_id").alias("node_id")).agg(F.count("*").alias("out_degree"), F.min(usable).alias("out_min"), F.avg(usable).alias("out_mean"), F.sum("cap").alias("out_cap"), gone.alias("out_blocked"))
    i = b.groupBy(_c("dst_node_id").alias("node_id")).agg(F.count("*").alias("in_degree"), F.avg(usable).alias("in_mean"), F.sum("cap").alias("in_cap"), gone.alias("in_blocked"))
    return t.node().join(o, "node_id", "left").join(i, "node_id", "left")


@query(f"WITH {_FEATURES} SELECT n.node_id, out_degree, in_degree, round(out_min, 6) AS out_min, round(out_mean, 6) AS out_mean, round(in_mean, 6) AS in_mean, round(out_cap, 4) AS out_cap, round(in_cap, 4) AS in_cap, round(out_blocked, 6) AS out_blocked, round(in_blocked, 6) AS in_blocked FROM tf_node n LEFT JOIN o ON o.node_id = n.node_id LEFT JOIN i ON i.node_id = n.node_id")
def node_feature_aggregates(t: Traffic) -> DataFrame:
    x = node_features(t)
    return x.select("node_id", "out_degree", "in_degree", *[_r(c, 4 if "cap" in c else 6).alias(c) for c in ("out_min", "out_mean", "in_mean", "out_cap", "in_cap", "out_blocked", "in_blocked")])


_INPUTS = """eff AS (SELECT *, capacity * multiplier AS ec, capacity * multiplier <= 0 AND blockable AS blocked FROM l),
o AS (SELECT network, src AS node_id, count(*) AS deg, min(CASE WHEN NOT blocked THEN travel END) AS mn, avg(CASE WHEN NOT blocked THEN travel END) AS mean, sum(ec) AS cap, avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END) AS shut FROM eff GROUP BY ALL),
i AS (SELECT network, dst AS node_id, count(*) AS deg, min(CASE WHEN NOT blocked THEN travel END) AS mn, avg(CASE WHEN NOT blocked THEN travel END) AS mean, sum(ec) AS cap, avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END) AS shut FROM eff GROUP BY ALL),
f AS (SELECT n.*, coalesce(o.deg, 0) AS od, coalesce(i.deg, 0) AS idg, coalesce(o.mn, 0.0) AS omin, coalesce(o.mean, 0.0) AS omean, coalesce(i.mean, 0.0) AS imean, coalesce(o.cap, 0.0) AS ocap, coalesce(i.cap, 0.0) AS icap, coalesce(o.shut, 0.0) AS oshut, coalesce(i.shut, 0.0) AS ishut, CASE WHEN o.mn IS NULL THEN 0.0 ELSE 1.0 END AS ho, CASE WHEN i.mn IS NULL THEN 0.0 ELSE 1.0 END AS hi FROM n LEFT JOIN o ON o.network = n.network AND o.node_id = n.node_id LEFT JOIN i ON i.network = n.network AND i.node_id = n.node_id),
g AS (SELECT network, greatest(max(od), max(idg), 1) AS md, greatest(max(ocap), max(icap), 1e-6) AS mc, greatest(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 1.0) AS diag FROM f GROUP BY network),
h AS (SELECT network, greatest(max(travel), 1e-6) AS mt, avg(travel) / greatest(max(travel), 1e-6) AS gm, avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END) AS gb FROM eff GROUP BY network),
inputs AS (SELECT f.network, t.node_id AS destination_id, f.node_id, (f.x - t.x) / diag AS relative_x_by_spatial_diagonal, (f.y - t.y) / diag AS relative_y_by_spatial_diagonal, sqrt((f.x - t.x) ** 2 + (f.y - t.y) ** 2) / diag AS euclidean_distance_by_spatial_diagonal, f.idg / md AS node_in_degree_by_max, f.od / md AS node_out_degree_by_max, t.idg / md AS destination_in_degree_by_max, t.od / md AS destination_out_degree_by_max,
f.omin / mt AS usable_outgoing_travel_time_min_by_max, f.omean / mt AS usable_outgoing_travel_time_mean_by_max, f.imean / mt AS usable_incoming_travel_time_mean_by_max, f.ocap / mc AS outgoing_effective_capacity_sum_by_max, f.icap / mc AS incoming_effective_capacity_sum_by_max, f.oshut AS outgoing_blocked_link_fraction, f.ishut AS incoming_blocked_link_fraction, mt AS global_max_travel_time_by_one_tick, gm AS global_mean_travel_time_by_max, gb AS global_blocked_link_fraction,
f.ho AS has_usable_outgoing, f.hi AS has_usable_incoming, CASE WHEN f.node_id = t.node_id THEN 1.0 ELSE 0.0 END AS is_destination FROM f JOIN d ON d.network = f.network JOIN f t ON t.network = d.network AND t.node_id = d.destination_id JOIN g ON g.network = f.network JOIN h ON h.network = f.network)"""
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in X.INPUTS)
_QUARTERS = """jn AS (SELECT *, CAST(floor(junction_id / 320) * 5 + floor(junction_id % 40 / 8) AS BIGINT) AS network FROM tf_junction), n AS (SELECT network, junction_id AS node_id, x, y FROM jn),
w AS (SELECT 2 * street_id AS link_id, u AS src, v AS dst, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS length, street_id % 8 AS way FROM tf_street UNION ALL SELECT 2 * street_id + 1, v, u, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2), street_id % 8 FROM tf_street WHERE NOT one_way),
l AS (SELECT a.network, w.link_id, w.src, w.dst, w.length / CASE WHEN way = 4 THEN 15.0 ELSE 10.0 END AS travel, CASE WHEN way = 4 THEN 40.0 ELSE 20.0 END AS capacity, CASE WHEN a.balance < -500 THEN 0.0 WHEN a.balance < 0 THEN 0.5 ELSE 1.0 END AS multiplier, way <> 4 AS blockable FROM w JOIN jn a ON a.junction_id = w.src JOIN jn b ON b.junction_id = w.dst AND b.network = a.network),
d AS (SELECT network, min(dst) AS destination_id FROM l GROUP BY network UNION SELECT network, max(dst) FROM l GROUP BY network)"""


def quarters(t: Traffic) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, destinations): the street network in quarters of eight by eight junctions, each a network of its own with two destinations."""
    j = t.junction().withColumn("network", (F.floor(_c("junction_id") / 320) * 5 + F.floor(_c("junction_id") % 40 / 8)).cast("long"))
    s = t.street().select("street_id", "u", "v", F.hypot(_c("bx") - _c("ax"), _c("by") - _c("ay")).alias("length"), "one_way", (_c("street_id") % 8).alias("way"))
    both = s.select((2 * _c("street_id")).alias("link_id"), _c("u").alias("src"), _c("v").alias("dst"), "length", "way").union(s.where("NOT one_way").select(2 * _c("street_id") + 1, "v", "u", "length", "way"))
    a = j.select(_c("junction_id").alias("src"), "network", "balance")
    b = j.select(_c("junction_id").alias("dst"), "network")
    wide = _c("way") == 4
    links = both.join(a, "src").join(b, ["dst", "network"]).select(
        "network", "link_id", "src", "dst", "length", F.when(wide, 15.0).otherwise(10.0).alias("speed"), F.when(wide, 2).otherwise(1).alias("lanes"), F.when(wide, "arterial").otherwise("local").alias("road_class"),
        (_c("length") / F.when(wide, 15.0).otherwise(10.0)).alias("travel"), F.when(wide, 40.0).otherwise(20.0).alias("capacity"), F.when(_c("balance") < -500, 0.0).when(_c("balance") < 0, 0.5).otherwise(1.0).alias("multiplier"), (~wide).alias("blockable"),
    )
    goals = links.groupBy("network").agg(F.array(F.min("dst"), F.max("dst")).alias("d")).select("network", F.explode("d").alias("destination_id")).distinct()
    return j.select("network", _c("junction_id").alias("node_id"), "x", "y"), links, goals


@query(f"WITH {_QUARTERS}, {_INPUTS} SELECT network, destination_id, node_id, {_ROUNDED} FROM inputs")
def model_inputs(t: Traffic) -> DataFrame:
    """The twenty inputs of each node and destination of the quarters."""
    x = X.model_inputs(*quarters(t))
    return x.select("network", "destination_id", "node_id", *[_r(c).alias(c) for c in X.INPUTS])


_COLUMNS = f"""u AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in X.INPUTS)} FROM inputs) ON {', '.join(X.INPUTS)} INTO NAME feature VALUE value),
audit AS (SELECT feature, min(value) AS least, max(value) AS most, avg(value) AS mean, stddev_pop(value) AS std, avg(CASE WHEN abs(value) > 1e-9 THEN 1.0 ELSE 0.0 END) AS nonzero_share FROM u GROUP BY feature)"""


def _column_audit(t: Traffic) -> DataFrame:
    """A row for each of the twenty inputs over all nodes and destinations of the quarters."""
    u = X.model_inputs(*quarters(t)).unpivot([], list(X.INPUTS), "feature", "value")
    return u.groupBy("feature").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.avg((F.abs("value") > 1e-9).cast("double")).alias("nonzero_share"))


@query(f"WITH {_QUARTERS}, {_INPUTS}, {_COLUMNS} SELECT feature, round(least, 4) AS min, round(most, 4) AS max, round(mean, 4) AS mean, round(std, 4) AS std, round(nonzero_share, 6) AS nonzero_share, std <= 1e-9 AS near_constant FROM audit")
def feature_column_audit(t: Traffic) -> DataFrame:
    x = _column_audit(t)
    return x.select("feature", _r("least", 4).alias("min"), _r("most", 4).alias("max"), _r("mean", 4).alias("mean"), _r("std", 4).alias("std"), _r("nonzero_share").alias("nonzero_share"), (_c("std") <= 1e-9).alias("near_constant"))


@query(f"""WITH {_QUARTERS}, {_INPUTS}, {_COLUMNS}, v AS (SELECT 'near_constant' AS rule, feature FROM audit WHERE std <= 1e-9 UNION ALL SELECT 'outside_range', feature FROM audit WHERE feature <> 'global_max_travel_time_by_one_tick' AND (most > 1 + 1e-9 OR least < CASE WHEN feature IN ('relative_x_by_spatial_diagonal', 'relative_y_by_spatial_diagonal') THEN -1 ELSE 0 END - 1e-9)
UNION ALL SELECT 'hardly_used', feature FROM audit WHERE nonzero_share < 0.02), r AS (SELECT unnest(['near_constant', 'outside_range', 'hardly_used', 'networks']) AS rule)
SELECT r.rule, CASE WHEN r.rule = 'networks' THEN (SELECT count(DISTINCT network) FROM inputs) ELSE count(v.rule) END AS n, CASE WHEN r.rule = 'networks' THEN (SELECT count(DISTINCT network) FROM inputs) >= 10 ELSE count(v.rule) = 0 END AS passed FROM r LEFT JOIN v ON v.rule = r.rule GROUP BY r.rule""")
def audit_gate(t: Traffic) -> DataFrame:
    """The gate on the inputs' audit: no column nearly constant, out of its range or hardly used, and ten networks or more."""
    signed = _c("feature").isin("relative_x_by_spatial_diagonal", "relative_y_by_spatial_diagonal")
    outside = (_c("feature") != "global_max_travel_time_by_one_tick") & ((_c("most") > 1 + 1e-9) | (_c("least") < F.when(signed, -1).otherwise(0) - 1e-9))
    one = _column_audit(t).agg(F.count_if(_c("std") <= 1e-9).alias("near_constant"), F.count_if(outside).alias("outside_range"), F.count_if(_c("nonzero_share") < 0.02).alias("hardly_used"))
    networks = quarters(t)[1].agg(F.count_distinct("network").alias("networks"))
    rows = one.join(networks, F.lit(True)).unpivot([], ["near_constant", "outside_range", "hardly_used", "networks"], "rule", "n")  # one row
    return rows.withColumn("passed", F.when(_c("rule") == "networks", _c("n") >= 10).otherwise(_c("n") == 0))


@query("""WITH m AS (SELECT min(observed_travel_time) AS lo, max(observed_travel_time) - min(observed_travel_time) AS span FROM tf_outcome),
q AS (SELECT round_even((observed_travel_time - lo) / CASE WHEN span > 1e-12 THEN span ELSE 1.0 END / 0.05, 0) AS k, arm, od_id, observed_travel_time / baseline_travel_time AS target FROM tf_outcome CROSS JOIN m),
g AS (SELECT k, arm, count(*) AS n, count(DISTINCT od_id) AS maps, max(target) - min(target) AS spread FROM q GROUP BY k, arm), c AS (SELECT * FROM g WHERE n >= 2 AND maps >= 2)
SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_covered, round(sum(n) / (SELECT count(*) FROM tf_outcome), 6) AS coverage_share, CAST(sum(CASE WHEN spread > 0.1 THEN n ELSE 0 END) AS BIGINT) AS n_conflicting, round(sum(CASE WHEN spread > 0.1 THEN n ELSE 0 END) / greatest(sum(n), 1), 6) AS conflict_share FROM c""")
def near_duplicate_conflicts(t: Traffic) -> DataFrame:
    """Rows alike after scaling and rounding that come from several maps, and those of them whose targets differ too much."""
    x = t.outcome()
    m = x.agg(F.min("observed_travel_time").alias("lo"), (F.max("observed_travel_time") - F.min("observed_travel_time")).alias("span"), F.count("*").alias("total"))
    q = x.crossJoin(F.broadcast(m))  # one row
    q = q.withColumn("k", F.bround((_c("observed_travel_time") - _c("lo")) / F.when(_c("span") > 1e-12, _c("span")).otherwise(1.0) / 0.05, 0)).withColumn("target", _c("observed_travel_time") / _c("baseline_travel_time"))
    g = q.groupBy("k", "arm").agg(F.count("*").alias("n"), F.count_distinct("od_id").alias("maps"), (F.max("target") - F.min("target")).alias("spread"), F.first("total").alias("total")).where("n >= 2 AND maps >= 2")
    bad = F.sum(F.when(_c("spread") > 0.1, _c("n")).otherwise(0))
    return g.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_covered"), _r(F.sum("n") / F.first("total")).alias("coverage_share"), bad.alias("n_conflicting"), _r(bad / F.greatest(F.sum("n"), F.lit(1))).alias("conflict_share"))


@query("""WITH s AS (SELECT od_id AS seed, arm AS stage, sum(observed_travel_time) AS ns FROM tf_outcome WHERE NOT (od_id % 4 = 0 AND arm = 1) GROUP BY od_id, arm), w AS (SELECT seed, sum(ns) AS total FROM s GROUP BY seed),
x AS (SELECT w.seed, a.stage, coalesce(s.ns, 0.0) / w.total AS share, coalesce(s.ns, 0.0) AS ns FROM w CROSS JOIN (SELECT DISTINCT stage FROM s) a LEFT JOIN s ON s.seed = w.seed AND s.stage = a.stage)
SELECT stage, round(min(share), 6) AS min_share, round(avg(share), 6) AS mean_share, round(max(share), 6) AS max_share, round(max(ns), 4) AS max_ns, min(share) >= 0.05 AND bool_and(share >= 0.05) AND count(*) >= 3 AS eligible FROM x GROUP BY stage""")
def stage_share_gate(t: Traffic) -> DataFrame:
    """Shares of the stages over all runs, a missing stage counting 0."""
    s = t.outcome().where("NOT (od_id % 4 = 0 AND arm = 1)").groupBy(_c("od_id").alias("seed"), _c("arm").alias("stage")).agg(F.sum("observed_travel_time").alias("ns"))
    runs = s.groupBy("seed").agg(F.sum("ns").alias("total"), F.map_from_entries(F.collect_list(F.struct("stage", "ns"))).alias("by"))
    stages = s.agg(F.collect_set("stage").alias("stages"))
    x = runs.crossJoin(F.broadcast(stages)).select("total", "by", F.explode("stages").alias("stage"))  # one row
    ns = F.coalesce(F.try_element_at("by", _c("stage")), F.lit(0.0))
    x = x.select("stage", ns.alias("ns"), (ns / _c("total")).alias("share"))
    ok = (F.min("share") >= 0.05) & F.bool_and(_c("share") >= 0.05) & (F.count("*") >= 3)
    return x.groupBy("stage").agg(_r(F.min("share")).alias("min_share"), _r(F.avg("share")).alias("mean_share"), _r(F.max("share")).alias("max_share"), _r(F.max("ns"), 4).alias("max_ns"), ok.alias("eligible"))


@query("SELECT od_id, round(quantile_cont(observed_travel_time, 0.1), 4) AS p10, round(quantile_cont(observed_travel_time, 0.5), 4) AS p50, round(quantile_cont(observed_travel_time, 0.95), 4) AS p95 FROM tf_outcome GROUP BY od_id")
def benchmark_quantiles(t: Traffic) -> DataFrame:
    p = t.outcome().groupBy("od_id").agg(F.percentile("observed_travel_time", [0.1, 0.5, 0.95]).alias("p"))
    return p.select("od_id", *[_r(_c("p")[k], 4).alias(n) for k, n in enumerate(("p10", "p50", "p95"))])


@query("SELECT CAST(sum(CASE WHEN stage = 'pending' AND planned_depart_tick > 30 THEN 1 ELSE 0 END) AS BIGINT) AS n_queued, CAST(sum(CASE WHEN stage = 'pending' AND planned_depart_tick <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS n_activated, CAST(sum(CASE WHEN stage = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS n_pending FROM tf_trip WHERE trip_request_id NOT IN (SELECT trip_id FROM tf_outcome WHERE outcome = 'failed')")
def demand_lifecycle_counts(t: Traffic) -> DataFrame:
    gone = t.outcome().where("outcome = 'failed'").select(_c("trip_id").alias("trip_request_id"))
    x = t.trip().join(gone, "trip_request_id", "left_anti")
    p = _c("stage") == "pending"
    return x.agg(F.count_if(p & (_c("planned_depart_tick") > 30)).alias("n_queued"), F.count_if(p & (_c("planned_depart_tick") <= 30)).alias("n_activated"), F.count_if(p).alias("n_pending"))


@query("""SELECT count(*) AS n_generated, CAST(sum(CASE WHEN stage = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS n_completed, CAST(sum(CASE WHEN stage = 'active' THEN 1 ELSE 0 END) AS BIGINT) AS n_active, CAST(sum(CASE WHEN stage = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS n_pending,
round(avg(CASE WHEN stage = 'completed' THEN 1.0 ELSE 0.0 END), 6) AS completion_rate, (SELECT round(sum(queue_vehicles), 4) FROM tf_link) AS queue_total, (SELECT CAST(sum(CASE WHEN queue_vehicles > capacity_veh_per_tick THEN 1 ELSE 0 END) AS BIGINT) FROM tf_link) AS n_saturated,
(SELECT round(avg(CASE WHEN road_class = 'collector' THEN 1.0 ELSE 0.0 END), 6) FROM tf_link) AS collector_share, (SELECT count(*) FROM tf_event WHERE 30 BETWEEN start_tick AND end_tick) AS n_active_events FROM tf_trip""")
def run_summary(t: Traffic) -> DataFrame:
    s = lambda x: F.count_if(_c("stage") == x)
    trips = t.trip().agg(F.count("*").alias("n_generated"), s("completed").alias("n_completed"), s("active").alias("n_active"), s("pending").alias("n_pending"), _r(F.avg((_c("stage") == "completed").cast("double"))).alias("completion_rate"))
    links = t.link().agg(_r(F.sum("queue_vehicles"), 4).alias("queue_total"), F.count_if(_c("queue_vehicles") > _c("capacity_veh_per_tick")).alias("n_saturated"), _r(F.avg((_c("road_class") == "collector").cast("double"))).alias("collector_share"))
    events = t.event().where("start_tick <= 30 AND end_tick >= 30").agg(F.count("*").alias("n_active_events"))
    return trips.crossJoin(links).crossJoin(events)  # single rows


@query("SELECT round(avg(CASE WHEN road_class = 'collector' THEN 1.0 ELSE 0.0 END), 6) AS share FROM tf_link")
def collector_link_share(t: Traffic) -> DataFrame:
    return t.link().agg(_r(F.avg((_c("road_class") == "collector").cast("double"))).alias("share"))


@query(f"""WITH a AS (SELECT od_id, arm, avg({_REWARD}) AS score FROM tf_outcome GROUP BY od_id, arm), r AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY arm) - 1 AS pos, row_number() OVER (PARTITION BY od_id ORDER BY score DESC, arm) AS best FROM a)
SELECT CAST(pos AS INT) AS pos, round(avg(score), 6) AS mean_score, round(sum(CASE WHEN best = 1 THEN 1.0 ELSE 0.0 END) / (SELECT count(DISTINCT od_id) FROM a), 6) AS prior FROM r GROUP BY pos""")
def surrogate_fit(t: Traffic) -> DataFrame:
    """Mean score of each candidate's place, and how often that place is the best one."""
    a = t.outcome().groupBy("od_id", "arm").agg(F.avg(L.trip_reward(_c("outcome"), _c("observed_travel_time"), _c("baseline_travel_time"))).alias("score"))
    sets = a.groupBy("od_id").agg(F.array_sort(F.collect_list(F.struct("arm", "score"))).alias("s"))
    best = F.array_max(F.transform("s", lambda x: F.struct(x["score"].alias("score"), (-x["arm"]).alias("k"))))
    x = sets.withColumn("best", -best["k"]).select("best", F.posexplode("s").alias("pos", "x"))
    n = sets.agg(F.count("*").alias("n"))
    g = x.groupBy("pos").agg(F.avg("x.score").alias("mean"), F.count_if(_c("x.arm") == _c("best")).alias("hits")).crossJoin(n)  # one row
    return g.select("pos", _r("mean").alias("mean_score"), _r(_c("hits") / _c("n")).alias("prior"))


@query("SELECT count(*) AS generated, CAST(sum(CASE WHEN stage IN ('pending', 'active', 'completed') THEN 1 ELSE 0 END) AS BIGINT) AS accounted, abs(count(*) - sum(CASE WHEN stage IN ('pending', 'active', 'completed') THEN 1 ELSE 0 END)) <= 1e-6 AS conserved FROM tf_trip")
def conservation_check(t: Traffic) -> DataFrame:
    n = F.count_if(_c("stage").isin("pending", "active", "completed"))
    return t.trip().agg(F.count("*").alias("generated"), n.alias("accounted"), (F.abs(F.count("*") - n) <= 1e-6).alias("conserved"))


_METRICS = "m AS (SELECT od_id AS city, avg(observed_travel_time) AS mean_time, avg(CASE WHEN outcome = 'failed' THEN 1.0 ELSE 0.0 END) AS failed_share FROM tf_outcome GROUP BY od_id), u AS (UNPIVOT m ON mean_time, failed_share INTO NAME metric VALUE value), env AS (SELECT metric, greatest(0.0, min(value) * 0.8) AS low, CASE WHEN metric = 'failed_share' THEN least(1.0, max(value) * 1.2) ELSE max(value) * 1.2 END AS high FROM u WHERE city % 2 = 0 GROUP BY metric)"


def _metrics(t: Traffic) -> DataFrame:
    m = t.outcome().groupBy(_c("od_id").alias("city")).agg(F.avg("observed_travel_time").alias("mean_time"), F.avg((_c("outcome") == "failed").cast("double")).alias("failed_share"))
    return m.unpivot(["city"], ["mean_time", "failed_share"], "metric", "value")


def _envelopes(t: Traffic) -> DataFrame:
    high = F.when(_c("metric") == "failed_share", F.least(F.lit(1.0), F.max("value") * 1.2)).otherwise(F.max("value") * 1.2)
    return _metrics(t).where("city % 2 = 0").groupBy("metric").agg(F.greatest(F.lit(0.0), F.min("value") * 0.8).alias("low"), high.alias("high"))


@query(f"WITH {_METRICS} SELECT metric, round(low, 6) AS low, round(high, 6) AS high FROM env")
def empirical_envelopes(t: Traffic) -> DataFrame:
    return _envelopes(t).select("metric", _r("low").alias("low"), _r("high").alias("high"))


@query(f"WITH {_METRICS} SELECT u.city % 4 AS style, u.metric, count(*) AS n, CAST(sum(CASE WHEN value BETWEEN low AND high THEN 1 ELSE 0 END) AS BIGINT) AS n_pass, round(median(value), 6) AS median FROM u JOIN env ON env.metric = u.metric GROUP BY u.city % 4, u.metric")
def style_summaries(t: Traffic) -> DataFrame:
    x = _metrics(t).join(F.broadcast(_envelopes(t)), "metric")
    return x.groupBy((_c("city") % 4).alias("style"), "metric").agg(F.count("*").alias("n"), F.count_if(_c("value").between(_c("low"), _c("high"))).alias("n_pass"), _r(F.median("value")).alias("median"))


@query(f"WITH {_METRICS}, p AS (SELECT city % 2 AS arm, u.metric, value BETWEEN low AND high AS pass FROM u JOIN env ON env.metric = u.metric) SELECT arm, CAST(sum(CASE WHEN metric = 'failed_share' AND pass THEN 1 ELSE 0 END) AS BIGINT) AS failed_share, CAST(sum(CASE WHEN metric = 'mean_time' AND pass THEN 1 ELSE 0 END) AS BIGINT) AS mean_time FROM p GROUP BY arm")
def arm_summaries(t: Traffic) -> DataFrame:
    x = _metrics(t).join(F.broadcast(_envelopes(t)), "metric").withColumn("pass", _c("value").between(_c("low"), _c("high")).cast("long"))
    return x.groupBy((_c("city") % 2).alias("arm")).pivot("metric", ["failed_share", "mean_time"]).agg(F.sum("pass"))


@query("""WITH m AS (SELECT od_id, avg(CASE WHEN outcome = 'failed' THEN 1.0 ELSE 0.0 END) AS f, avg(observed_travel_time) AS a, count(*) AS n FROM tf_outcome GROUP BY od_id)
SELECT od_id, array_to_string(list_filter([CASE WHEN f > 0.15 THEN 'failed_share' END, CASE WHEN a > 51 THEN 'slow' END, CASE WHEN n < 480 THEN 'few' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m""")
def batch_quality_gate(t: Traffic) -> DataFrame:
    m = t.outcome().groupBy("od_id").agg(F.avg((_c("outcome") == "failed").cast("double")).alias("f"), F.avg("observed_travel_time").alias("a"), F.count("*").alias("n"))
    reasons = F.array_compact(F.array(F.when(_c("f") > 0.15, "failed_share"), F.when(_c("a") > 51, "slow"), F.when(_c("n") < 480, "few")))
    return m.select("od_id", F.array_join(reasons, ",").alias("reasons"))


@query("SELECT od_id, round(coalesce(avg(observed_travel_time - 60) FILTER (observed_travel_time >= 60), 0.0), 6) AS mean_positive FROM tf_outcome GROUP BY od_id")
def mean_positive(t: Traffic) -> DataFrame:
    x = _c("observed_travel_time") - 60
    return t.outcome().groupBy("od_id").agg(_r(F.coalesce(F.avg(F.when(x >= 0, x)), F.lit(0.0))).alias("mean_positive"))


@query("SELECT trip_id, od_id, arm, round(observed_travel_time / baseline_travel_time, 6) AS ratio FROM tf_outcome WHERE outcome IN ('completed', 'failed') AND observed_travel_time > 1 AND trip_id % 13 <> 0")
def experience_batch(t: Traffic) -> DataFrame:
    """Outcomes that are well formed: a row without a usable time is passed over."""
    time = F.when(_c("trip_id") % 13 != 0, _c("observed_travel_time").cast("string")).otherwise("n/a").try_cast("double")
    x = t.outcome().withColumn("time", time).where(_c("outcome").isin("completed", "failed") & _c("time").isNotNull() & (_c("time") > 1))
    return x.select("trip_id", "od_id", "arm", _r(_c("time") / _c("baseline_travel_time")).alias("ratio"))
