"""Plugins, packets, route splicing, and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadweave.functions import encoding as E
from roadweave.functions.routing import UNREACHABLE
from roadweave.operators import candidates as C, graph as G, policy, spatial
from roadweave.plans.loops import cut
from roadweave.sources.traffic import Traffic

from . import query
from .aggregates import agent_paths
from .elementwise import _BAR, _SCORE, _SETS, _sets
from .graphs import _NET, _SEG, network, segments

_c = F.col


@query(f"WITH s AS ({_SETS}) SELECT od_id, arm, round(reward - 0.01 * cost, 6) AS score FROM s")
def policy_plugin_scores(t: Traffic) -> DataFrame:
    return policy.scored(_sets(t), "linear", ["cost", "reward"]).select("od_id", "arm", F.round("score", 6).alias("score"))


@query("""WITH o AS (SELECT od_id, arm, trip_id <= (SELECT max(trip_id) FROM tf_outcome) / 2 AS early, CASE WHEN outcome = 'completed' THEN 1.0 ELSE 0.0 END AS reward FROM tf_outcome), a AS (SELECT DISTINCT od_id, arm FROM o), b AS (SELECT unnest([0, 1, 2]) AS batch),
s AS (SELECT a.od_id, a.arm, b.batch, count(o.od_id) AS pulls, sum(o.reward) AS total FROM a CROSS JOIN b LEFT JOIN o ON o.od_id = a.od_id AND o.arm = a.arm AND (b.batch = 2 OR (b.batch = 1 AND o.early)) GROUP BY ALL)
SELECT od_id, arm, CAST(batch AS INT) AS batch, pulls, round(CASE WHEN pulls > 0 THEN total / pulls ELSE 0.5 END, 6) AS score FROM s""")
def policy_plugin_learning(t: Traffic) -> DataFrame:
    """Scores of every arm before anything is known, after the earlier half of the outcomes, and after the rest."""
    o = t.outcome().select("od_id", "arm", "trip_id", F.when(_c("outcome") == "completed", 1.0).otherwise(0.0).alias("reward"))
    middle = o.agg((F.max("trip_id") / 2).alias("middle"))
    o = cut(o.join(F.broadcast(middle), F.lit(True)).withColumn("early", _c("trip_id") <= _c("middle")))  # one row
    plugin = policy.learner("running_mean")
    actions = o.select("od_id", "arm").distinct()
    state, out = plugin.init(actions), None
    for batch, news in enumerate((o.where("false"), o.where("early"), o.where("NOT early"))):
        state = cut(plugin.update_online(state, news))
        now = plugin.score_actions(state.select("od_id", "arm"), state).join(state.select("od_id", "arm", "pulls"), ["od_id", "arm"])
        now = now.select("od_id", "arm", F.lit(batch).alias("batch"), "pulls", F.round("score", 6).alias("score"))
        out = now if out is None else out.unionByName(now)
    return out


_DRIVERS = f"""RECURSIVE {_NET}, ag AS (SELECT t.trip_request_id AS agent_id, t.trip_request_id % 5 % 2 AS pos, CAST(t.origin_node_id * 25 + (t.origin_node_id + 1) % 25 AS INT) AS a, CAST(((t.origin_node_id + 1) % 25) * 25 + (t.origin_node_id + 1 + CASE WHEN t.trip_request_id % 2 = 0 THEN 5 ELSE 24 END) % 25 AS INT) AS b, p.* FROM tf_trip t JOIN tf_profile p ON p.citizen_id = t.citizen_id WHERE t.stage = 'active'),
ask AS (SELECT DISTINCT a, b, la.dst_node_id AS n, lb.dst_node_id AS e FROM ag JOIN tf_link la ON la.link_id = a JOIN tf_link lb ON lb.link_id = b WHERE pos = 0 AND la.dst_node_id <> lb.dst_node_id),
walk(a, e, last, node, path, seen, cost) AS (SELECT a, e, a, n, CAST([] AS INT[]), [n], CAST(0.0 AS DOUBLE) FROM ask UNION ALL SELECT w.a, w.e, l.link_id, l.dst_node_id, list_append(w.path, l.link_id), list_append(w.seen, l.dst_node_id), w.cost + l.cost FROM walk w JOIN tf_turn t ON t.from_link_id = w.last AND NOT t.is_forbidden JOIN net l ON l.link_id = t.to_link_id AND NOT l.blocked WHERE w.node <> w.e AND len(w.path) < 5 AND NOT list_contains(w.seen, l.dst_node_id)),
tail AS (SELECT a, e, path, cost, row_number() OVER (PARTITION BY a, e ORDER BY cost, path) AS r FROM walk WHERE node = e),
x AS (SELECT ag.*, tl.path AS new, tl.cost AS cand, CASE WHEN nb.blocked THEN 1e12 ELSE nb.cost END AS cur FROM ag JOIN tf_link lb ON lb.link_id = ag.b LEFT JOIN tail tl ON tl.a = ag.a AND tl.e = lb.dst_node_id AND tl.r = 1 AND ag.pos = 0 JOIN net nb ON nb.link_id = ag.b),
g AS (SELECT *, greatest(0.0, (cur - cand) / greatest(cur, 1e-6)) AS gain FROM x),
s AS (SELECT *, CASE WHEN pos = 1 OR new IS NULL THEN 'no_tail' WHEN new = [b] THEN 'same_tail' WHEN gain < 0.05 THEN 'insufficient_improvement' WHEN {_SCORE} >= {_BAR} AND reroute_willingness > 0 THEN 'reroute' ELSE 'persistence' END AS reason FROM g)"""


def _drivers(t: Traffic) -> DataFrame:
    """What travellers under way decide: the cheapest legal tail to where their path ends, against what is left of it."""
    n = network(t)
    ends = n.select(F.col("link_id").alias("end_link"), F.col("dst_node_id").alias("destination_id"))
    trip = t.trip().select(_c("trip_request_id").alias("agent_id"), "citizen_id")
    profile = t.profile().select("citizen_id", _c("reroute_willingness").alias("willingness"), "delay_sensitivity", _c("exploration_bias").alias("exploration"), _c("persistence_bias").alias("persistence"))
    agents = agent_paths(t).drop("ready").withColumns({"current_link_id": F.element_at("path", _c("at") + 1), "end_link": F.element_at("path", -1), "cooldown": F.lit(0)})
    agents = cut(agents.join(ends, "end_link").drop("end_link").join(trip, "agent_id").join(profile, "citizen_id").drop("citizen_id"))
    asked = cut(C.tail_requests(agents, n))
    costs = G.cost_to_go(n, asked.select("destination_id").distinct())
    found = G.ranked_paths(asked, n, t.turn(t.link()), costs, 1, 5).where("rank = 1")
    tails = asked.join(found, "od_id").select("incoming_link_id", "destination_id", "path", "cost")
    # a blocked link can't be driven
    return C.rerouted(agents, tails, n.withColumn("cost", F.when(_c("blocked"), UNREACHABLE).otherwise(_c("cost"))))


@query(f"WITH {_DRIVERS} SELECT agent_id, reason, array_to_string(CASE WHEN reason = 'reroute' THEN list_concat([a], new) ELSE [a, b] END, '-') AS path FROM s")
def reroute_tail_splice(t: Traffic) -> DataFrame:
    """Each traveller's route after the decision: the links up to the current one, and the new tail."""
    return _drivers(t).select("agent_id", "reason", F.array_join("route", "-").alias("path"))


@query(f"WITH {_DRIVERS} SELECT agent_id, CAST(tick AS INT) AS tick, CAST(greatest(CASE WHEN reason = 'reroute' THEN 3 ELSE 0 END - tick, 0) AS INT) AS cooldown, CASE WHEN reason = 'reroute' THEN 3 ELSE 0 END >= tick AS skips FROM (SELECT agent_id, reason, unnest(range(1, 5)) AS tick FROM s) k")
def cooldown_decay(t: Traffic) -> DataFrame:
    """The four ticks after: who was rerouted waits, a tick less each time."""
    x = _drivers(t).select("agent_id", "next_cooldown", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("tick"))
    return x.select("agent_id", "tick", F.greatest(_c("next_cooldown") - _c("tick"), F.lit(0)).cast("int").alias("cooldown"), (_c("next_cooldown") >= _c("tick")).alias("skips"))


@query(f"""WITH {_SEG}, p AS (SELECT a.segment_id AS i, b.segment_id AS j, a.ax, a.ay, a.bx, a.by_, b.ax AS cx, b.ay AS cy, b.bx AS dx, b.by_ AS dy, (a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax) AS det FROM seg a JOIN seg b ON a.segment_id <> b.segment_id AND a.layer = b.layer AND a.u <> b.u AND a.u <> b.v AND a.v <> b.u AND a.v <> b.v),
q AS (SELECT i, j, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det AS t, ((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / det AS s FROM p WHERE abs(det) > 1e-9)
SELECT seg.segment_id, count(q.j) + 1 AS n_pieces FROM seg LEFT JOIN q ON q.i = seg.segment_id AND t > 1e-9 AND t < 1 - 1e-9 AND s > 1e-9 AND s < 1 - 1e-9 GROUP BY seg.segment_id""")
def planarised_pieces(t: Traffic) -> DataFrame:
    """How many pieces the crossings cut each segment into."""
    x = spatial.proper_crossings(segments(t), 1000.0)
    cuts = x.select(F.explode(F.array("left_id", "right_id")).alias("segment_id")).groupBy("segment_id").agg(F.count("*").alias("n"))
    return segments(t).select("segment_id").join(cuts, "segment_id", "left").select("segment_id", (F.coalesce("n", F.lit(0)) + 1).alias("n_pieces"))


@query("""SELECT 'congestion' AS packet_type, '{"schema_version":1,"packet_type":"congestion","tick":30,"payload":{"link_id":' || link_id || '}}' AS body FROM tf_link WHERE queue_vehicles > capacity_veh_per_tick
UNION ALL SELECT 'event_overlay', '{"schema_version":1,"packet_type":"event_overlay","tick":30,"payload":{"event_id":' || event_id || '}}' FROM tf_event WHERE 30 BETWEEN start_tick AND end_tick
UNION ALL SELECT 'topology', '{"schema_version":1,"packet_type":"topology","tick":30,"payload":{"node_id":' || node_id || '}}' FROM tf_node
UNION ALL SELECT 'metrics', '{"schema_version":1,"packet_type":"metrics","tick":30,"payload":{"n_trips":' || count(*) || '}}' FROM tf_trip""")
def ui_packets(t: Traffic) -> DataFrame:
    """A tick's packets of four kinds."""

    def packets(kind: str, df: DataFrame, *fields: str) -> DataFrame:
        return df.select(F.lit(kind).alias("packet_type"), E.envelope(kind, F.lit(30), F.struct(*fields)).alias("body"))

    return (
        packets("congestion", t.link().where("queue_vehicles > capacity_veh_per_tick"), "link_id")
        .unionByName(packets("event_overlay", t.event().where("start_tick <= 30 AND end_tick >= 30"), "event_id"))
        .unionByName(packets("topology", t.node(), "node_id"))
        .unionByName(packets("metrics", t.trip().agg(F.count("*").alias("n_trips")), "n_trips"))
    )


@query("""WITH m(poi_type, k) AS (VALUES ('home', 4), ('workplace', 3), ('leisure', 2)), z AS (SELECT zone_id, node_id, row_number() OVER (PARTITION BY zone_id ORDER BY node_id) - 1 AS i, count(*) OVER (PARTITION BY zone_id) AS n FROM tf_node),
p AS (SELECT zone_id, poi_type, CAST(u AS BIGINT) AS unit FROM (SELECT DISTINCT zone_id FROM z) a CROSS JOIN m, LATERAL (SELECT unnest(range(0, m.k)) AS u))
SELECT p.zone_id, p.poi_type, p.unit, z.node_id FROM p JOIN z ON z.zone_id = p.zone_id AND z.i = CASE WHEN p.unit % 3 = 0 THEN 0 ELSE p.unit % z.n END""")
def poi_generation(t: Traffic) -> DataFrame:
    """Places of a mix in each zone: every third at its first node, the others around its nodes."""
    mix = F.explode(F.array(*[F.struct(F.lit(n).alias("poi_type"), F.lit(k).alias("k")) for n, k in (("home", 4), ("workplace", 3), ("leisure", 2))])).alias("m")
    w = Window.partitionBy("zone_id")
    z = t.node().select("zone_id", "node_id", (F.row_number().over(w.orderBy("node_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    p = z.groupBy("zone_id").agg(F.max("n").alias("n")).select("zone_id", "n", mix).select("zone_id", "n", "m.poi_type", F.explode(F.sequence(F.lit(0).cast("long"), _c("m.k").cast("long") - 1)).alias("unit"))
    p = p.withColumn("i", F.when(_c("unit") % 3 == 0, 0).otherwise(_c("unit") % _c("n")))
    return p.join(z.select("zone_id", "i", "node_id"), ["zone_id", "i"]).select("zone_id", "poi_type", "unit", "node_id")


@query("WITH m AS (SELECT zone_id, count(*) AS n, avg(x) AS mx FROM tf_node GROUP BY zone_id) SELECT zone_id, CASE WHEN n < 5 THEN 'legacy' WHEN mx > 2100 THEN 'legacy' ELSE 'morphology' END AS coupling, CASE WHEN n < 5 THEN 'gate' WHEN mx > 2100 THEN 'digest' END AS reason FROM m")
def morphology_coupling(t: Traffic) -> DataFrame:
    """Centres of the morphology where its gate and digest hold, else the older ones with the reason."""
    m = t.node().groupBy("zone_id").agg(F.count("*").alias("n"), F.avg("x").alias("mx"))
    reason = F.when(_c("n") < 5, "gate").when(_c("mx") > 2100, "digest")
    return m.select("zone_id", F.when(reason.isNull(), "morphology").otherwise("legacy").alias("coupling"), reason.alias("reason"))
