"""Ranks, budgets, best choices, and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadweave.functions import learning as L, routing as R
from roadweave.operators import agents as A, flow as Flow
from roadweave.operators.ranks import ranked
from roadweave.sources.traffic import Traffic

from . import query
from .elementwise import _REWARD, _sets

_c = F.col


def _r(x, n: int = 6):
    return F.round(x, n)


_FIRST = "CAST(origin_node_id * 25 + (origin_node_id + 1) % 25 AS INT)"


def _first(t: Traffic) -> DataFrame:
    o = _c("origin_node_id")
    return t.trip().where("stage = 'active'").select(_c("trip_request_id").alias("trip_id"), (o * 25 + (o + 1) % 25).cast("int").alias("link_id"))


@query(f"WITH a AS (SELECT trip_request_id AS trip_id, {_FIRST} AS link_id FROM tf_trip WHERE stage = 'active'), r AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY trip_id) AS r FROM a) SELECT r.trip_id, r.link_id, r.r <= floor(l.capacity_veh_per_tick / 10) AS granted FROM r JOIN tf_link l ON l.link_id = r.link_id")
def agent_token_commit(t: Traffic) -> DataFrame:
    """In slot order each agent takes a token of its movement while there are any."""
    tokens = t.link().select("link_id", F.floor(_c("capacity_veh_per_tick") / 10).alias("tokens"))
    return A.within_budget(_first(t), tokens, ["link_id"], ["trip_id"], "tokens").select("trip_id", "link_id", "granted")


@query(f"""WITH a AS (SELECT trip_request_id AS trip_id, CASE WHEN trip_request_id % 9 <> 0 THEN {_FIRST} END AS link_id FROM tf_trip WHERE stage = 'active'), r AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY trip_id) AS r FROM a),
f AS (SELECT r.*, r.link_id IS NOT NULL AND r.r <= 10 AS fits FROM r), c AS (SELECT max(trip_id) AS last, count(*) AS n FROM (SELECT trip_id FROM f WHERE fits ORDER BY trip_id LIMIT 60))
SELECT trip_id, link_id, CASE WHEN NOT (n < 60 OR trip_id <= last) THEN 'waiting' WHEN link_id IS NULL THEN 'no_route' WHEN fits THEN 'admitted' ELSE 'waiting' END AS outcome FROM f CROSS JOIN c""")
def source_admission(t: Traffic) -> DataFrame:
    trips = _first(t).withColumn("link_id", F.when(_c("trip_id") % 9 != 0, _c("link_id")))
    return A.admission(trips, t.link().select("link_id", F.lit(10.0).alias("space")), 60)


@query(f"WITH a AS (SELECT trip_request_id AS trip_id, {_FIRST} AS link_id, trip_request_id % 3 = 0 AS ends FROM tf_trip WHERE stage = 'active'), r AS (SELECT *, row_number() OVER (PARTITION BY link_id, ends ORDER BY trip_id) AS r FROM a) SELECT trip_id, link_id, ends, r <= CASE WHEN ends THEN 3 ELSE 7 END AS granted FROM r")
def link_budget_advance(t: Traffic) -> DataFrame:
    """Movement and completion budgets of a link, consumed in slot order."""
    asks = _first(t).withColumn("ends", _c("trip_id") % 3 == 0)
    budgets = t.link().select("link_id", F.explode(F.array(F.struct(F.lit(True).alias("ends"), F.lit(3).alias("n")), F.struct(F.lit(False).alias("ends"), F.lit(7).alias("n")))).alias("b")).select("link_id", "b.ends", "b.n")
    return A.within_budget(asks, budgets, ["link_id", "ends"], ["trip_id"], "n").select("trip_id", "link_id", "ends", "granted")


_ROUTES = "rt AS (SELECT od_id, arm AS candidate_id, avg(observed_travel_time) AS base, CAST(count(*) AS DOUBLE) / 10 AS capacity FROM tf_outcome GROUP BY od_id, arm)"


def _routes(t: Traffic) -> DataFrame:
    return t.outcome().groupBy("od_id", _c("arm").alias("candidate_id")).agg(F.avg("observed_travel_time").alias("base"), (F.count("*").cast("double") / 10).alias("capacity"))


@query(f"""WITH {_ROUTES}, u AS (SELECT rt.*, n, 20 + od_id % 7 AS demand, base + 5.0 * n / greatest(capacity, 1e-6) AS marginal FROM rt CROSS JOIN range(1, 40) r(n) WHERE n <= 20 + od_id % 7),
k AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY marginal, candidate_id, n) AS r FROM u) SELECT rt.od_id, rt.candidate_id, count(k.n) AS n FROM rt LEFT JOIN k ON k.od_id = rt.od_id AND k.candidate_id = rt.candidate_id AND k.r <= k.demand GROUP BY rt.od_id, rt.candidate_id""")
def route_reservations(t: Traffic) -> DataFrame:
    r = _routes(t)
    return A.reservations(r, r.select("od_id").distinct().withColumn("demand", 20 + _c("od_id") % 7), 5.0)


@query()
def token_arbitration(t: Traffic) -> DataFrame:
    link = t.link().select("link_id", "queue_vehicles", _c("capacity_veh_per_tick").alias("capacity"))
    sinks = t.link().where("link_id % 4 = 0").select("link_id", (_c("link_id") % 3 + 1).cast("double").alias("demand"))
    return Flow.token_arbitration(t.turn(), link, sinks)


@query()
def token_ticks(t: Traffic) -> DataFrame:
    """Three ticks of integer vehicles on all links, each from what the one before has left: queues, residuals and carried tokens."""
    link, turn = t.link(), t.turn()
    now = link.select("link_id", "queue_vehicles", (_c("capacity_veh_per_tick") / 16.0).alias("capacity"))
    sinks = link.select("link_id", (_c("lanes") - 1).cast("double").alias("demand"))
    moves = links = None
    for _ in range(3):
        moves, links = Flow.token_tick(turn, now, sinks, moves, links)
        now = links.select("link_id", "queue_vehicles", "capacity")
    return links


@query("SELECT link_id, round(queue_vehicles / greatest(capacity_veh_per_tick, 1e-6), 6) AS ratio, CAST(row_number() OVER (ORDER BY queue_vehicles / greatest(capacity_veh_per_tick, 1e-6) DESC, link_id) AS INT) AS rank FROM tf_link QUALIFY row_number() OVER (ORDER BY queue_vehicles / greatest(capacity_veh_per_tick, 1e-6) DESC, link_id) <= 10")
def link_hotspots(t: Traffic) -> DataFrame:
    """The ten links with the most queue for their capacity."""
    top = t.link().select("link_id", (_c("queue_vehicles") / F.greatest("capacity_veh_per_tick", F.lit(1e-6))).alias("x")).orderBy(F.desc("x"), "link_id").limit(10)
    return top.select("link_id", _r("x").alias("ratio"), F.row_number().over(Window.orderBy(F.desc("x"), "link_id")).alias("rank"))


@query("""WITH d AS (SELECT f.link_id AS incoming_link_id, l.link_id, l.length_m / l.free_flow_speed_mps + abs(n.x - g.x) / 10.0 + abs(n.y - g.y) / 10.0 AS cost FROM tf_link f JOIN tf_turn t ON t.from_link_id = f.link_id AND NOT t.is_forbidden JOIN tf_link l ON l.link_id = t.to_link_id JOIN tf_node n ON n.node_id = l.dst_node_id JOIN tf_node g ON g.node_id = 12)
SELECT incoming_link_id, link_id, round(cost, 4) AS cost, CAST(row_number() OVER (PARTITION BY incoming_link_id ORDER BY cost, link_id) AS INT) AS rank FROM d""")
def next_link_ranking(t: Traffic) -> DataFrame:
    """Legal next links by cost with an estimate to node 12, best first."""
    link = t.link()
    goal = t.node().where("node_id = 12").select(_c("x").alias("gx"), _c("y").alias("gy"))
    n = t.node().select(_c("node_id").alias("dst_node_id"), "x", "y").crossJoin(F.broadcast(goal))  # one row
    l = link.join(n, "dst_node_id").select(_c("link_id"), (_c("length_m") / _c("free_flow_speed_mps") + F.abs(_c("x") - _c("gx")) / 10.0 + F.abs(_c("y") - _c("gy")) / 10.0).alias("cost"))
    legal = t.turn(link).where("NOT is_forbidden").select(_c("from_link_id").alias("incoming_link_id"), _c("to_link_id").alias("link_id"))
    rank = F.row_number().over(Window.partitionBy("incoming_link_id").orderBy("cost", "link_id"))
    return legal.join(l, "link_id").select("incoming_link_id", "link_id", _r("cost", 4).alias("cost"), rank.alias("rank"))


@query("SELECT od_id, arm FROM (SELECT od_id, arm, row_number() OVER (PARTITION BY od_id ORDER BY arm) AS r FROM tf_outcome GROUP BY od_id, arm) WHERE r <= 3")
def candidate_top_k(t: Traffic) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("od_id").orderBy("arm"))
    return t.outcome().select("od_id", "arm").distinct().withColumn("r", r).where("r <= 3").drop("r")


_UTIL = "u AS (SELECT od_id, arm, -avg(observed_travel_time) + ln(greatest(count(*) / 1000.0, 1e-12)) AS utility FROM tf_outcome GROUP BY od_id, arm)"


def _utilities(t: Traffic) -> DataFrame:
    return t.outcome().groupBy("od_id", "arm").agg(F.avg("observed_travel_time").alias("cost"), (F.count("*") / 1000.0).alias("size")).select("od_id", "arm", R.path_logit_utility(_c("cost"), _c("size")).alias("utility"))


@query(f"WITH {_UTIL}, k AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY arm) AS n FROM u), b AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY utility DESC, arm) AS r FROM k WHERE n <= 3) SELECT od_id, arm, round(utility, 6) AS utility FROM b WHERE r = 1")
def route_choice(t: Traffic) -> DataFrame:
    """The first three candidates by id; the one of the most utility, ties to the lowest id."""
    n = F.row_number().over(Window.partitionBy("od_id").orderBy("arm"))
    k = _utilities(t).withColumn("n", n).where("n <= 3")
    best = k.groupBy("od_id").agg(F.min(F.struct((-_c("utility")).alias("u"), "arm")).alias("b"))
    return best.select("od_id", "b.arm", _r(-_c("b.u")).alias("utility"))


@query(f"WITH {_UTIL}, b AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY utility DESC, arm) AS r FROM u) SELECT od_id, arm, CAST(r AS INT) AS rank FROM b")
def runtime_route_select(t: Traffic) -> DataFrame:
    return _utilities(t).select("od_id", "arm", F.row_number().over(Window.partitionBy("od_id").orderBy(F.desc("utility"), "arm")).alias("rank"))


@query("WITH s AS (SELECT od_id, arm, avg(CASE WHEN outcome = 'completed' THEN 1.0 ELSE 0.0 END) AS score FROM tf_outcome GROUP BY od_id, arm) SELECT od_id, min(arm) AS best FROM s JOIN (SELECT od_id AS o, max(score) AS m FROM s GROUP BY od_id) ON o = od_id AND m = score GROUP BY od_id")
def mixed_route_select(t: Traffic) -> DataFrame:
    """The first of the best scores."""
    return _sets(t).groupBy("od_id").agg(F.min_by("arm", F.struct(-_c("reward"), "arm")).alias("best"))


_ARMS = f"a AS (SELECT od_id, arm, count(*) AS pulls, avg({_REWARD}) AS reward FROM tf_outcome WHERE NOT (od_id % 5 = 1 AND arm = 2) GROUP BY od_id, arm), g AS (SELECT o.od_id, m.arm, coalesce(a.pulls, 0) AS pulls, coalesce(a.reward, 0.0) AS reward FROM (SELECT DISTINCT od_id FROM tf_outcome) o CROSS JOIN range(0, 4) m(arm) LEFT JOIN a ON a.od_id = o.od_id AND a.arm = m.arm), s AS (SELECT *, CASE WHEN pulls = 0 THEN 1e9 ELSE reward + sqrt(ln(greatest(1, sum(pulls) OVER (PARTITION BY od_id)) + 1.0) / greatest(1, pulls)) END AS ucb FROM g)"


def arms(t: Traffic) -> DataFrame:
    """Pulls and mean reward of four arms of each od, zero where never pulled."""
    o = t.outcome()
    grid = o.select("od_id").distinct().select("od_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("arm"))
    a = o.where("NOT (od_id % 5 = 1 AND arm = 2)").groupBy("od_id", "arm").agg(F.count("*").alias("pulls"), F.avg(L.trip_reward(_c("outcome"), _c("observed_travel_time"), _c("baseline_travel_time"))).alias("reward"))
    return grid.join(a, ["od_id", "arm"], "left").fillna(0, ["pulls"]).fillna(0.0, ["reward"])


@query(f"WITH {_ARMS} SELECT od_id, CAST(arm AS INT) AS arm, pulls, round(ucb, 6) AS ucb FROM s")
def ucb_scores(t: Traffic) -> DataFrame:
    w = Window.partitionBy("od_id")
    return arms(t).select("od_id", "arm", "pulls", _r(L.ucb(_c("reward"), _c("pulls"), F.sum("pulls").over(w))).alias("ucb"))


@query(f"WITH {_ARMS}, r AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY ucb DESC, arm) AS r FROM s) SELECT od_id, CAST(arm AS INT) AS arm FROM r WHERE r = 1")
def ucb_select(t: Traffic) -> DataFrame:
    w = Window.partitionBy("od_id")
    s = arms(t).select("od_id", "arm", L.ucb(_c("reward"), _c("pulls"), F.sum("pulls").over(w)).alias("ucb"))
    return s.groupBy("od_id").agg(F.min_by("arm", F.struct(-_c("ucb"), "arm")).alias("arm"))


@query(f"WITH {_ARMS} SELECT od_id, CAST(arm AS INT) AS arm, pulls, round(reward, 6) AS reward FROM g")
def ucb_update(t: Traffic) -> DataFrame:
    """The batch form of the running means."""
    return arms(t).select("od_id", "arm", "pulls", _r("reward").alias("reward"))


@query("SELECT od_id, arm, CAST(0 AS BIGINT) AS pulls, CAST(0.0 AS DOUBLE) AS reward FROM (SELECT DISTINCT od_id FROM tf_outcome) CROSS JOIN (SELECT CAST(arm AS INT) AS arm FROM range(0, 4) m(arm))")
def ucb_create(t: Traffic) -> DataFrame:
    return t.outcome().select("od_id").distinct().select("od_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("arm"), F.lit(0).cast("long").alias("pulls"), F.lit(0.0).alias("reward"))


@query("WITH n AS (SELECT node_id, row_number() OVER (ORDER BY x, y, node_id) - 1 AS i, count(*) OVER () AS n FROM tf_node) SELECT node_id, CAST(k AS INT) AS k FROM n JOIN range(0, 4) r(k) ON i = floor((k + 0.5) * n / 4)")
def zone_centres(t: Traffic) -> DataFrame:
    """Nodes at even strides of the order by place."""
    n = ranked(t.node(), "x", "y", "node_id", total="n").select("node_id", (_c("rank") - 1).alias("i"), "n")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.alias("k"), F.floor((k + 0.5) * _c("n") / 4).alias("at")))).alias("a")
    return n.select("node_id", "i", at).where("i = a.at").select("node_id", "a.k")


@query("WITH g AS (SELECT DISTINCT od_id FROM tf_outcome), r AS (SELECT od_id, row_number() OVER (ORDER BY sha256('17:' || od_id), od_id) AS r, count(*) OVER () AS n FROM g) SELECT od_id, r <= ceil(n * 0.3) AS validation FROM r")
def holdout_split(t: Traffic) -> DataFrame:
    """Groups ranked by a hash of seed and group; the first share is held out."""
    g = t.outcome().select("od_id").distinct()
    g = ranked(g, F.sha2(F.concat(F.lit("17:"), _c("od_id").cast("string")), 256), "od_id", total="n")
    return g.select("od_id", (_c("rank") <= F.ceil(_c("n") * 0.3)).alias("validation"))


@query("WITH b AS (SELECT link_id, row_number() OVER (ORDER BY sha256('5:' || link_id), link_id) AS r, count(*) OVER () AS n FROM tf_link WHERE is_blockable) SELECT link_id FROM b WHERE r <= ceil(n * 0.1)")
def closure_sampling(t: Traffic) -> DataFrame:
    """A share of the links that can be blocked, by a hash of seed and link."""
    b = ranked(t.link().where("is_blockable").select("link_id"), F.sha2(F.concat(F.lit("5:"), _c("link_id").cast("string")), 256), "link_id", total="n")
    return b.where(_c("rank") <= F.ceil(_c("n") * 0.1)).select("link_id")


@query()
def farthest_destinations(t: Traffic) -> DataFrame:
    """Six nodes spread out: those nearest the corners and the centre, then each time the farthest from all before."""
    n = t.node().select("node_id", "x", "y")
    box = n.agg(F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by")).head()
    ax, bx, ay, by = box
    chosen: list = []
    for px, py in ((ax, ay), (ax, by), (bx, ay), (bx, by), ((ax + bx) / 2, (ay + by) / 2)):
        d = (_c("x") - px) * (_c("x") - px) + (_c("y") - py) * (_c("y") - py)
        row = n.agg(F.min_by(F.struct("node_id", "x", "y"), F.struct(d, "x", "y", "node_id")).alias("b")).head()["b"]
        if row["node_id"] not in [c["node_id"] for c in chosen]:
            chosen.append(row)
    while len(chosen) < 6:
        near = F.least(*[(_c("x") - c["x"]) * (_c("x") - c["x"]) + (_c("y") - c["y"]) * (_c("y") - c["y"]) for c in chosen])
        row = n.agg(F.min_by(F.struct("node_id", "x", "y"), F.struct(-near, "x", "y", "node_id")).alias("b")).head()["b"]
        chosen.append(row)
    return t.spark.createDataFrame([(k, c["node_id"]) for k, c in enumerate(chosen)], "k int, node_id int")


@query("SELECT trip_request_id, CASE WHEN stage = 'pending' AND planned_depart_tick <= 30 THEN 'activated' ELSE stage END AS stage FROM tf_trip")
def activate_due_trips(t: Traffic) -> DataFrame:
    due = (_c("stage") == "pending") & (_c("planned_depart_tick") <= 30)
    return t.trip().select("trip_request_id", F.when(due, "activated").otherwise(_c("stage")).alias("stage"))


@query("SELECT event_id, CASE WHEN event_id % 17 = 0 OR end_tick < 30 THEN 'cleared' WHEN start_tick <= 30 THEN 'active' ELSE 'scheduled' END AS stage FROM tf_event")
def event_scheduler(t: Traffic) -> DataFrame:
    """Stages at tick 30; every seventeenth event is cleared by hand."""
    stage = F.when((_c("event_id") % 17 == 0) | (_c("end_tick") < 30), "cleared").when(_c("start_tick") <= 30, "active").otherwise("scheduled")
    return t.event().select("event_id", stage.alias("stage"))


@query("WITH z AS (SELECT zone_id, avg(x) AS cx, avg(y) AS cy FROM tf_node GROUP BY zone_id), a AS (SELECT n.node_id, n.zone_id, round(atan2(n.y - cy, n.x - cx), 9) AS a, round((n.x - cx) ** 2 + (n.y - cy) ** 2, 6) AS d FROM tf_node n JOIN z ON z.zone_id = n.zone_id) SELECT zone_id, node_id, CAST(row_number() OVER (PARTITION BY zone_id ORDER BY a, d, node_id) AS INT) AS place FROM a")
def angular_order(t: Traffic) -> DataFrame:
    """A zone's nodes by angle around its centre, then distance."""
    z = t.node().groupBy("zone_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = _c("x") - _c("cx"), _c("y") - _c("cy")
    w = Window.partitionBy("zone_id").orderBy(F.round(F.atan2(dy, dx), 9), F.round(dx * dx + dy * dy, 6), "node_id")
    return t.node().join(z, "zone_id").select("zone_id", "node_id", F.row_number().over(w).alias("place"))
