"""Projections, filters and predicates of single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadweave.functions import learning as L, routing as R, traffic as T
from roadweave.sources.traffic import Traffic

from . import query

_c = F.col


def _r(x, n: int = 6):
    return F.round(x, n)


def _edges(t: Traffic) -> DataFrame:
    return t.link().select(
        "link_id", _c("queue_vehicles").alias("queue"), (_c("queue_vehicles") + _c("link_id") % 5).alias("stock"), (_c("link_id") % 7).cast("double").alias("inflow"), (_c("link_id") % 11).cast("double").alias("outflow"),
        (_c("length_m") / _c("free_flow_speed_mps")).alias("free_flow"), F.when(_c("link_id") % 13 == 0, 0.0).otherwise(_c("capacity_veh_per_tick")).alias("capacity"),
    )


_EDGES = """e AS (SELECT link_id, queue_vehicles AS queue, queue_vehicles + link_id % 5 AS stock, CAST(link_id % 7 AS DOUBLE) AS inflow, CAST(link_id % 11 AS DOUBLE) AS outflow, length_m / free_flow_speed_mps AS free_flow, CASE WHEN link_id % 13 = 0 THEN 0.0 ELSE capacity_veh_per_tick END AS capacity FROM tf_link)"""


@query(f"""WITH {_EDGES}, o AS (SELECT *, CASE WHEN capacity <= 0 THEN 0.0 ELSE least(outflow, stock + inflow, capacity) END AS out FROM e),
q AS (SELECT *, stock + inflow - out AS left_, least(greatest(queue + greatest(inflow - out, 0), 0), stock + inflow - out) AS qn FROM o)
SELECT link_id, round(out, 6) AS outflow, round(left_, 6) AS stock, round(qn, 6) AS queue, round(free_flow + qn / greatest(capacity, 1e-6), 6) AS travel_time FROM q""")
def edge_mass_balance(t: Traffic) -> DataFrame:
    e = _edges(t).withColumn("n", T.edge_mass_balance(*map(_c, ("queue", "stock", "inflow", "outflow", "free_flow", "capacity"))))
    return e.select("link_id", *[_r(_c("n")[x]).alias(x) for x in ("outflow", "stock", "queue", "travel_time")])


@query(f"""WITH {_EDGES}, o AS (SELECT *, CASE WHEN capacity <= 0 THEN 0.0 ELSE least(3.0, stock + 2.0, capacity) END AS out FROM e),
q AS (SELECT *, least(greatest(queue + greatest(2.0 - out, 0), 0), stock + 2.0 - out) AS qn FROM o)
SELECT CAST(1 AS INT) AS step, link_id, round(stock + 2.0 - out, 6) AS stock, round(qn, 6) AS queue, round(free_flow + qn / greatest(capacity, 1e-6), 6) AS travel_time FROM q""")
def edge_batch_step(t: Traffic) -> DataFrame:
    """All edges with one inflow and outflow."""
    e = _edges(t).withColumn("n", T.edge_mass_balance(_c("queue"), _c("stock"), F.lit(2.0), F.lit(3.0), _c("free_flow"), _c("capacity")))
    return e.select(F.lit(1).alias("step"), "link_id", *[_r(_c("n")[x]).alias(x) for x in ("stock", "queue", "travel_time")])


@query("SELECT link_id, round(length_m / free_flow_speed_mps + queue_vehicles / greatest(capacity_veh_per_tick, 1e-6), 6) AS travel_time FROM tf_link")
def safe_travel_time(t: Traffic) -> DataFrame:
    return t.link().select("link_id", _r(T.safe_travel_time(_c("length_m") / _c("free_flow_speed_mps"), _c("queue_vehicles"), _c("capacity_veh_per_tick"))).alias("travel_time"))


@query("SELECT from_link_id, to_link_id, greatest(least(turn_demand, base_priority * 2, 5.0 - is_forbidden::INT * 9), 0.0) AS movement FROM tf_turn")
def feasible_movement(t: Traffic) -> DataFrame:
    return t.turn().select("from_link_id", "to_link_id", T.feasible_movement(_c("turn_demand"), _c("base_priority") * 2, 5.0 - _c("is_forbidden").cast("int") * 9).alias("movement"))


@query("SELECT link_id, round(greatest(length_m / free_flow_speed_mps, 1e-3) + greatest(queue_vehicles - 20, 0.0) / greatest(capacity_veh_per_tick, 1e-3), 6) AS travel_time FROM tf_link")
def travel_time_refresh(t: Traffic) -> DataFrame:
    return t.link().select("link_id", _r(T.refreshed_travel_time(_c("length_m") / _c("free_flow_speed_mps"), _c("queue_vehicles") - 20, _c("capacity_veh_per_tick"))).alias("travel_time"))


@query("SELECT link_id, round(capacity_veh_per_tick * (link_id % 4) / 4.0, 6) AS effective_capacity, capacity_veh_per_tick * (link_id % 4) / 4.0 <= 0 AND is_blockable AS blocked FROM tf_link")
def effective_capacity_and_blocked(t: Traffic) -> DataFrame:
    cap = T.effective_capacity(_c("capacity_veh_per_tick"), (_c("link_id") % 4) / 4.0)
    return t.link().select("link_id", _r(cap).alias("effective_capacity"), T.is_blocked(cap, _c("is_blockable")).alias("blocked"))


@query("""SELECT link_id, round(greatest(length_m / greatest(free_flow_speed_mps, 1e-3) / 2.0, 1e-3), 6) AS free_flow_ticks, capacity_veh_per_tick * 2.0 AS capacity, CAST(0.0 AS DOUBLE) AS queue, CAST(1.0 AS DOUBLE) AS multiplier,
CAST(greatest(floor(length_m * lanes / 7.5), 1) AS DOUBLE) AS storage FROM tf_link""")
def initial_link_state(t: Traffic) -> DataFrame:
    return t.link().select(
        "link_id", _r(T.free_flow_ticks(_c("length_m"), _c("free_flow_speed_mps"), 2.0)).alias("free_flow_ticks"), (_c("capacity_veh_per_tick") * 2.0).alias("capacity"), F.lit(0.0).alias("queue"), F.lit(1.0).alias("multiplier"),
        T.storage_capacity(_c("length_m"), _c("lanes")).alias("storage"),
    )


@query("SELECT link_id, round(greatest(coalesce(CASE WHEN link_id % 3 = 0 THEN queue_vehicles END, CASE WHEN link_id % 3 = 1 THEN CAST(link_id AS DOUBLE) END, length_m / free_flow_speed_mps), 1e-6), 6) AS cost FROM tf_link")
def free_flow_link_cost(t: Traffic) -> DataFrame:
    """The state's cost, else a given one, else free flow."""
    cost = F.coalesce(F.when(_c("link_id") % 3 == 0, _c("queue_vehicles")), F.when(_c("link_id") % 3 == 1, _c("link_id").cast("double")), _c("length_m") / _c("free_flow_speed_mps"))
    return t.link().select("link_id", _r(F.greatest(cost, F.lit(1e-6))).alias("cost"))


@query("SELECT link_id, round(1.0 * length_m / free_flow_speed_mps + 1.5 * queue_vehicles / capacity_veh_per_tick + 2.0 * lanes + 0.5 * (link_id % 3) + 0.25 * queue_vehicles / length_m, 6) AS cost FROM tf_link")
def generalized_cost(t: Traffic) -> DataFrame:
    cost = R.generalized_cost(_c("length_m") / _c("free_flow_speed_mps"), _c("queue_vehicles") / _c("capacity_veh_per_tick"), _c("lanes").cast("double"), (_c("link_id") % 3).cast("double"), _c("queue_vehicles") / _c("length_m"), (1.0, 1.5, 2.0, 0.5, 0.25))
    return t.link().select("link_id", _r(cost).alias("cost"))


@query("SELECT trip_id, round(-0.1 * observed_travel_time + 1.0 * ln(greatest((trip_id % 11) / 10.0, 1e-12)), 6) AS utility FROM tf_outcome")
def path_logit_utility(t: Traffic) -> DataFrame:
    return t.outcome().select("trip_id", _r(R.path_logit_utility(_c("observed_travel_time"), (_c("trip_id") % 11) / 10.0, 0.1)).alias("utility"))


@query("SELECT trip_id, outcome = 'failed' OR (trip_id % 9 - 1 > 0 AND observed_travel_time > 1.2 * ((trip_id % 9 - 1) * 10.0) AND trip_id % 40 >= 20) AS reroutes FROM tf_outcome")
def should_reroute(t: Traffic) -> DataFrame:
    return t.outcome().select("trip_id", R.should_reroute(_c("outcome") == "failed", _c("observed_travel_time"), (_c("trip_id") % 9 - 1) * 10.0, _c("trip_id") % 40).alias("reroutes"))


_SCORE = "0.45 * least(1.0, greatest(0.0, reroute_willingness)) + 0.35 * least(1.0, gain * (0.75 + 0.75 * delay_sensitivity / (1 + delay_sensitivity))) + 0.20 * least(1.0, greatest(0.0, exploration_bias))"
_BAR = "0.40 + 0.15 * abs(persistence_bias) / (1 + abs(persistence_bias))"


@query(f"""WITH p AS (SELECT *, (citizen_id % 50) / 40.0 AS gain FROM tf_profile), s AS (SELECT *, {_SCORE} AS score, {_BAR} AS bar FROM p)
SELECT citizen_id, round(score, 6) AS score, score >= bar AND reroute_willingness > 0 AS reroutes FROM s""")
def reroute_core(t: Traffic) -> DataFrame:
    score = R.reroute_score(_c("reroute_willingness"), _c("delay_sensitivity"), _c("exploration_bias"), (_c("citizen_id") % 50) / 40.0)
    return t.profile().select("citizen_id", _r(score, 6).alias("score"), ((score >= R.persistence_resistance(_c("persistence_bias"))) & (_c("reroute_willingness") > 0)).alias("reroutes"))


@query(f"""WITH p AS (SELECT *, citizen_id % 6 <> 0 AS incident, CAST(greatest(citizen_id % 7 - 3, 0) AS INT) AS cooldown, CAST(citizen_id % 31 - 1 AS DOUBLE) AS cur, CAST(citizen_id % 23 AS DOUBLE) AS cand FROM tf_profile),
g AS (SELECT *, greatest(0.0, (cur - cand) / greatest(cur, 1e-6)) AS gain FROM p),
s AS (SELECT *, {_SCORE} AS score, CASE WHEN NOT incident THEN 'no_incident' WHEN cooldown > 0 THEN 'cooldown' WHEN cur <= 0 OR cand <= 0 THEN 'invalid_costs' WHEN gain < 0.05 THEN 'insufficient_improvement'
  WHEN {_SCORE} >= {_BAR} AND reroute_willingness > 0 THEN 'reroute' ELSE 'persistence' END AS reason FROM g)
SELECT citizen_id, reason = 'reroute' AS reroutes, reason, round(CASE WHEN reason IN ('reroute', 'persistence', 'insufficient_improvement') THEN gain ELSE 0.0 END, 6) AS improvement,
round(CASE WHEN reason IN ('reroute', 'persistence') THEN score ELSE 0.0 END, 6) AS score, CAST(CASE reason WHEN 'no_incident' THEN cooldown WHEN 'cooldown' THEN cooldown - 1 WHEN 'reroute' THEN 3 ELSE 0 END AS INT) AS next_cooldown FROM s""")
def reroute_or_persist(t: Traffic) -> DataFrame:
    k = _c("citizen_id")
    d = R.reroute_decision(k % 6 != 0, F.greatest(k % 7 - 3, F.lit(0)).cast("int"), (k % 31 - 1).cast("double"), (k % 23).cast("double"), _c("reroute_willingness"), _c("delay_sensitivity"), _c("exploration_bias"), _c("persistence_bias"))
    p = t.profile().withColumn("d", d)
    return p.select("citizen_id", "d.reroutes", "d.reason", _r(_c("d.improvement"), 6).alias("improvement"), _r(_c("d.score"), 6).alias("score"), "d.next_cooldown")


_SETS = """SELECT od_id, arm, avg(observed_travel_time) AS cost, avg(CASE WHEN outcome = 'completed' THEN 1.0 ELSE 0.0 END) AS reward FROM tf_outcome GROUP BY od_id, arm"""


def _sets(t: Traffic) -> DataFrame:
    return t.outcome().groupBy("od_id", "arm").agg(F.avg("observed_travel_time").alias("cost"), F.avg(F.when(_c("outcome") == "completed", 1.0).otherwise(0.0)).alias("reward"))


_NORMAL = f"""s AS ({_SETS}), m AS (SELECT *, min(-cost) OVER w AS lo, max(-cost) OVER w AS hi, min(reward) OVER w AS rlo, max(reward) OVER w AS rhi FROM s WINDOW w AS (PARTITION BY od_id)),
n AS (SELECT *, CASE WHEN hi - lo <= 1e-6 THEN 1.0 ELSE (-cost - lo) / greatest(hi - lo, 1e-6) END AS base, CASE WHEN rhi - rlo <= 1e-6 THEN 1.0 ELSE (reward - rlo) / greatest(rhi - rlo, 1e-6) END AS adapt FROM m)"""


@query(f"WITH {_NORMAL} SELECT od_id, arm, round(base, 6) AS preference, round(adapt, 6) AS adaptive FROM n")
def score_normalisation(t: Traffic) -> DataFrame:
    w = Window.partitionBy("od_id")
    return _sets(t).select("od_id", "arm", _r(R.normalised(_c("cost"), w, False)).alias("preference"), _r(R.normalised(_c("reward"), w)).alias("adaptive"))


@query(f"""WITH {_NORMAL} SELECT od_id, arm, round(CASE WHEN od_id % 5 = 0 THEN base ELSE (1 - 0.3) * base + 0.3 * adapt END, 6) AS score FROM n""")
def score_blend(t: Traffic) -> DataFrame:
    w = Window.partitionBy("od_id")
    score = R.mixed(R.normalised(_c("cost"), w, False), R.normalised(_c("reward"), w), F.lit(0.3), _c("od_id") % 5 == 0)
    return _sets(t).select("od_id", "arm", _r(score).alias("score"))


@query("SELECT trip_id, round(CASE WHEN trip_id % 10 = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, least(0.8, greatest(0.1, observed_travel_time / 40.0)))) END, 6) AS share FROM tf_outcome")
def mix_share(t: Traffic) -> DataFrame:
    return t.outcome().select("trip_id", _r(R.mix_share(_c("observed_travel_time") / 40.0, 0.1, 0.8, _c("trip_id") % 10 != 0), 6).alias("share"))


@query("SELECT trip_id, CASE WHEN trip_id % 10 = 0 THEN 'no_signal' WHEN outcome = 'failed' THEN 'incident_mode' WHEN od_id % 7 = 0 THEN 'no_signal' WHEN arm = 3 THEN 'invalid_output' END AS reason FROM tf_outcome")
def blend_control(t: Traffic) -> DataFrame:
    return t.outcome().select("trip_id", R.blend_fallback(_c("trip_id") % 10 != 0, _c("outcome") == "failed", _c("od_id") % 7 != 0, _c("arm") != 3).alias("reason"))


_REWARD = "CASE WHEN outcome = 'completed' THEN 1.0 / (1.0 + observed_travel_time / baseline_travel_time) ELSE -1.0 + 1.0 / (1.0 + observed_travel_time / baseline_travel_time) END"


@query(f"SELECT trip_id, round({_REWARD}, 6) AS reward FROM tf_outcome")
def trip_reward(t: Traffic) -> DataFrame:
    return t.outcome().select("trip_id", _r(L.trip_reward(_c("outcome"), _c("observed_travel_time"), _c("baseline_travel_time")), 6).alias("reward"))


@query("SELECT zone_id, CAST(round(0.5 * greatest(zone_id - 1.5, 0.0), 6) AS DOUBLE) AS delta, CAST(round(greatest(population_capacity + 0.5 * greatest(zone_id - 1.5, 0.0), 0.0), 6) AS DOUBLE) AS housing, CAST(round(greatest(job_capacity - 600 + 0.5 * greatest(zone_id - 1.5, 0.0), 0.0), 6) AS DOUBLE) AS jobs FROM tf_zone")
def landuse_feedback(t: Traffic) -> DataFrame:
    d = T.landuse_delta(_c("zone_id") - 1.5, 0.5)
    return t.zone().select("zone_id", _r(d, 6).alias("delta"), _r(T.landuse_applied(_c("population_capacity"), d), 6).alias("housing"), _r(T.landuse_applied(_c("job_capacity") - 600, d), 6).alias("jobs"))


@query("SELECT trip_id, round(0.7 * baseline_travel_time + 0.3 * observed_travel_time, 6) AS ema, round(0.5 + 0.1 * (observed_travel_time - 0.5), 6) AS arm_value FROM tf_outcome")
def ema_and_arm_update(t: Traffic) -> DataFrame:
    return t.outcome().select("trip_id", _r(L.ema(_c("baseline_travel_time"), _c("observed_travel_time"), 0.3), 6).alias("ema"), _r(L.arm_update(F.lit(0.5), _c("observed_travel_time"), 0.1), 6).alias("arm_value"))


@query("SELECT event_id, round(CASE effect_model WHEN 'closure' THEN 0.0 WHEN 'capacity_reduction' THEN least(1.0, greatest(0.0, 1.0 - severity)) END, 6) AS multiplier FROM tf_event")
def event_multiplier(t: Traffic) -> DataFrame:
    return t.event().select("event_id", _r(T.event_multiplier(_c("effect_model"), _c("severity"))).alias("multiplier"))


@query("SELECT link_id, CAST(greatest(floor(length_m * lanes / 7.5), 1) AS DOUBLE) AS storage FROM tf_link")
def link_storage_capacity(t: Traffic) -> DataFrame:
    return t.link().select("link_id", T.storage_capacity(_c("length_m"), _c("lanes")).alias("storage"))


@query("""WITH a AS (SELECT t.trip_request_id, l.link_id, least(1.0, (t.trip_request_id % 100) / 100.0 + l.free_flow_speed_mps * 5.0 / l.length_m) AS p FROM tf_trip t JOIN tf_link l ON l.link_id = t.origin_node_id * 25 + (t.origin_node_id + 1) % 25 WHERE t.stage = 'active')
SELECT link_id, count(*) AS n_progressed, CAST(sum(CASE WHEN p >= 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_exit_ready, CAST(sum(CASE WHEN p < 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_in_transit FROM a GROUP BY link_id""")
def agent_link_progress(t: Traffic) -> DataFrame:
    """Agents advance along their links; counts by link."""
    at = t.trip().where("stage = 'active'").withColumn("link_id", _c("origin_node_id") * 25 + (_c("origin_node_id") + 1) % 25)
    at = at.join(t.link().select("link_id", "free_flow_speed_mps", "length_m"), "link_id")
    p = T.progress_after((_c("trip_request_id") % 100) / 100.0, _c("free_flow_speed_mps"), _c("length_m"), 5.0)
    return at.withColumn("p", p).groupBy("link_id").agg(F.count("*").alias("n_progressed"), F.count_if(_c("p") >= 1.0).alias("n_exit_ready"), F.count_if(_c("p") < 1.0).alias("n_in_transit"))


_DAY = "CASE WHEN trip_request_id % 7 < 5 THEN 'weekday' ELSE 'weekend' END AS day_type, trip_request_id % 1440 AS m"
_MULT = "CASE WHEN day_type = 'weekday' THEN CASE WHEN m >= 420 AND m < 540 THEN 1.7 WHEN m >= 690 AND m < 780 THEN 1.15 WHEN m >= 1020 AND m < 1140 THEN 1.55 ELSE 1.0 END ELSE CASE WHEN m >= 690 AND m < 780 THEN 1.3 WHEN m >= 1020 AND m < 1140 THEN 1.1 ELSE 0.8 END END"


@query(f"WITH a AS (SELECT trip_request_id, {_DAY} FROM tf_trip) SELECT trip_request_id, CAST({_MULT} AS DOUBLE) AS multiplier FROM a")
def demand_multiplier(t: Traffic) -> DataFrame:
    k = _c("trip_request_id")
    return t.trip().select("trip_request_id", T.demand_multiplier(F.when(k % 7 < 5, "weekday").otherwise("weekend"), k % 1440).alias("multiplier"))


@query("SELECT zone_id, CAST(round_even(population_capacity * 0.0105, 0) AS BIGINT) AS n_trips FROM tf_zone")
def scheduled_trip_count(t: Traffic) -> DataFrame:
    return t.zone().select("zone_id", T.scheduled_trips(_c("population_capacity"), F.lit(0.0105), F.lit(1.0)).alias("n_trips"))


_CAPS = """b AS (SELECT zone_id, zone_type, CAST(greatest(round_even(10007 * (zone_id + 1) / 15.0, 0), 1) AS BIGINT) AS base FROM tf_zone),
z AS (SELECT zone_id, zone_type, CAST(CASE zone_type WHEN 'residential' THEN base WHEN 'cbd_commercial' THEN greatest(base // 5, 1) WHEN 'industrial' THEN greatest(base // 8, 1) ELSE greatest(floor(base * 0.8), 1) END AS BIGINT) AS population,
CAST(CASE zone_type WHEN 'residential' THEN greatest(base // 5, 1) WHEN 'cbd_commercial' THEN base * 2 WHEN 'industrial' THEN base * 3 // 2 ELSE greatest(floor(base * 0.9), 1) END AS BIGINT) AS jobs,
CAST(CASE zone_type WHEN 'residential' THEN greatest(base // 4, 1) WHEN 'cbd_commercial' THEN greatest(base // 2, 1) WHEN 'industrial' THEN greatest(base // 6, 1) ELSE greatest(floor(base * 0.8), 1) END AS BIGINT) AS leisure FROM b)"""


def _capacities(t: Traffic) -> DataFrame:
    return t.zone().withColumn("c", T.zone_capacities(_c("zone_type"), (_c("zone_id") + 1) / 15.0, 10007)).select("zone_id", "zone_type", "c.population", "c.jobs", "c.leisure")


@query(f"WITH {_CAPS} SELECT zone_id, population, jobs, leisure FROM z")
def zone_capacities(t: Traffic) -> DataFrame:
    return _capacities(t).drop("zone_type")


@query(f"WITH {_CAPS} SELECT zone_id, p.poi_type, CAST(greatest(CASE p.poi_type WHEN 'home' THEN population WHEN 'workplace' THEN jobs ELSE leisure END // 10, 1) AS BIGINT) AS capacity FROM z CROSS JOIN (VALUES ('home'), ('workplace'), ('leisure')) p(poi_type)")
def poi_capacity_hint(t: Traffic) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, ("home", "workplace", "leisure")))).alias("poi_type")
    return _capacities(t).select("*", kinds).select("zone_id", "poi_type", T.poi_capacity(_c("poi_type"), _c("population"), _c("jobs"), _c("leisure")).alias("capacity"))


@query("SELECT DISTINCT planned_depart_tick AS step, planned_depart_tick % 1 = 0 AS fast, planned_depart_tick % 5 = 0 AS medium, planned_depart_tick % 20 = 0 AS slow FROM tf_trip")
def scheduler_cadence(t: Traffic) -> DataFrame:
    s = t.trip().select(_c("planned_depart_tick").alias("step")).distinct()
    return s.select("step", T.runs_at(_c("step"), 1).alias("fast"), T.runs_at(_c("step"), 5).alias("medium"), T.runs_at(_c("step"), 20).alias("slow"))


@query("SELECT event_id, event_id % 5 <> 2 OR link_id % 3 <> 1 AS stale FROM tf_event")
def snapshot_staleness(t: Traffic) -> DataFrame:
    """A snapshot of other graph or land-use versions is stale."""
    return t.event().select("event_id", ((_c("event_id") % 5 != 2) | (_c("link_id") % 3 != 1)).alias("stale"))


@query("""WITH m AS (SELECT od_id, avg(CASE WHEN outcome = 'failed' THEN 1.0 ELSE 0.0 END) AS failed_share, max(observed_travel_time) AS worst, count(*) AS n FROM tf_outcome GROUP BY od_id)
SELECT od_id, failed_share > 0.2 OR worst > 400 OR n < 10 AS hard_fail FROM m""")
def hard_fail_oracle(t: Traffic) -> DataFrame:
    m = t.outcome().groupBy("od_id").agg(F.avg(F.when(_c("outcome") == "failed", 1.0).otherwise(0.0)).alias("failed_share"), F.max("observed_travel_time").alias("worst"), F.count("*").alias("n"))
    return m.select("od_id", ((_c("failed_share") > 0.2) | (_c("worst") > 400) | (_c("n") < 10)).alias("hard_fail"))


@query("SELECT zone_id, CAST(greatest(1, ceil(1 / (0.1 * (zone_id + 1) * 4.0))) AS INT) AS interval_ticks FROM tf_zone")
def min_emit_interval(t: Traffic) -> DataFrame:
    return t.zone().select("zone_id", T.min_emit_interval(0.1 * (_c("zone_id") + 1), F.lit(4.0)).alias("interval_ticks"))
