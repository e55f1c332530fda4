"""Generators, learning datasets, policies, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadweave.functions import geometry as Geo, learning as L, routing as R
from roadweave.operators import demand as D, features as X, flow as Flow, graph as G, landuse as LU
from roadweave.operators.ranks import ranked
from roadweave.plans.loops import cut
from roadweave.sources.traffic import Traffic

from . import query
from .aggregates import _FLOW, _INPUTS, _QUARTERS, _ROUNDED, quarters
from .elementwise import _NORMAL, _REWARD, _SETS, _sets
from .graphs import _COST, _goals, network

_c = F.col


def _r(x, n: int = 6):
    return F.round(x, n)


@query("""WITH z AS (SELECT zone_id, population_capacity AS cap FROM tf_zone), k AS (SELECT p.kind, z.*, CASE p.kind WHEN 0 THEN cap WHEN 1 THEN cap % 1700 ELSE 0 END AS c FROM z CROSS JOIN (VALUES (0), (1), (2)) p(kind)),
s AS (SELECT *, sum(c) OVER (PARTITION BY kind) AS total, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY zone_id) - 1 AS place FROM k),
q AS (SELECT *, CASE WHEN total > 0 THEN least(1234, total) * (c / total) END AS scaled FROM s), f AS (SELECT *, floor(scaled) AS fl, row_number() OVER (PARTITION BY kind ORDER BY scaled - floor(scaled) DESC, c DESC, zone_id) AS r, least(1234, total) - sum(floor(scaled)) OVER (PARTITION BY kind) AS rest FROM q)
SELECT kind, zone_id, CAST(CASE WHEN total > 0 THEN fl + CASE WHEN r <= rest THEN 1 ELSE 0 END ELSE 1234 // n + CASE WHEN place < 1234 % n THEN 1 ELSE 0 END END AS BIGINT) AS quota FROM f""")
def largest_remainder_quotas(t: Traffic) -> DataFrame:
    cap = _c("population_capacity")
    k = t.zone().select("zone_id", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), x.cast("int").alias("c")) for i, x in enumerate((cap, cap % 1700, F.lit(0)))])).alias("k")).select("k.kind", "zone_id", "k.c")
    return D.quotas(k, ["kind"], "zone_id", "c", F.lit(1234)).select("kind", "zone_id", "quota")


@query("""WITH q AS (SELECT zone_id, CAST(3 + zone_id AS BIGINT) AS quota FROM tf_zone) SELECT zone_id, CAST(unit AS BIGINT) AS unit FROM q, LATERAL (SELECT unnest(range(1, quota + 1)) AS unit)""")
def assignment_slots(t: Traffic) -> DataFrame:
    return D.slots(t.zone().select("zone_id", (3 + _c("zone_id")).cast("long").alias("quota")), "zone_id")


@query()
def leisure_preferences(t: Traffic) -> DataFrame:
    return D.leisure_preferences(t.node().select("node_id"), "node_id", 41)


@query()
def behavior_profiles(t: Traffic) -> DataFrame:
    """A profile for each id that citizens have, and how many have it."""
    n = t.profile().groupBy(_c("behavior_profile_id").alias("profile_id")).agg(F.count("*").alias("n_citizens"))
    return D.behavior_profiles(t.spark, n.count(), 41).join(n, "profile_id")


@query()
def profile_sampling(t: Traffic) -> DataFrame:
    profiles = t.spark.range(8).select(_c("id").cast("int").alias("profile_id"), (1.0 + _c("id")).alias("weight"))
    return D.sample_profiles(t.profile().select("citizen_id"), profiles, "weight", 41)


@query()
def population(t: Traffic) -> DataFrame:
    """Citizens with a home by quota of the zones, work for 62 of 100 by hash, and schedule and profile in turn."""
    zone = D.quotas(t.zone().select(F.lit(0).alias("city"), "zone_id", "population_capacity"), ["city"], "zone_id", "population_capacity", F.lit(2000))
    w = Window.orderBy("zone_id")
    starts = zone.select("zone_id", "quota", (F.sum("quota").over(w.rowsBetween(Window.unboundedPreceding, 0)) - _c("quota")).alias("first"))
    from roadweave.functions import encoding as E

    homes = starts.select("zone_id", F.explode(F.sequence(_c("first"), _c("first") + _c("quota") - 1)).alias("citizen_id"))
    works = E.uniform(E.fold_in(41, _c("citizen_id"), F.lit("work"))) < 0.62
    return homes.select("citizen_id", _c("zone_id").alias("home_zone_id"), works.alias("works"), (_c("citizen_id") % 4).cast("int").alias("schedule_id"), (_c("citizen_id") % 8).cast("int").alias("profile_id"))


_TEMPLATES = [(k, name, band, p) for k, (name, ps) in enumerate({"office": (0.6, 0.2, 0.5, 0.1), "shift": (0.3, 0.3, 0.3, 0.3), "school": (0.7, 0.1, 0.3, 0.0), "leisure": (0.1, 0.4, 0.4, 0.3)}.items()) for band, p in zip(("morning", "midday", "evening", "night"), ps, strict=True)]


@query(f"WITH v AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _TEMPLATES)}) v(schedule_id, name, band, propensity)), n AS (SELECT behavior_profile_id % 4 AS schedule_id, count(*) AS n_citizens FROM tf_profile GROUP BY 1) SELECT v.schedule_id, name, band, CAST(propensity AS DOUBLE) AS propensity, n_citizens, round(CAST(propensity AS DOUBLE) * n_citizens, 4) AS expected FROM v JOIN n ON n.schedule_id = v.schedule_id")
def schedule_templates(t: Traffic) -> DataFrame:
    """The templates, how many citizens have each, and the trips to be expected in each band."""
    v = t.spark.createDataFrame(_TEMPLATES, "schedule_id int, name string, band string, propensity double")
    n = t.profile().groupBy((_c("behavior_profile_id") % 4).alias("schedule_id")).agg(F.count("*").alias("n_citizens"))
    return v.join(n, "schedule_id").withColumn("expected", F.round(_c("propensity") * _c("n_citizens"), 4))


@query()
def trip_generation(t: Traffic) -> DataFrame:
    k = _c("citizen_id")
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(x)).alias("weight")) for n, x in (("workplace", 3), ("leisure", 2), ("home", 1))])
    c = t.profile().select("citizen_id", _c("home_node_id").alias("origin"), (0.2 + (k % 4) * 0.15).alias("propensity"), options.alias("options"))
    return D.trip_requests(c, 41, 100, 12)


@query("""WITH m AS (SELECT CAST(count(*) // 10 AS BIGINT) AS n FROM customer), i AS (SELECT n, unnest(range(1, n)) AS i FROM m), r AS (SELECT i AS a, CASE WHEN i = n - 1 THEN 1 ELSE i + 1 END AS b, 'ring' AS kind FROM i UNION ALL SELECT 0, i, 'radial' FROM i UNION ALL SELECT i, 1 + (i - 1 + greatest(1, (n - 1) // 2)) % (n - 1), 'bridge' FROM i WHERE i <= n // 6)
SELECT CAST(a AS BIGINT) AS u, CAST(b AS BIGINT) AS v, kind FROM r UNION ALL SELECT CAST(b AS BIGINT), CAST(a AS BIGINT), kind FROM r""")
def ring_city(t: Traffic) -> DataFrame:
    """A ring around a hub with a place for every ten customers, and a chord for every sixth of them."""
    n = t.table("customer").count() // 10
    return D.ring_city(t.spark, n, n // 6)


@query("""WITH c AS (SELECT cx, cy, 1000.0 - abs(cx - 16) * 20.0 - abs(cy - 16) * 15.0 AS height FROM range(0, 32) a(cx) CROSS JOIN range(0, 32) b(cy)) SELECT CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, height < 600 AS water, height BETWEEN 600 AND 900 AS buildable FROM c""")
def terrain_raster(t: Traffic) -> DataFrame:
    """Cells of a bounded field with water and buildable masks."""
    c = t.spark.range(32 * 32).select((_c("id") % 32).alias("cx"), F.floor(_c("id") / 32).alias("cy"))
    h = 1000.0 - F.abs(_c("cx") - 16) * 20.0 - F.abs(_c("cy") - 16) * 15.0
    return c.select("cx", "cy", (h < 600).alias("water"), h.between(600, 900).alias("buildable"))


_BLOCKS = """j AS (SELECT junction_id AS k, x, y FROM tf_junction), nk AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), ex AS (SELECT u AS k, max(CASE street_id % 8 WHEN 4 THEN 0.8 WHEN 2 THEN 0.35 WHEN 3 THEN 0.35 ELSE 0.0 END) AS e FROM tf_street GROUP BY 1),
q AS (SELECT a.k AS block_id, abs(a.x * b.y - b.x * a.y + b.x * c.y - c.x * b.y + c.x * d.y - d.x * c.y + d.x * a.y - a.x * d.y) / 2 AS area, (a.x + b.x + c.x + d.x) / 4 AS x, (a.y + b.y + c.y + d.y) / 4 AS y FROM j a JOIN j b ON b.k = a.k + 1 JOIN j c ON c.k = a.k + 41 JOIN j d ON d.k = a.k + 40 WHERE a.k % 40 < 39),
corner AS (SELECT block_id, block_id + s AS k FROM q, (SELECT unnest([0, 1, 40, 41]) AS s)), sums AS (SELECT c.block_id, CAST(sum(coalesce(nk.n, 0)) AS DOUBLE) AS n, max(coalesce(ex.e, 0.0)) AS e FROM corner c LEFT JOIN nk ON nk.k = c.k LEFT JOIN ex ON ex.k = c.k GROUP BY 1),
box AS (SELECT avg(x) AS cx, avg(y) AS cy, 0.28 * greatest(max(x) - min(x), max(y) - min(y)) AS reach FROM j), top AS (SELECT max(n) AS m FROM sums),
b AS (SELECT q.block_id, area, round(exp(-sqrt((q.x - cx) ** 2 + (q.y - cy) ** 2) / reach), 9) AS ce, round(n / m, 9) AS it, e, n / m >= 0.25 AS built FROM q JOIN sums USING (block_id), box, top), cnt AS (SELECT count(*) AS n FROM b WHERE built),
c1 AS (SELECT block_id FROM (SELECT block_id, row_number() OVER (ORDER BY round(0.55 * ce + 0.30 * it + 0.15 * e, 9) DESC, block_id) AS r FROM b WHERE built), cnt WHERE r <= greatest(1, round_even(n * 0.12, 0))),
c2 AS (SELECT block_id FROM (SELECT block_id, row_number() OVER (ORDER BY round(0.50 * e + 0.35 * (1.0 - ce) + 0.15 * (1.0 - it), 9) DESC, block_id) AS r FROM b WHERE built AND block_id NOT IN (SELECT block_id FROM c1)), cnt WHERE r <= greatest(1, round_even(n * 0.12, 0))),
c3 AS (SELECT block_id FROM (SELECT block_id, row_number() OVER (ORDER BY round(0.45 * ce + 0.35 * it + 0.20 * e, 9) DESC, block_id) AS r FROM b WHERE built AND block_id NOT IN (SELECT block_id FROM c1) AND block_id NOT IN (SELECT block_id FROM c2)), cnt WHERE r <= greatest(1, round_even(n * 0.23, 0))),
near AS (SELECT DISTINCT c2.block_id + s.s AS block_id FROM c2, (SELECT unnest([-40, -1, 1, 40]) AS s) s WHERE NOT (s.s = -1 AND c2.block_id % 40 = 0) AND NOT (s.s = 1 AND c2.block_id % 40 = 38)),
u AS (SELECT b.*, CASE WHEN NOT built THEN 'open_space' WHEN block_id IN (SELECT block_id FROM c1) THEN 'commercial' WHEN block_id IN (SELECT block_id FROM c2) THEN 'industrial' WHEN block_id IN (SELECT block_id FROM c3) OR block_id IN (SELECT block_id FROM near) THEN 'mixed_use' ELSE 'residential' END AS land_use, area / 10000.0 * (0.45 + 0.55 * it) AS size FROM b)"""


@query(f"""WITH {_BLOCKS} SELECT block_id, land_use, CAST(CASE land_use WHEN 'residential' THEN greatest(1, floor(size * 95.0 + 0.5)) WHEN 'mixed_use' THEN greatest(1, floor(size * 75.0 + 0.5)) ELSE 0 END AS BIGINT) AS population,
CAST(CASE land_use WHEN 'commercial' THEN greatest(1, floor(size * 170.0 + 0.5)) WHEN 'industrial' THEN greatest(1, floor(size * 90.0 + 0.5)) WHEN 'mixed_use' THEN greatest(1, floor(size * 95.0 + 0.5)) ELSE 0 END AS BIGINT) AS jobs, CAST(CASE land_use WHEN 'residential' THEN greatest(1, floor(size * 25.0 + 0.5)) WHEN 'commercial' THEN greatest(1, floor(size * 70.0 + 0.5)) WHEN 'mixed_use' THEN greatest(1, floor(size * 55.0 + 0.5)) ELSE 0 END AS BIGINT) AS leisure FROM u""")
def block_land_use(t: Traffic) -> DataFrame:
    """Uses of the quadrangles between junctions: central where they are near the middle, intense by the orders of their corners' customers, exposed to the avenues there."""
    j = cut(t.junction().select(_c("junction_id").alias("k"), "x", "y"))
    corner = j.where("k % 40 < 39").select(_c("k").alias("block_id"), F.explode(F.array(*map(F.lit, (0, 1, 41, 40)))).alias("s")).withColumn("k", _c("block_id") + _c("s")).join(j, "k")
    way = _c("street_id") % 8
    orders = t.table("orders").groupBy(_c("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    seen = t.street().groupBy(_c("u").alias("k")).agg(F.max(F.when(way == 4, 0.8).when(way.isin(2, 3), 0.35).otherwise(0.0)).alias("e"))
    c = corner.join(orders, "k", "left").join(seen, "k", "left")
    place = F.array_position(F.array(*map(F.lit, (0, 1, 41, 40))), _c("s")).alias("i")
    ring = F.transform(F.array_sort(F.collect_list(F.struct(place, "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    b = c.groupBy("block_id").agg(ring.alias("ring"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum(F.coalesce("n", F.lit(0))).cast("double").alias("n"), F.max(F.coalesce("e", F.lit(0.0))).alias("exposure")).where("size(ring) = 4")
    b = cut(b)
    box = j.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (0.28 * F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).alias("reach")).join(b.agg(F.max("n").alias("m")), F.lit(True))  # one row
    b = b.join(F.broadcast(box), F.lit(True))
    centrality = F.round(F.exp(-F.hypot(_c("x") - _c("cx"), _c("y") - _c("cy")) / _c("reach")), 9)
    b = b.select("block_id", Geo.polygon_area(_c("ring")).alias("area_m2"), centrality.alias("centrality"), F.round(_c("n") / _c("m"), 9).alias("intensity"), "exposure", (_c("n") / _c("m") >= 0.25).alias("buildable"))
    b = cut(b)
    col = _c("block_id") % 40
    steps = F.filter(F.array(F.lit(-40), F.when(col > 0, -1), F.when(col < 38, 1), F.lit(40)), lambda s: s.isNotNull())
    pairs = b.select(_c("block_id").alias("a"), F.explode(steps).alias("s")).select("a", (_c("a") + _c("s")).alias("b"))
    return LU.land_use(b, pairs)


@query(f"""WITH {_COST.replace('@', '0, 12')}, n AS (SELECT 0 AS network, node_id, x, y FROM tf_node), l AS (SELECT 0 AS network, link_id, src_node_id AS src, dst_node_id AS dst, length_m / free_flow_speed_mps + queue_vehicles / capacity_veh_per_tick AS travel, capacity_veh_per_tick AS capacity, CASE WHEN link_id % 6 = 0 THEN 0.0 ELSE 1.0 END AS multiplier, is_blockable AS blockable FROM tf_link),
d AS (SELECT 0 AS network, node_id AS destination_id FROM tf_node WHERE node_id IN (0, 12)), {_INPUTS} SELECT i.destination_id, i.node_id, round(c.cost, 6) AS label, {_ROUNDED} FROM inputs i JOIN ctg c ON c.destination_id = i.destination_id AND c.node_id = i.node_id""")
def cost_to_go_labels(t: Traffic) -> DataFrame:
    """A label and the twenty inputs of each node that reaches a destination."""
    n = network(t)
    c = G.cost_to_go(n, _goals(t, 0, 12))
    nodes = t.node().select(F.lit(0).alias("network"), "node_id", "x", "y")
    links = t.link().select(
        F.lit(0).alias("network"), "link_id", _c("src_node_id").alias("src"), _c("dst_node_id").alias("dst"), (_c("length_m") / _c("free_flow_speed_mps") + _c("queue_vehicles") / _c("capacity_veh_per_tick")).alias("travel"),
        _c("capacity_veh_per_tick").alias("capacity"), F.when(_c("link_id") % 6 == 0, 0.0).otherwise(1.0).alias("multiplier"), _c("is_blockable").alias("blockable"),
    )
    x = X.model_inputs(nodes, links, _goals(t, 0, 12).withColumn("network", F.lit(0)))
    return x.join(c, ["destination_id", "node_id"]).select("destination_id", "node_id", _r("cost").alias("label"), *[_r(k).alias(k) for k in X.INPUTS])


@query(f"WITH s AS ({_SETS}), r AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY cost, arm) AS r FROM s) SELECT od_id, string_agg(arm, ',' ORDER BY arm) AS candidates, min(CASE WHEN r = 1 THEN arm END) AS selected FROM r GROUP BY od_id")
def route_scoring_labels(t: Traffic) -> DataFrame:
    s = _sets(t).groupBy("od_id").agg(F.array_sort(F.collect_list("arm")).alias("a"), F.min_by("arm", F.struct("cost", "arm")).alias("selected"))
    return s.select("od_id", F.array_join("a", ",").alias("candidates"), "selected")


@query(f"""WITH {_QUARTERS}, {_INPUTS}, k AS (SELECT network, destination_id, sha256(network || ':' || destination_id) AS split_group, count(*) AS n_rows, avg(euclidean_distance_by_spatial_diagonal) AS distance FROM inputs GROUP BY network, destination_id), r AS (SELECT *, row_number() OVER (ORDER BY split_group) AS r, count(*) OVER () AS n FROM k)
SELECT network, destination_id, split_group, n_rows, round(distance, 6) AS mean_distance, r <= ceil(n * 0.2) AS validation FROM r""")
def feature_dataset(t: Traffic) -> DataFrame:
    """The rows of the inputs by network and destination, which stay together; the first fifth of the groups by their digest is held out."""
    x = X.model_inputs(*quarters(t)).groupBy("network", "destination_id").agg(F.count("*").alias("n_rows"), _r(F.avg("euclidean_distance_by_spatial_diagonal")).alias("mean_distance"))
    x = x.withColumn("split_group", F.sha2(F.concat_ws(":", "network", "destination_id"), 256))
    return ranked(x, "split_group", total="n").select("network", "destination_id", "split_group", "n_rows", "mean_distance", (_c("rank") <= F.ceil(_c("n") * 0.2)).alias("validation"))


@query("SELECT od_id, trip_id, od_id IN (SELECT DISTINCT od_id FROM tf_outcome WHERE od_id % 5 = 3) AS validation FROM tf_outcome")
def graph_split(t: Traffic) -> DataFrame:
    """Samples of the held-out networks, and the others."""
    held = t.outcome().where("od_id % 5 = 3").select("od_id").distinct().withColumn("v", F.lit(True))
    return t.outcome().select("od_id", "trip_id").join(held, "od_id", "left").select("od_id", "trip_id", F.coalesce("v", F.lit(False)).alias("validation"))


@query(f"""WITH o AS (SELECT *, trip_id <= (SELECT max(trip_id) FROM tf_outcome) / 2 AS early FROM tf_outcome), tr AS (SELECT od_id, arm, avg({_REWARD}) AS score FROM o WHERE early GROUP BY od_id, arm), p AS (SELECT score, row_number() OVER (PARTITION BY od_id ORDER BY arm) AS pos FROM tr), m AS (SELECT pos, avg(score) AS score FROM p GROUP BY pos),
s AS (SELECT od_id, arm, row_number() OVER (PARTITION BY od_id ORDER BY arm) AS pos FROM (SELECT DISTINCT od_id, arm FROM o)), x AS (SELECT s.od_id, s.arm, s.pos, m.score FROM s JOIN m ON m.pos = least(s.pos, (SELECT max(pos) FROM m)))
SELECT od_id, min(arm) FILTER (r = 1) AS selected, round(sum(score), 6) AS total, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY round(score, 9) DESC, pos) AS r FROM x) GROUP BY od_id""")
def surrogate_predict(t: Traffic) -> DataFrame:
    """Candidates scored by what their place was worth on average in the earlier half of the trips, places beyond as the last one; the best is selected, ties to the first."""
    o = t.outcome()
    middle = o.agg((F.max("trip_id") / 2).alias("middle"))
    reward = L.trip_reward(_c("outcome"), _c("observed_travel_time"), _c("baseline_travel_time"))
    early = o.join(F.broadcast(middle), F.lit(True)).where("trip_id <= middle").groupBy("od_id", "arm").agg(F.avg(reward).alias("score"))  # one row
    place = F.row_number().over(Window.partitionBy("od_id").orderBy("arm")).alias("pos")
    model = cut(early.select("score", place).groupBy("pos").agg(F.avg("score").alias("score")))
    last = model.agg(F.max("pos").alias("last"))
    x = o.select("od_id", "arm").distinct().select("od_id", "arm", place).join(F.broadcast(last), F.lit(True)).withColumn("pos", F.least("pos", "last")).join(model, "pos")  # one row; a row for each place
    return x.groupBy("od_id").agg(F.min_by("arm", F.struct(-F.round("score", 9), "arm")).alias("selected"), _r(F.sum("score")).alias("total"), F.count("*").alias("n"))


@query(f"WITH s AS ({_SETS}), r AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY -cost DESC, arm) AS r FROM s), b AS (SELECT od_id, arm AS best FROM r WHERE r = 1) SELECT od_id, CASE WHEN od_id % 3 = 0 OR od_id % 6 > 3 THEN best ELSE CAST(od_id % 6 AS INT) END AS path_id, od_id % 3 = 0 OR od_id % 6 > 3 AS rerouted FROM b")
def deterministic_reroute(t: Traffic) -> DataFrame:
    """Keeps the current path unless it is gone or something calls for another."""
    b = _sets(t).groupBy("od_id").agg(F.min_by("arm", F.struct("cost", "arm")).alias("best"))
    again = (_c("od_id") % 3 == 0) | (_c("od_id") % 6 > 3)
    return b.select("od_id", F.when(again, _c("best")).otherwise((_c("od_id") % 6).cast("int")).alias("path_id"), again.alias("rerouted"))


@query(f"WITH {_NORMAL}, x AS (SELECT od_id, arm, CASE WHEN od_id % 4 = 0 THEN base ELSE 0.6 * base + 0.4 * adapt END AS s FROM n), r AS (SELECT od_id, arm, row_number() OVER (PARTITION BY od_id ORDER BY round(s, 9) DESC, arm) AS r FROM x) SELECT od_id, arm FROM r WHERE r = 1")
def candidate_mixing(t: Traffic) -> DataFrame:
    """Both scores normalised and mixed, unless the blend falls back; then the best."""
    w = Window.partitionBy("od_id")
    why = R.blend_fallback(F.lit(True), _c("od_id") % 4 == 0, F.lit(True), F.lit(True))
    s = R.mixed(R.normalised(_c("cost"), w, False), R.normalised(_c("reward"), w), R.mix_share(F.lit(0.4), 0.0, 1.0, F.lit(True)), why.isNotNull())
    x = _sets(t).select("od_id", "arm", F.round(s, 9).alias("s"))
    return x.groupBy("od_id").agg(F.min_by("arm", F.struct(-_c("s"), "arm")).alias("arm"))


@query("SELECT od_id, count(*) AS n, round(avg(CASE WHEN outcome = 'completed' THEN 1.0 ELSE 0.0 END), 6) AS done_share, round(max(observed_travel_time), 4) AS worst FROM tf_outcome GROUP BY od_id")
def run_suite(t: Traffic) -> DataFrame:
    """A row for each seed's run."""
    return t.outcome().groupBy("od_id").agg(F.count("*").alias("n"), _r(F.avg((_c("outcome") == "completed").cast("double"))).alias("done_share"), _r(F.max("observed_travel_time"), 4).alias("worst"))


_STREET_FLOW = _FLOW.replace("tf_turn", "ft").replace("tf_link", "fl")


@query(f"""WITH w0 AS (SELECT 2 * street_id AS link_id, u, v, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS length FROM tf_street UNION ALL SELECT 2 * street_id + 1, v, u, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) FROM tf_street WHERE NOT one_way), wn AS (SELECT w0.*, coalesce(k.n, 0) AS n FROM w0 LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) k ON k.o_custkey = w0.u),
fl AS (SELECT link_id, CAST(n AS DOUBLE) AS queue_vehicles, CAST(6.0 AS DOUBLE) AS capacity_veh_per_tick, length AS length_m, CAST(10.0 AS DOUBLE) AS free_flow_speed_mps FROM wn), ft AS (SELECT a.link_id AS from_link_id, b.link_id AS to_link_id, false AS is_forbidden, CAST(1.0 AS DOUBLE) AS base_priority, a.n / CAST(3.0 AS DOUBLE) AS turn_demand FROM wn a JOIN wn b ON b.u = a.v AND b.v <> a.u), {_STREET_FLOW}
SELECT l.link_id, round(coalesce(o.outflow, 0.0), 6) AS outflow, round(coalesce(i.inflow, 0.0), 6) AS inflow, round(greatest(0.0, l.queue_vehicles - coalesce(o.outflow, 0.0) + coalesce(i.inflow, 0.0)), 6) AS queue_next FROM fl l LEFT JOIN o ON l.link_id = o.link_id LEFT JOIN i ON l.link_id = i.link_id""")
def dense_flow_workload(t: Traffic) -> DataFrame:
    """One step of flow on all streets by direction of travel, with every turn but back: a vehicle waits for each order of the customer where a street begins."""
    o = t.table("orders").groupBy(_c("o_custkey").alias("u")).agg(F.count("*").alias("n"))
    s = t.street().select("street_id", "u", "v", F.hypot(_c("bx") - _c("ax"), _c("by") - _c("ay")).alias("length"), "one_way")
    w = s.select((2 * _c("street_id")).alias("link_id"), "u", "v", "length").union(s.where("NOT one_way").select(2 * _c("street_id") + 1, "v", "u", "length"))
    w = cut(w.join(o, "u", "left").fillna(0, ["n"]))
    link = w.select("link_id", _c("n").cast("double").alias("queue_vehicles"), F.lit(6.0).alias("capacity"), (_c("length") / 10.0).alias("base_ticks"), F.lit(True).alias("is_blockable"))
    out = w.select(_c("link_id").alias("to_link_id"), _c("u").alias("node_id"), _c("v").alias("to"))
    turn = w.select(_c("link_id").alias("from_link_id"), _c("v").alias("node_id"), _c("u").alias("back"), "n").join(out, "node_id").where("to <> back")
    turn = turn.select("from_link_id", "to_link_id", "node_id", F.lit(False).alias("is_forbidden"), F.lit(1.0).alias("base_priority"), (_c("n") / 3.0).alias("turn_demand"))
    return Flow.point_queue_step(turn, link).select("link_id", *[_r(c).alias(c) for c in ("outflow", "inflow", "queue_next")])


@query("WITH a AS (SELECT link_id, queue_vehicles AS q FROM tf_link), b AS (SELECT link_id, queue_vehicles + CASE WHEN link_id % 13 = 0 THEN 0.25 ELSE 0 END AS q FROM tf_link) SELECT round(max(abs(a.q - b.q)), 6) AS max_abs_diff FROM a JOIN b ON a.link_id = b.link_id")
def max_abs_diff(t: Traffic) -> DataFrame:
    a = t.link().select("link_id", _c("queue_vehicles").alias("a"))
    b = a.select("link_id", (_c("a") + F.when(_c("link_id") % 13 == 0, 0.25).otherwise(0)).alias("b"))
    return a.join(b, "link_id").agg(_r(F.max(F.abs(_c("a") - _c("b")))).alias("max_abs_diff"))


@query("WITH m AS (SELECT od_id, avg(observed_travel_time) FILTER (arm % 2 = 0) AS base, avg(observed_travel_time) FILTER (arm % 2 = 1) AS other FROM tf_outcome GROUP BY od_id) SELECT od_id, round(other / base, 6) AS ratio, other / base <= 1.25 AS passed FROM m")
def scale_audit(t: Traffic) -> DataFrame:
    """Paired runs as ratios against a gate."""
    m = t.outcome().withColumn("mode", F.when(_c("arm") % 2 == 0, "base").otherwise("other")).groupBy("od_id").pivot("mode", ["base", "other"]).agg(F.avg("observed_travel_time"))
    return m.select("od_id", _r(_c("other") / _c("base")).alias("ratio"), (_c("other") / _c("base") <= 1.25).alias("passed"))


@query("SELECT l.link_id, round(l.queue_vehicles, 4) AS queue, coalesce(e.n, 0) AS n_events FROM (SELECT * FROM tf_link ORDER BY link_id LIMIT 64) l LEFT JOIN (SELECT link_id, count(*) AS n FROM tf_event WHERE 30 BETWEEN start_tick AND end_tick GROUP BY link_id) e ON e.link_id = l.link_id")
def snapshot_source(t: Traffic) -> DataFrame:
    """A report's sample of the first 64 links with their active events."""
    some = t.link().orderBy("link_id").limit(64)
    e = t.event().where("start_tick <= 30 AND end_tick >= 30").groupBy("link_id").agg(F.count("*").alias("n"))
    return some.join(e, "link_id", "left").select("link_id", _r("queue_vehicles", 4).alias("queue"), F.coalesce("n", F.lit(0)).alias("n_events"))


@query("SELECT n.zone_id, count(DISTINCT n.node_id) AS n_nodes, count(l.link_id) AS n_links, round(sum(l.length_m), 4) AS length_m FROM tf_node n LEFT JOIN tf_link l ON l.src_node_id = n.node_id GROUP BY n.zone_id")
def static_map_artifact(t: Traffic) -> DataFrame:
    """What a map shows of each zone."""
    x = t.node().join(t.link().select(_c("src_node_id").alias("node_id"), "link_id", "length_m"), "node_id", "left")
    return x.groupBy("zone_id").agg(F.count_distinct("node_id").alias("n_nodes"), F.count("link_id").alias("n_links"), _r(F.sum("length_m"), 4).alias("length_m"))


@query("""SELECT link_id, 1 + CAST(lanes AS INT) * 2 AS n_strips, CAST(round(lanes * 3.25 + 2.0, 4) AS DOUBLE) AS width_m FROM tf_link""")
def road_sections(t: Traffic) -> DataFrame:
    """Lane profile of each link."""
    return t.link().select("link_id", (1 + _c("lanes") * 2).alias("n_strips"), _r(_c("lanes") * 3.25 + 2.0, 4).alias("width_m"))


@query("SELECT dst_node_id AS node_id, count(*) AS n_incoming, CAST(sum(CASE WHEN road_class = 'arterial' THEN 1 ELSE 0 END) AS BIGINT) AS n_arterial, sum(CASE WHEN road_class = 'arterial' THEN 1 ELSE 0 END) >= 2 AS signal_eligible FROM tf_link GROUP BY dst_node_id")
def node_interfaces(t: Traffic) -> DataFrame:
    a = F.count_if(_c("road_class") == "arterial")
    return t.link().groupBy(_c("dst_node_id").alias("node_id")).agg(F.count("*").alias("n_incoming"), a.alias("n_arterial"), (a >= 2).alias("signal_eligible"))


def tensor_batches(t: Traffic, most_bytes: int = 400_000) -> DataFrame:
    """The quarters and their destinations as padded batches; every fifth quarter by a hash is held out."""
    nodes, links, goals = (cut(x) for x in quarters(t))
    usable = links.select(_c("src").alias("src_node_id"), _c("dst").alias("dst_node_id"), _c("travel").alias("cost"), ((_c("capacity") * _c("multiplier") <= 0) & _c("blockable")).alias("blocked"))
    labels = G.cost_to_go(usable, goals.select("destination_id"))
    classes = ("local", "arterial")
    samples = X.graph_samples(nodes, links, X.model_inputs(nodes, links, goals), labels, classes)
    held = nodes.select("network").distinct().where(F.crc32(_c("network").cast("string")) % 5 == 0)
    return X.graph_batches(samples, held, most_bytes, len(classes))


@query()
def graph_tensor_batch(t: Traffic) -> DataFrame:
    return tensor_batches(t)
