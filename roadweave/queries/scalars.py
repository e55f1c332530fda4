"""Hashes, geometry, JSON packets and random choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadweave.functions import encoding as E, geometry as G
from roadweave.operators import lines as L
from roadweave.sources.traffic import Traffic

from . import query
from .aggregates import streets
from .graphs import _SEG, segments

_c = F.col


def _r(x, n: int = 6):
    return F.round(x, n)


@query("""SELECT link_id, sha256('{"capacity":' || CAST(CAST(capacity_veh_per_tick AS INT) AS VARCHAR) || ',"link_id":' || link_id || ',"road_class":"' || road_class || '"}') AS fingerprint FROM tf_link""")
def canonical_fingerprint(t: Traffic) -> DataFrame:
    """SHA-256 of the row as compact JSON with sorted keys."""
    return t.link().select("link_id", E.fingerprint(capacity=_c("capacity_veh_per_tick").cast("int"), link_id=_c("link_id"), road_class=_c("road_class")).alias("fingerprint"))


@query("SELECT link_id, sha256('i' || length(CAST(link_id AS VARCHAR)) || ':' || link_id || 's' || length(road_class) || ':' || road_class || CASE WHEN is_blockable THEN 'b4:true' ELSE 'b5:false' END) AS digest FROM tf_link")
def value_digest(t: Traffic) -> DataFrame:
    """A digest of typed, length-prefixed values."""
    return t.link().select("link_id", E.digest(("i", _c("link_id")), ("s", _c("road_class")), ("b", _c("is_blockable"))).alias("digest"))


@query("SELECT link_id, sha256(string_agg(start_tick || ':' || event_id || ':' || effect_model, '|' ORDER BY start_tick, event_id)) AS fingerprint FROM tf_event GROUP BY link_id")
def journal_fingerprint(t: Traffic) -> DataFrame:
    """An ordered digest of the interventions on each link."""
    return t.event().groupBy("link_id").agg(E.ordered_fingerprint(["start_tick", "event_id"], F.concat_ws(":", "start_tick", "event_id", "effect_model")).alias("fingerprint"))


@query("SELECT od_id, sha256(string_agg(arm || '=' || n, ',' ORDER BY arm)) AS fingerprint FROM (SELECT od_id, arm, count(*) AS n FROM tf_outcome GROUP BY od_id, arm) GROUP BY od_id")
def route_cache_fingerprint(t: Traffic) -> DataFrame:
    x = t.outcome().groupBy("od_id", "arm").agg(F.count("*").alias("n"))
    return x.groupBy("od_id").agg(E.ordered_fingerprint(["arm"], F.concat_ws("=", "arm", "n"), ",").alias("fingerprint"))


@query()
def hash_uniform(t: Traffic) -> DataFrame:
    """Keys folded from a seed and tokens, and uniforms from them; sequences are this engine's own."""
    key = E.fold_in(41, _c("trip_request_id"), F.lit("weekday"))
    return t.trip().select("trip_request_id", key.alias("key"), E.uniform(key).alias("u"))


@query("""SELECT link_id, round(CAST(('0x' || reverse_pairs) AS UBIGINT) / 18446744073709551615.0, 9) AS u FROM (SELECT link_id, substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS reverse_pairs FROM (SELECT link_id, sha256('9:' || link_id || ':stress') AS h FROM tf_link))""")
def stable_unit_interval(t: Traffic) -> DataFrame:
    return t.link().select("link_id", _r(E.unit_interval(F.concat(F.lit("9:"), _c("link_id").cast("string"), F.lit(":stress"))), 9).alias("u"))


@query("""WITH w AS (SELECT citizen_id, (citizen_id % 97) / 97.0 AS roll, CAST(1 + citizen_id % 3 AS DOUBLE) AS a, CAST(citizen_id % 5 AS DOUBLE) AS b, 2.0 AS c FROM tf_profile)
SELECT citizen_id, CASE WHEN citizen_id % 50 = 0 THEN 'leisure' WHEN a >= roll * (a + b + c) THEN 'home' WHEN a + b >= roll * (a + b + c) THEN 'workplace' ELSE 'leisure' END AS poi_type FROM w""")
def weighted_choice(t: Traffic) -> DataFrame:
    """The first of the running sums of weights that reaches the roll; leisure where nothing has weight."""
    k = _c("citizen_id")
    none = k % 50 == 0
    w = lambda x: F.when(none, 0.0).otherwise(x)
    options = F.array(*[F.struct(F.lit(n).alias("name"), w(x).alias("weight")) for n, x in (("home", (1 + k % 3).cast("double")), ("workplace", (k % 5).cast("double")), ("leisure", F.lit(2.0)))])
    return t.profile().select("citizen_id", E.weighted_choice(options, (k % 97) / 97.0, "leisure").alias("poi_type"))


@query("SELECT node_id, round(6371008.8 * radians((x / 1000 - 2)) * cos(radians(48.0)), 4) AS px, round(6371008.8 * radians(y / 1000 - 2), 4) AS py FROM tf_node")
def equirectangular_projection(t: Traffic) -> DataFrame:
    p = G.project(_c("x") / 1000, _c("y") / 1000 + 46.0, F.lit(2.0), F.lit(48.0))
    return t.node().withColumn("p", p).select("node_id", _r("p.x", 4).alias("px"), _r("p.y", 4).alias("py"))


@query("SELECT node_id, round(179.0 + (((x / 10 - 179.0 + 180) % 360 + 360) % 360 - 180), 6) AS longitude FROM tf_node")
def longitude_unwrap(t: Traffic) -> DataFrame:
    return t.node().select("node_id", _r(G.unwrapped_longitude(_c("x") / 10, F.lit(179.0))).alias("longitude"))


_STREET = "e AS (SELECT DISTINCT least(src_node_id, dst_node_id) AS u, greatest(src_node_id, dst_node_id) AS v FROM tf_link), g AS (SELECT u, v, b.x - a.x AS dx, b.y - a.y AS dy FROM e JOIN tf_node a ON a.node_id = u JOIN tf_node b ON b.node_id = v)"


@query(f"WITH {_STREET} SELECT u, v, round((degrees(atan2(dx, dy)) + 360) % 360, 6) AS bearing, CAST(floor(((degrees(atan2(dx, dy)) + 360) % 360 + 5) % 360 / 10) AS INT) AS bin FROM g")
def bearing_bins(t: Traffic) -> DataFrame:
    b = G.bearing(_c("bx") - _c("ax"), _c("by") - _c("ay"))
    return streets(t).select("u", "v", _r(b).alias("bearing"), G.bearing_bin(b).alias("bin"))


@query("""WITH v AS (SELECT l.link_id, l.src_node_id, l.dst_node_id, CASE WHEN l.link_id % 10 = 0 THEN 'ramp' ELSE l.road_class END AS road_class, b.x - a.x AS dx, b.y - a.y AS dy FROM tf_link l JOIN tf_node a ON a.node_id = l.src_node_id JOIN tf_node b ON b.node_id = l.dst_node_id),
d AS (SELECT i.link_id AS from_link_id, o.link_id AS to_link_id, i.src_node_id = o.dst_node_id AS rev, i.road_class AS fc, o.road_class AS tc, 180.0 - ((180.0 - degrees(atan2(o.dy, o.dx) - atan2(i.dy, i.dx))) % 360 + 360) % 360 AS s FROM v i JOIN v o ON o.src_node_id = i.dst_node_id)
SELECT from_link_id, to_link_id, CASE WHEN rev THEN 'u_turn_forbidden' WHEN fc <> 'ramp' AND tc = 'ramp' THEN 'ramp_on' WHEN fc = 'ramp' AND tc <> 'ramp' THEN 'ramp_off' WHEN abs(round(s, 6)) <= 30 THEN 'through' WHEN round(s, 6) > 0 THEN 'left' ELSE 'right' END AS turn_type FROM d""")
def turn_deflection_class(t: Traffic) -> DataFrame:
    """All turns at each node with their class."""
    n = t.node()
    a, b = (n.select(_c("node_id").alias(k), _c("x").alias(f"{s}x"), _c("y").alias(f"{s}y")) for k, s in (("src_node_id", "a"), ("dst_node_id", "b")))
    v = t.link().join(a, "src_node_id").join(b, "dst_node_id").withColumn("road_class", F.when(_c("link_id") % 10 == 0, "ramp").otherwise(_c("road_class")))
    side = lambda s, at: v.select(_c(at).alias("node"), F.struct("link_id", "src_node_id", "dst_node_id", "road_class", (_c("bx") - _c("ax")).alias("dx"), (_c("by") - _c("ay")).alias("dy")).alias(s))
    x = side("i", "dst_node_id").join(side("o", "src_node_id"), "node")
    signed = F.round(G.deflection(_c("i.dx"), _c("i.dy"), _c("o.dx"), _c("o.dy")), 6)
    kind = G.turn_class(_c("i.src_node_id") == _c("o.dst_node_id"), _c("i.road_class"), _c("o.road_class"), signed)
    return x.select(_c("i.link_id").alias("from_link_id"), _c("o.link_id").alias("to_link_id"), kind.alias("turn_type"))


@query(f"WITH {_SEG} SELECT segment_id, round(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) + 10.0, 4) AS length FROM seg")
def line_length(t: Traffic) -> DataFrame:
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    line = F.array(p(_c("ax"), _c("ay")), p(_c("bx"), _c("by")), p(_c("bx") + 6.0, _c("by") + 8.0))
    return segments(t).select("segment_id", _r(G.line_length(line), 4).alias("length"))


_RINGS = "(VALUES (0, 0.0, 0.0, 2500.0, 0.0, 2500.0, 1500.0, 0.0, 3000.0), (1, 1000.0, 1000.0, 4000.0, 500.0, 3000.0, 3000.0, 1500.0, 4000.0)) r(ring_id, x1, y1, x2, y2, x3, y3, x4, y4)"


def _rings(t: Traffic) -> DataFrame:
    p = lambda k: F.struct(_c(f"x{k}").alias("x"), _c(f"y{k}").alias("y"))
    rows = [(0, 0.0, 0.0, 2500.0, 0.0, 2500.0, 1500.0, 0.0, 3000.0), (1, 1000.0, 1000.0, 4000.0, 500.0, 3000.0, 3000.0, 1500.0, 4000.0)]
    return t.spark.createDataFrame(rows, "ring_id int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, x4 double, y4 double").select("ring_id", F.array(p(1), p(2), p(3), p(4)).alias("ring"))


@query("""WITH j AS (SELECT junction_id AS k, x, y FROM tf_junction) SELECT a.k AS block_id, abs(a.x * b.y - b.x * a.y + b.x * c.y - c.x * b.y + c.x * d.y - d.x * c.y + d.x * a.y - a.x * d.y) / 2 AS area FROM j a JOIN j b ON b.k = a.k + 1 JOIN j c ON c.k = a.k + 41 JOIN j d ON d.k = a.k + 40 WHERE a.k % 40 < 39""")
def polygon_area(t: Traffic) -> DataFrame:
    """Areas of the quadrangles between neighbouring junctions of two rows."""
    j = t.junction().select(_c("junction_id").alias("k"), F.struct("x", "y").alias("p"))
    at = lambda step, name: j.select((_c("k") - step).alias("k"), _c("p").alias(name))
    x = j.where("k % 40 < 39").join(at(1, "b"), "k").join(at(41, "c"), "k").join(at(40, "d"), "k")
    return x.select(_c("k").alias("block_id"), G.polygon_area(F.array("p", "b", "c", "d")).alias("area"))


_SIDES = " UNION ALL ".join(f"SELECT node_id, ring_id, n.x AS px, n.y AS py, r.x{a} AS ax, r.y{a} AS ay, r.x{b} AS bx, r.y{b} AS by_ FROM tf_node n CROSS JOIN {_RINGS}" for a, b in ((1, 2), (2, 3), (3, 4), (4, 1)))


@query(f"""WITH s AS ({_SIDES}), f AS (SELECT *, abs((bx - ax) * (py - ay) - (by_ - ay) * (px - ax)) <= 1e-9 AND px BETWEEN least(ax, bx) AND greatest(ax, bx) AND py BETWEEN least(ay, by_) AND greatest(ay, by_) AS touch,
(ay > py) <> (by_ > py) AND px < (bx - ax) * (py - ay) / CASE WHEN by_ <> ay THEN by_ - ay END + ax AS hit FROM s)
SELECT node_id, ring_id, bool_or(touch) OR sum(CASE WHEN hit THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM f GROUP BY node_id, ring_id""")
def point_in_polygon(t: Traffic) -> DataFrame:
    n = t.node().select("node_id", "x", "y").crossJoin(F.broadcast(_rings(t)))  # two rings
    return n.select("node_id", "ring_id", G.in_polygon(_c("x"), _c("y"), _c("ring")).alias("inside"))


_PACKETS = """p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"type":"set_day_type","value":"weekend"}' WHEN 1 THEN '{"type":"set_time_band","value":"evening"}' WHEN 2 THEN '{"type":"request_snapshot"}' WHEN 3 THEN '{"type":"explode","value":"x"}' ELSE '{"value":' END AS body FROM tf_event)"""


@query(f"""WITH {_PACKETS} SELECT event_id, CASE WHEN event_id % 5 < 3 THEN json_extract_string(body, '$.type') ELSE 'noop' END AS control, CASE event_id % 5 WHEN 0 THEN 'weekend' WHEN 1 THEN 'evening' END AS value, CASE event_id % 5 WHEN 3 THEN 'unsupported_type' WHEN 4 THEN 'malformed' END AS rejected FROM p""")
def control_packet_parse(t: Traffic) -> DataFrame:
    k = _c("event_id") % 5
    body = F.when(k == 0, '{"type":"set_day_type","value":"weekend"}').when(k == 1, '{"type":"set_time_band","value":"evening"}').when(k == 2, '{"type":"request_snapshot"}').when(k == 3, '{"type":"explode","value":"x"}').otherwise('{"value":')
    c = E.parsed_control(body)
    return t.event().withColumn("c", c).select("event_id", "c.control", "c.value", "c.rejected")


@query("""SELECT event_id, '{"schema_version":1,"packet_type":"event_overlay","tick":' || start_tick || ',"payload":{"event_id":' || event_id || ',"link_id":' || link_id || ',"effect":"' || effect_model || '"}}' AS packet FROM tf_event WHERE start_tick <= 30 AND end_tick >= 30""")
def packet_envelope(t: Traffic) -> DataFrame:
    """Envelopes of the overlay items of tick 30's events."""
    item = F.struct("event_id", "link_id", _c("effect_model").alias("effect"))
    return t.event().where("start_tick <= 30 AND end_tick >= 30").select("event_id", E.envelope("event_overlay", _c("start_tick"), item).alias("packet"))


@query("SELECT od_id, round(sum(observed_travel_time * pow(0.7, n - r)) * 0.3, 4) AS ema FROM (SELECT od_id, observed_travel_time, row_number() OVER (PARTITION BY od_id ORDER BY trip_id, observed_travel_time) AS r, count(*) OVER (PARTITION BY od_id) AS n FROM tf_outcome) GROUP BY od_id")
def ema_sequence(t: Traffic) -> DataFrame:
    """Running mean of each od's trips, in order.

    A trip weighs by how many of its od follow it: those in its own range of trip ids by rank, those in later ranges by count, so that no task
    sorts more than a range. The ranges' sums are few and are weighed in the same way.
    """
    later = Window.partitionBy("od_id", "range").orderBy(F.desc("trip_id"), F.desc("observed_travel_time"))
    ranked = t.outcome().select("od_id", "trip_id", "observed_travel_time", F.floor(_c("trip_id") / 100_000).alias("range")).withColumn("after", F.row_number().over(later) - 1)
    sums = ranked.groupBy("od_id", "range").agg(F.sum(_c("observed_travel_time") * F.pow(F.lit(0.7), "after")).alias("part"), F.count("*").alias("n"))
    ranges = Window.partitionBy("od_id").orderBy(F.desc("range"))
    weighed = sums.withColumn("after", F.sum("n").over(ranges) - _c("n"))
    return weighed.groupBy("od_id").agg(_r(F.sum(_c("part") * F.pow(F.lit(0.7), "after")) * 0.3, 4).alias("ema"))


_BOX = (550.0, 120.0, 2450.0, 1900.0)


@query(f"""WITH s AS (SELECT *, bx - ax AS dx, by_ - ay AS dy FROM tf_street), t AS (SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN ({_BOX[0]} - ax) / dx WHEN dx < 0 THEN ({_BOX[2]} - ax) / dx ELSE 0.0 END, CASE WHEN dy > 0 THEN ({_BOX[1]} - ay) / dy WHEN dy < 0 THEN ({_BOX[3]} - ay) / dy ELSE 0.0 END) AS t0,
least(1.0, CASE WHEN dx > 0 THEN ({_BOX[2]} - ax) / dx WHEN dx < 0 THEN ({_BOX[0]} - ax) / dx ELSE 1.0 END, CASE WHEN dy > 0 THEN ({_BOX[3]} - ay) / dy WHEN dy < 0 THEN ({_BOX[1]} - ay) / dy ELSE 1.0 END) AS t1 FROM s WHERE NOT (dx = 0 AND (ax < {_BOX[0]} OR ax > {_BOX[2]})) AND NOT (dy = 0 AND (ay < {_BOX[1]} OR ay > {_BOX[3]})))
SELECT street_id, round(ax + t0 * dx, 6) AS ax, round(ay + t0 * dy, 6) AS ay, round(ax + t1 * dx, 6) AS bx, round(ay + t1 * dy, 6) AS by, t0 > 0 AS cut_start, t1 < 1 AS cut_end FROM t WHERE t0 < t1""")
def clipped_streets(t: Traffic) -> DataFrame:
    """Streets inside a box, and where it cuts them."""
    point = lambda x, y: F.struct(_c(x).alias("x"), _c(y).alias("y"))
    x = L.clip(t.street().select(_c("street_id").alias("line_id"), F.array(point("ax", "ay"), point("bx", "by")).alias("points")), _BOX)
    a, b = _c("points")[0], _c("points")[1]
    return x.select(_c("line_id").alias("street_id"), _r(a["x"]).alias("ax"), _r(a["y"]).alias("ay"), _r(b["x"]).alias("bx"), _r(b["y"]).alias("by"), "cut_start", "cut_end")


@query()
def simplified_journeys(t: Traffic) -> DataFrame:
    """The places of each customer's orders in order of key (the junction of the order after), as a line thinned out to two hundred metres."""
    o = t.table("orders").select("o_orderkey", "o_custkey")
    then = o.select((_c("o_orderkey") - 1).alias("o_orderkey"), _c("o_custkey").alias("junction_id"))
    stops = o.join(then, "o_orderkey").join(t.junction().select("junction_id", "x", "y"), "junction_id")
    lines = stops.groupBy(_c("o_custkey").alias("citizen_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "x", "y"))).alias("s"))
    lines = lines.select("citizen_id", F.size("s").alias("n_before"), F.transform("s", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    return L.simplify(lines, 200.0).withColumn("n_after", F.size("points"))
