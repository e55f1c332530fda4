"""The traffic entities, projected from the parquet tables of a folder; and the same projections as SQL for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roadweave.plans.loops import cut

#: SQL of each projection, the same in Spark and DuckDB; they refer to each other in this order.
VIEWS = {
    "tf_zone": "SELECT CAST(r_regionkey AS INT) AS zone_id, CASE r_regionkey % 4 WHEN 0 THEN 'residential' WHEN 1 THEN 'cbd_commercial' WHEN 2 THEN 'industrial' ELSE 'mixed_use' END AS zone_type, CAST(1000 * (r_regionkey + 1) AS INT) AS population_capacity, CAST(500 * (r_regionkey + 2) AS INT) AS job_capacity FROM region",
    "tf_node": "SELECT CAST(n_nationkey AS INT) AS node_id, CAST(n_regionkey AS INT) AS zone_id, CAST((n_nationkey % 5) * 1000 AS DOUBLE) AS x, CAST(((n_nationkey - n_nationkey % 5) / 5) * 1000 AS DOUBLE) AS y FROM nation",
    "tf_flow": "SELECT s.s_nationkey AS u, c.c_nationkey AS v, count(*) AS n, sum(l.l_quantity) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE s.s_nationkey <> c.c_nationkey GROUP BY s.s_nationkey, c.c_nationkey",
    "tf_link": "SELECT CAST(a.n_nationkey * 25 + b.n_nationkey AS INT) AS link_id, CAST(a.n_nationkey AS INT) AS src_node_id, CAST(b.n_nationkey AS INT) AS dst_node_id, CASE (a.n_nationkey + b.n_nationkey) % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'collector' WHEN 2 THEN 'arterial' ELSE 'bridge' END AS road_class, CAST(200 + 50 * ((a.n_nationkey * 7 + b.n_nationkey * 3) % 9) AS DOUBLE) AS length_m, CAST(10.0 AS DOUBLE) AS free_flow_speed_mps, CAST(1 + (a.n_nationkey + b.n_nationkey) % 3 AS INT) AS lanes, CAST(10 + coalesce(f.n, 0) AS DOUBLE) AS capacity_veh_per_tick, round(CAST(coalesce(f.q, 0.0) AS DOUBLE) / 10.0, 4) AS queue_vehicles, CASE WHEN (a.n_nationkey + b.n_nationkey) % 4 = 3 THEN CAST(a.n_nationkey % 3 AS INT) ELSE NULL END AS bridge_group_id, (a.n_nationkey * b.n_nationkey) % 6 <> 5 AS is_blockable FROM nation a CROSS JOIN nation b LEFT JOIN tf_flow f ON f.u = a.n_nationkey AND f.v = b.n_nationkey WHERE (b.n_nationkey - a.n_nationkey + 25) % 25 IN (1, 2, 5, 7, 20, 24)",
    "tf_turn": "SELECT a.link_id AS from_link_id, b.link_id AS to_link_id, a.dst_node_id AS node_id, a.src_node_id = b.dst_node_id AS is_forbidden, CAST(1 + (a.link_id + b.link_id) % 3 AS DOUBLE) AS base_priority, CAST((a.link_id * 31 + b.link_id * 17) % 11 AS DOUBLE) AS turn_demand FROM tf_link a JOIN tf_link b ON a.dst_node_id = b.src_node_id",
    "tf_profile": "SELECT CAST(c_custkey % 8 AS INT) AS behavior_profile_id, c_custkey AS citizen_id, CAST(c_nationkey AS INT) AS home_node_id, 0.75 + 0.15 * CAST(c_custkey % 8 AS DOUBLE) AS delay_sensitivity, 0.25 + 0.08 * CAST(c_custkey % 8 AS DOUBLE) AS reroute_willingness, 1.0 - 0.125 * CAST(c_custkey % 8 AS DOUBLE) AS persistence_bias, 0.05 + 0.03 * CAST(c_custkey % 8 AS DOUBLE) AS exploration_bias FROM customer",
    "tf_trip": "SELECT o.o_orderkey AS trip_request_id, o.o_custkey AS citizen_id, CAST(c.c_nationkey AS INT) AS origin_node_id, CAST((c.c_nationkey + 1 + o.o_orderkey % 24) % 25 AS INT) AS destination_node_id, CAST(o.o_orderkey % 64 AS INT) AS planned_depart_tick, CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'active' END AS stage FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "tf_event": "SELECT event_id, CAST(event_id % 60 AS INT) AS start_tick, CAST(event_id % 60 + 1 + user_id % 10 AS INT) AS end_tick, CAST((event_id % 25) * 25 + (event_id % 25 + 1) % 25 AS INT) AS link_id, CASE WHEN event_type = 'error' THEN 'closure' WHEN event_type = 'signup' THEN 'unsupported' ELSE 'capacity_reduction' END AS effect_model, least(1.0, round(value / 100.0, 4)) AS severity FROM events",
    "tf_junction": "SELECT junction_id, CAST((junction_id % 40) * 100 + cents % 61 AS DOUBLE) AS x, CAST(((junction_id - junction_id % 40) / 40) * 100 + ((cents - cents % 61) / 61) % 61 AS DOUBLE) AS y, kind, balance FROM (SELECT c_custkey AS junction_id, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS cents, c_mktsegment AS kind, c_acctbal AS balance FROM customer)",
    "tf_street": "SELECT 8 * a.junction_id + w.way AS street_id, a.junction_id AS u, b.junction_id AS v, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, CASE WHEN a.balance > 9000 THEN 1 ELSE 0 END AS layer, a.balance BETWEEN 0 AND 1000 AS one_way FROM (SELECT *, junction_id % 40 AS col FROM tf_junction) a JOIN (VALUES (0, 1), (1, 40), (2, 41), (3, 39), (4, 83)) w(way, step) ON (way = 0 AND col < 39 AND kind IN ('HOUSEHOLD', 'BUILDING', 'AUTOMOBILE')) OR (way = 1 AND kind IN ('FURNITURE', 'BUILDING', 'HOUSEHOLD')) OR (way = 2 AND col < 39 AND kind = 'BUILDING') OR (way = 3 AND col > 0 AND kind = 'AUTOMOBILE') OR (way = 4 AND col < 37 AND balance < 0) JOIN tf_junction b ON b.junction_id = a.junction_id + w.step",
    "tf_outcome": "SELECT event_id AS trip_id, CAST(user_id % 20 AS INT) AS od_id, CAST(event_id % 4 AS INT) AS arm, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS outcome, value AS observed_travel_time, CAST(50.0 AS DOUBLE) AS baseline_travel_time, ts FROM events",
}


def oracle(sql: str) -> str:
    """SQL with the projections it names as leading common table expressions."""
    sql = sql.strip()
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    if not needed:
        return sql
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {sql[len('WITH RECURSIVE'):].lstrip()}"
    return f"WITH {head}, {sql[4:].lstrip()}" if sql.upper().startswith("WITH") else f"WITH {head} {sql}"


def _choice(key: Column, *values: str) -> Column:
    out = F.when(key == 0, values[0])
    for k, v in enumerate(values[1:-1], 1):
        out = out.when(key == k, v)
    return out.otherwise(values[-1])


class Traffic:
    """The entities as DataFrames: zone, node, link, turn, profile, trip, event, junction, street and outcome."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir, self._pairs = spark, sf_dir, None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")

    def zone(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.table("region").select(
            key.cast("int").alias("zone_id"),
            _choice(key % 4, "residential", "cbd_commercial", "industrial", "mixed_use").alias("zone_type"),
            (1000 * (key + 1)).cast("int").alias("population_capacity"),
            (500 * (key + 2)).cast("int").alias("job_capacity"),
        )

    def node(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.table("nation").select(
            key.cast("int").alias("node_id"),
            F.col("n_regionkey").cast("int").alias("zone_id"),
            ((key % 5) * 1000).cast("double").alias("x"),
            (((key - key % 5) / 5) * 1000).cast("double").alias("y"),
        )

    def _sent(self) -> DataFrame:
        """What is shipped between two nations, a row for each pair; made once for a query, however often its plan needs links."""
        if self._pairs is None:
            self._pairs = cut(self._shipped())
        return self._pairs

    def _shipped(self) -> DataFrame:
        return (
            self.table("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
            .join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("customer").select("c_custkey", F.col("c_nationkey").alias("v")), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("u")), F.col("l_suppkey") == F.col("s_suppkey"))
            .where("u <> v").groupBy("u", "v").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
        )

    def link(self) -> DataFrame:
        """Six links leave each node; capacity and queue come from what is shipped between two nations."""
        sent = self._sent()
        nation = self.table("nation")
        a = nation.select(F.col("n_nationkey").alias("u"))
        # the nodes that a node leads to are at fixed distances, so pairs need no cross join
        steps = F.explode(F.array(*[F.lit(k) for k in (1, 2, 5, 7, 20, 24)]))
        pairs = a.select("u", steps.alias("step")).select("u", ((F.col("u") + F.col("step")) % 25).alias("v"))
        pairs = pairs.join(nation.select(F.col("n_nationkey").alias("v")), "v").join(sent, ["u", "v"], "left")
        u, v = F.col("u"), F.col("v")
        return pairs.select(
            (u * 25 + v).cast("int").alias("link_id"),
            u.cast("int").alias("src_node_id"),
            v.cast("int").alias("dst_node_id"),
            _choice((u + v) % 4, "local", "collector", "arterial", "bridge").alias("road_class"),
            (200 + 50 * ((u * 7 + v * 3) % 9)).cast("double").alias("length_m"),
            F.lit(10.0).alias("free_flow_speed_mps"),
            (1 + (u + v) % 3).cast("int").alias("lanes"),
            (10 + F.coalesce("n", F.lit(0))).cast("double").alias("capacity_veh_per_tick"),
            F.round(F.coalesce(F.col("q").cast("double"), F.lit(0.0)) / 10.0, 4).alias("queue_vehicles"),
            F.when((u + v) % 4 == 3, (u % 3).cast("int")).alias("bridge_group_id"),
            ((u * v) % 6 != 5).alias("is_blockable"),
        )

    def turn(self, link: DataFrame | None = None) -> DataFrame:
        link = self.link() if link is None else link
        a = link.select(F.col("link_id").alias("from_link_id"), F.col("dst_node_id").alias("node_id"), F.col("src_node_id").alias("a"))
        b = link.select(F.col("link_id").alias("to_link_id"), F.col("src_node_id").alias("node_id"), F.col("dst_node_id").alias("b"))
        f, t = F.col("from_link_id"), F.col("to_link_id")
        return a.join(b, "node_id").select(
            "from_link_id", "to_link_id", "node_id", (F.col("a") == F.col("b")).alias("is_forbidden"), (1 + (f + t) % 3).cast("double").alias("base_priority"), ((f * 31 + t * 17) % 11).cast("double").alias("turn_demand")
        )

    def profile(self) -> DataFrame:
        k = F.col("c_custkey") % 8
        return self.table("customer").select(
            k.cast("int").alias("behavior_profile_id"),
            F.col("c_custkey").alias("citizen_id"),
            F.col("c_nationkey").cast("int").alias("home_node_id"),
            (0.75 + 0.15 * k.cast("double")).alias("delay_sensitivity"),
            (0.25 + 0.08 * k.cast("double")).alias("reroute_willingness"),
            (1.0 - 0.125 * k.cast("double")).alias("persistence_bias"),
            (0.05 + 0.03 * k.cast("double")).alias("exploration_bias"),
        )

    def trip(self) -> DataFrame:
        home = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        order = F.col("o_orderkey")
        status = F.col("o_orderstatus")
        return self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(home, "o_custkey").select(
            order.alias("trip_request_id"),
            F.col("o_custkey").alias("citizen_id"),
            F.col("c_nationkey").cast("int").alias("origin_node_id"),
            ((F.col("c_nationkey") + 1 + order % 24) % 25).cast("int").alias("destination_node_id"),
            (order % 64).cast("int").alias("planned_depart_tick"),
            F.when(status == "F", "completed").when(status == "O", "pending").otherwise("active").alias("stage"),
        )

    def event(self) -> DataFrame:
        key, kind = F.col("event_id"), F.col("event_type")
        return self.table("events").select(
            "event_id",
            (key % 60).cast("int").alias("start_tick"),
            (key % 60 + 1 + F.col("user_id") % 10).cast("int").alias("end_tick"),
            ((key % 25) * 25 + (key % 25 + 1) % 25).cast("int").alias("link_id"),
            F.when(kind == "error", "closure").when(kind == "signup", "unsupported").otherwise("capacity_reduction").alias("effect_model"),
            F.least(F.lit(1.0), F.round(F.col("value") / 100.0, 4)).alias("severity"),
        )

    def junction(self) -> DataFrame:
        """A place for each customer, forty to a row, somewhat off the grid; the network grows with the table."""
        cents, key = F.round(F.abs("c_acctbal") * 100).cast("long"), F.col("c_custkey")
        return self.table("customer").select(
            key.alias("junction_id"),
            ((key % 40) * 100 + cents % 61).cast("double").alias("x"),
            (((key - key % 40) / 40) * 100 + ((cents - cents % 61) / 61) % 61).cast("double").alias("y"),
            F.col("c_mktsegment").alias("kind"),
            F.col("c_acctbal").alias("balance"),
        )

    def street(self) -> DataFrame:
        """Streets between junctions, by the market segment and balance of the customer at their start: along rows and columns, diagonals, and avenues across."""
        a = self.junction().select(F.col("junction_id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"), "kind", "balance")
        b = self.junction().select(F.col("junction_id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
        col, kind = F.col("u") % 40, F.col("kind")
        ways = (
            (1, (col < 39) & kind.isin("HOUSEHOLD", "BUILDING", "AUTOMOBILE")),
            (40, kind.isin("FURNITURE", "BUILDING", "HOUSEHOLD")),
            (41, (col < 39) & (kind == "BUILDING")),
            (39, (col > 0) & (kind == "AUTOMOBILE")),
            (83, (col < 37) & (F.col("balance") < 0)),
        )
        way = F.filter(F.array(*[F.when(has, F.struct(F.lit(k).alias("way"), F.lit(step).alias("step"))) for k, (step, has) in enumerate(ways)]), lambda w: w.isNotNull())
        out = a.select("*", F.explode(way).alias("w")).withColumn("v", F.col("u") + F.col("w.step")).join(b, "v")
        return out.select(
            (8 * F.col("u") + F.col("w.way")).alias("street_id"), "u", "v", "ax", "ay", "bx", "by",
            F.when(F.col("balance") > 9000, 1).otherwise(0).alias("layer"), F.col("balance").between(0, 1000).alias("one_way"),
        )

    def outcome(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("trip_id"),
            (F.col("user_id") % 20).cast("int").alias("od_id"),
            (F.col("event_id") % 4).cast("int").alias("arm"),
            F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("outcome"),
            F.col("value").alias("observed_travel_time"),
            F.lit(50.0).alias("baseline_travel_time"),
            "ts",
        )
