"""Ticks, streams, and state that is carried along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roadweave.plans import simulation as Sim
from roadweave.sources.traffic import Traffic

from . import query
from .aggregates import _TIMES, zone_times
from .elementwise import _edges

_c = F.col


def _r(x, n: int = 6):
    return F.round(x, n)


def links(t: Traffic) -> DataFrame:
    return t.link().select("link_id", "queue_vehicles", _c("capacity_veh_per_tick").alias("full_capacity"), (_c("length_m") / _c("free_flow_speed_mps")).alias("base_ticks"), "is_blockable")


def _tick_sql(n: int, start: int) -> str:
    """Each tick as common table expressions over the one before."""
    out = ["s0 AS (SELECT link_id, queue_vehicles AS q, capacity_veh_per_tick AS cap, length_m / free_flow_speed_mps AS base, is_blockable FROM tf_link)"]
    for k in range(1, n + 1):
        tick, p = start + k - 1, f"s{k - 1}"
        out.append(f"""m{k} AS (SELECT l.link_id, l.q, l.cap, l.base, l.is_blockable, l.cap * least(1.0, coalesce(min(CASE WHEN e.effect_model = 'closure' AND NOT l.is_blockable THEN NULL WHEN e.effect_model = 'closure' THEN 0.0 WHEN e.effect_model = 'capacity_reduction' THEN 1.0 - e.severity END), 1.0)) AS c
FROM {p} l LEFT JOIN tf_event e ON e.link_id = l.link_id AND {tick} BETWEEN e.start_tick AND e.end_tick GROUP BY l.link_id, l.q, l.cap, l.base, l.is_blockable),
f{k} AS (SELECT t.from_link_id, t.to_link_id, CASE WHEN is_forbidden THEN 0.0 ELSE least(turn_demand, least(least(a.q, a.c) * CASE WHEN fd > 0 THEN wd / fd ELSE 0.0 END, b.c * CASE WHEN td > 0 THEN wd / td ELSE 0.0 END)) END AS flow
FROM w t JOIN m{k} a ON a.link_id = t.from_link_id JOIN m{k} b ON b.link_id = t.to_link_id),
s{k} AS (SELECT m.link_id, greatest(0.0, m.q - coalesce(o.v, 0.0) + coalesce(i.v, 0.0)) AS q, m.cap, m.base, m.is_blockable, m.c, coalesce(o.v, 0.0) AS outflow FROM m{k} m LEFT JOIN (SELECT from_link_id AS l, sum(flow) AS v FROM f{k} GROUP BY 1) o ON o.l = m.link_id LEFT JOIN (SELECT to_link_id AS l, sum(flow) AS v FROM f{k} GROUP BY 1) i ON i.l = m.link_id)""")
    w = "w0 AS (SELECT *, CASE WHEN is_forbidden THEN 0.0 ELSE turn_demand * base_priority END AS wd FROM tf_turn), w AS (SELECT *, sum(wd) OVER (PARTITION BY from_link_id) AS fd, sum(wd) OVER (PARTITION BY to_link_id) AS td FROM w0)"
    return f"{w}, {', '.join(out)}"


@query(f"WITH {_tick_sql(1, 30)} SELECT link_id, round(q, 4) AS queue, round(outflow, 4) AS outflow, round(greatest(base, 1e-3) + q / greatest(c, 1e-3), 3) AS travel_time FROM s1")
def simulation_tick(t: Traffic) -> DataFrame:
    out = Sim.simulation_step(links(t), t.turn(), t.event(), 30)
    return out.select("link_id", _r("queue_vehicles", 4).alias("queue"), _r("outflow", 4).alias("outflow"), _r("travel_time", 3).alias("travel_time"))


@query(f"WITH {_tick_sql(3, 10)} " + " UNION ALL ".join(f"SELECT CAST({9 + k} AS INT) AS tick, round(sum(q), 3) AS queue_total, round(sum(outflow), 3) AS outflow_total, CAST(sum(CASE WHEN outflow > c + 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS n_over FROM s{k}" for k in (1, 2, 3)))
def rollout(t: Traffic) -> DataFrame:
    _, metrics = Sim.rollout(links(t), t.turn(), t.event(), [Sim.Control()] * 3, 10)
    return metrics.select("tick", _r("queue_total", 3).alias("queue_total"), _r("outflow_total", 3).alias("outflow_total"), "n_over")


@query()
def replay(t: Traffic) -> DataFrame:
    """The digests of two runs of the same ticks, one of them paused once in between; they agree."""
    link, turn, event = links(t), t.turn(), t.event()
    a, _ = Sim.rollout(link, turn, event, [Sim.Control()] * 2, 10)
    half, _ = Sim.rollout(link, turn, event, [Sim.Control(), Sim.Control(paused=True)], 10)
    b, _ = Sim.rollout(half, turn, event, [Sim.Control()], 11)
    return Sim.state_fingerprint(a).unionByName(Sim.state_fingerprint(b)).agg(F.count("*").alias("n_runs"), (F.count_distinct("digest") == 1).alias("same"))


@query(f"""WITH {_TIMES}, acc AS (SELECT o AS zone_id, 1 / greatest(avg(tt / greatest(job_capacity, 1.0)), 1e-6) AS a FROM m JOIN tf_zone z ON z.zone_id = m.d GROUP BY o) SELECT z.zone_id, round(population_capacity + 0.5 * a, 4) AS housing, round(job_capacity + 0.5 * a, 4) AS jobs FROM tf_zone z JOIN acc ON acc.zone_id = z.zone_id""")
def multirate_world(t: Traffic) -> DataFrame:
    """Steps 15 to 20: the land use of step 20 follows the snapshot of step 15."""
    zones = t.zone().select("zone_id", _c("population_capacity").cast("double").alias("housing"), _c("job_capacity").cast("double").alias("jobs"))
    edges, times, snapshot = _edges(t).withColumnRenamed("link_id", "edge_id"), zone_times(t), None
    for step in range(15, 21):
        edges, zones, snapshot = Sim.step_world(edges, zones, times, snapshot, step, Sim.Schedule())
    return zones.select("zone_id", _r("housing", 4).alias("housing"), _r("jobs", 4).alias("jobs"))


_OFFERS = "o AS (SELECT CAST(user_id % 5 AS INT) AS run_id, event_id AS tick, event_type AS payload, event_type = 'error' AS force FROM events)"


@query("""WITH o AS (SELECT trip_id AS tick, od_id AS run_id, outcome AS sig FROM tf_outcome), l AS (SELECT *, lag(sig) OVER (PARTITION BY run_id ORDER BY tick) AS before FROM o) SELECT run_id, tick, sig FROM l WHERE before IS DISTINCT FROM sig""")
def change_detected_packets(t: Traffic) -> DataFrame:
    """A run's packet whenever its signature changes."""
    before = F.lag("outcome").over(Window.partitionBy("od_id").orderBy("trip_id"))
    return t.outcome().withColumn("before", before).where(~_c("before").eqNullSafe(_c("outcome"))).select(_c("od_id").alias("run_id"), _c("trip_id").alias("tick"), _c("outcome").alias("sig"))


@query("SELECT CAST(planned_depart_tick // 10 AS INT) AS slot, count(*) AS n, CAST(sum(CASE WHEN stage = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS n_completed FROM tf_trip GROUP BY 1")
def cadence_metrics(t: Traffic) -> DataFrame:
    """A packet of counts every ten ticks."""
    return t.trip().groupBy(F.floor(_c("planned_depart_tick") / 10).cast("int").alias("slot")).agg(F.count("*").alias("n"), F.count_if(_c("stage") == "completed").alias("n_completed"))


@query("""WITH c AS (SELECT planned_depart_tick AS tick, count(*) AS generated, CAST(sum(CASE WHEN stage = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS completed FROM tf_trip GROUP BY 1)
SELECT tick, generated, completed, CAST(sum(generated) OVER w AS BIGINT) AS generated_total, CAST(sum(completed) OVER w AS BIGINT) AS completed_total FROM c WINDOW w AS (ORDER BY tick ROWS UNBOUNDED PRECEDING)""")
def metrics_accumulation(t: Traffic) -> DataFrame:
    c = t.trip().groupBy(_c("planned_depart_tick").alias("tick")).agg(F.count("*").alias("generated"), F.count_if(_c("stage") == "completed").alias("completed"))
    return Sim.accumulated(c, ["generated", "completed"], [], "tick")  # one row a tick


@query("""WITH RECURSIVE r(link_id, tick, residual, tokens) AS (SELECT link_id, 0, CAST(0.0 AS DOUBLE), CAST(0 AS BIGINT) FROM tf_link UNION ALL SELECT r.link_id, r.tick + 1, r.residual + 0.5 + l.lanes / 10.0 - floor(r.residual + 0.5 + l.lanes / 10.0 + 1e-9), CAST(floor(r.residual + 0.5 + l.lanes / 10.0 + 1e-9) AS BIGINT) FROM r JOIN tf_link l ON l.link_id = r.link_id WHERE r.tick < 6)
SELECT link_id, tick, tokens FROM r WHERE tick > 0""")
def residual_credits(t: Traffic) -> DataFrame:
    """Whole tokens of a fractional capacity, the rest carried along: the floor of the running sum less that of the one before."""
    per = 0.5 + _c("lanes") / 10.0
    x = t.link().select("link_id", per.alias("per"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("tick"))
    whole = lambda k: F.floor(_c("per") * k + 1e-9)
    return x.select("link_id", "tick", (whole(_c("tick")) - whole(_c("tick") - 1)).alias("tokens"))


@query("SELECT CAST(start_tick AS INT) AS tick, 'inject' AS control, event_id FROM tf_event UNION ALL SELECT CAST(end_tick + 1 AS INT), 'clear', event_id FROM tf_event")
def scenario_controls(t: Traffic) -> DataFrame:
    """Messages that inject an event at its start and clear it after its end."""
    e = t.event()
    both = F.array(F.struct(_c("start_tick").alias("tick"), F.lit("inject").alias("control")), F.struct((_c("end_tick") + 1).alias("tick"), F.lit("clear").alias("control")))
    return e.select("event_id", F.explode(both).alias("c")).select("c.tick", "c.control", "event_id")


def _streamed(t: Traffic, name: str, make) -> DataFrame:
    """What a streaming query appends, run over a whole table and written to the shared folder."""
    from roadweave.sources.shared import new_path

    path, spark = new_path(t.spark, name), t.spark
    stream = make(spark.readStream.schema(t.table("events").schema).parquet(f"{t._dir}/events.parquet*"))
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query()
def throttled_emission(t: Traffic) -> DataFrame:
    from roadweave.streaming.emission import throttled

    return _streamed(t, "emission", lambda s: throttled(s.select((_c("user_id") % 500).cast("int").alias("run_id"), _c("event_id").alias("tick"), _c("event_type").alias("payload"), (_c("event_type") == "error").alias("force")), 40))


def _updated(t: Traffic, name: str, make, key: list[str]) -> DataFrame:
    """The last row of each key that a streaming aggregation updates, run over a whole table; batches are written to the shared folder."""
    from roadweave.sources.shared import new_path

    path, spark = new_path(t.spark, name), t.spark
    stream = make(spark.readStream.schema(t.table("events").schema).parquet(f"{t._dir}/events.parquet*"))
    write = lambda df, batch: df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/out/_batch_dir={batch}")
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in key]
    rows = spark.read.schema(stream.withColumn("_batch", F.lit(0)).schema).parquet(f"{path}/out/*")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*key, "r.*")


@query("""WITH m AS (SELECT event_id, start_tick, end_tick, start_tick + d AS tick, event_id % 50 = 0 AND d = 0 AS clear FROM tf_event CROSS JOIN (VALUES (0), (5), (20)) v(d)), a AS (SELECT event_id, min(CASE WHEN NOT clear AND tick BETWEEN start_tick AND end_tick THEN tick END) AS f, min(CASE WHEN clear OR tick > end_tick THEN tick END) AS c FROM m GROUP BY event_id)
SELECT event_id, CAST(CASE WHEN c IS NULL OR f < c THEN f END AS BIGINT) AS active_at, CAST(c AS BIGINT) AS cleared_at, CASE WHEN c IS NOT NULL THEN 'cleared' WHEN f IS NOT NULL THEN 'active' ELSE 'scheduled' END AS stage FROM a""")
def event_lifecycle_stream(t: Traffic) -> DataFrame:
    from roadweave.streaming.learning import event_lifecycle

    def messages(s: DataFrame) -> DataFrame:
        a, b = _c("event_id") % 60, _c("event_id") % 60 + 1 + _c("user_id") % 10
        rows = F.array(*[F.struct(F.when((_c("event_id") % 50 == 0) & F.lit(d == 0), "clear").otherwise("tick").alias("kind"), (a + d).alias("tick")) for d in (0, 5, 20)])
        return s.select("event_id", a.alias("start_tick"), b.alias("end_tick"), F.explode(rows).alias("m")).select("event_id", "m.tick", "m.kind", "start_tick", "end_tick")

    return _updated(t, "lifecycle", lambda s: event_lifecycle(messages(s)), ["event_id"])


@query("SELECT CAST(user_id % 20 AS INT) AS od_id, CAST(event_id % 4 AS INT) AS arm, count(*) AS pulls, round(avg(value), 6) AS reward FROM events GROUP BY 1, 2")
def arm_means_stream(t: Traffic) -> DataFrame:
    from roadweave.streaming.learning import arm_means

    out = _updated(t, "arms", lambda s: arm_means(s.select((_c("user_id") % 20).cast("int").alias("od_id"), (_c("event_id") % 4).cast("int").alias("arm"), _c("value").alias("reward"))), ["od_id", "arm"])
    return out.withColumn("reward", _r("reward"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_event_counts(t: Traffic) -> DataFrame:
    """The batch form of windowed_counts(): tumbling windows of an hour."""
    w = F.window(_c("ts").cast("timestamp"), "1 hour")["start"].cast("timestamp_ntz")
    return t.table("events").groupBy(w.alias("start"), "event_type").agg(F.count("*").alias("n"), _r(F.sum("value"), 4).alias("total"))
