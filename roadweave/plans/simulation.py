"""Ticks of the traffic dynamics as a loop of DataFrame stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from roadweave.functions import traffic as T
from roadweave.operators import flow as Flow
from roadweave.plans.loops import cut

#: Ticks between cuts of the lineage; each tick's metrics are read from its links, so that a cut also saves computing them again.
CUT_EVERY = 1


@dataclass(frozen=True)
class Control:
    """What a tick is told: whether it is paused, and events that are cleared by hand."""

    paused: bool = False
    cleared: tuple[int, ...] = ()


def simulation_step(link: DataFrame, turn: DataFrame, event: DataFrame, tick: int, control: Control = Control()) -> DataFrame:
    """Links after a tick: events set the capacity, the node model moves what queues, travel times follow. link: link_id, queue_vehicles, full_capacity, base_ticks, is_blockable.

    A paused tick changes nothing.
    """
    if control.paused:
        return link
    active = event.where(~F.col("event_id").isin(*control.cleared)) if control.cleared else event
    effects = Flow.event_effects(link, active, tick).select("link_id", "multiplier")
    now = link.drop("outflow", "inflow", "travel_time", "over_capacity").join(effects, "link_id").withColumn("capacity", T.effective_capacity(F.col("full_capacity"), F.col("multiplier")))
    moved = Flow.point_queue_step(turn, now)
    x = now.join(moved, "link_id")
    return x.select("link_id", F.col("queue_next").alias("queue_vehicles"), "full_capacity", "base_ticks", "is_blockable", "outflow", "inflow", F.col("travel_time_next").alias("travel_time"), "over_capacity")


def rollout(link: DataFrame, turn: DataFrame, event: DataFrame, controls: list[Control], start_tick: int = 0) -> tuple[DataFrame, DataFrame]:
    """(links after the last tick, metrics of each tick: tick, queue_total, outflow_total, n_over)."""
    turn, event = cut(turn), cut(event)
    state, rows = cut(link), []
    for k, control in enumerate(controls):
        state = simulation_step(state, turn, event, start_tick + k, control)
        if k % CUT_EVERY == CUT_EVERY - 1 or k == len(controls) - 1:
            state = cut(state)
        out = state if "outflow" in state.columns else state.withColumns({"outflow": F.lit(0.0), "over_capacity": F.lit(False)})
        flow = F.lit(0.0) if control.paused else F.sum("outflow")
        rows.append(out.agg(F.lit(start_tick + k).alias("tick"), F.sum("queue_vehicles").alias("queue_total"), flow.alias("outflow_total"), F.count_if("over_capacity").alias("n_over")))
    metrics = rows[0]
    for r in rows[1:]:
        metrics = metrics.unionByName(r)
    return state, metrics


def accumulated(metrics: DataFrame, counters: list[str], by: list[str], order: str) -> DataFrame:
    """Running totals of tick counters; a counter that falls adds nothing."""
    w = Window.partitionBy(*by).orderBy(order)
    return metrics.select("*", *[F.sum(F.greatest(F.col(c), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{c}_total") for c in counters])


@dataclass(frozen=True)
class Schedule:
    """Cadences of a world step; each is a positive number of steps and not shorter than the one before."""

    fast: int = 1
    medium: int = 5
    slow: int = 20

    def __post_init__(self) -> None:
        if not 0 < self.fast <= self.medium <= self.slow:
            raise ValueError("cadences are positive and ordered")


def step_world(edges: DataFrame, zones: DataFrame, times: DataFrame, snapshot: DataFrame | None, step: int, schedule: Schedule) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(edges, zones, snapshot) after a step of the three time scales.

    Fast: the mass balance of edges (edge_id, queue, stock, inflow, outflow, free_flow, capacity). Medium: a snapshot of accessibility (zone_id, accessibility)
    from times (o, d, tt) and zones (zone_id, housing, jobs). Slow: housing and jobs follow the snapshot of an earlier step, never the one of this step.
    """
    lagged = snapshot
    if step % schedule.medium == 0:
        if step % schedule.slow == 0 and snapshot is None:
            raise ValueError("land use follows an earlier snapshot only")
        jobs = zones.select(F.col("zone_id").alias("d"), F.greatest("jobs", F.lit(1.0)).alias("jobs"))
        snapshot = cut(times.join(jobs, "d").groupBy(F.col("o").alias("zone_id")).agg((1 / F.greatest(F.avg(F.col("tt") / F.col("jobs")), F.lit(1e-6))).alias("accessibility")))
    if step % schedule.fast == 0:
        new = T.edge_mass_balance(*map(F.col, ("queue", "stock", "inflow", "outflow", "free_flow", "capacity")))
        edges = edges.withColumn("n", new).withColumns({"queue": F.col("n.queue"), "stock": F.col("n.stock"), "travel_time": F.col("n.travel_time")}).drop("n")
    if step % schedule.slow == 0 and lagged is not None:
        delta = T.landuse_delta(F.coalesce("accessibility", F.lit(0.0)), 0.5)
        zones = cut(zones.join(lagged, "zone_id", "left").select("zone_id", T.landuse_applied(F.col("housing"), delta).alias("housing"), T.landuse_applied(F.col("jobs"), delta).alias("jobs")))
    return edges, zones, snapshot


def state_fingerprint(df: DataFrame, digits: int = 6) -> DataFrame:
    """One row: a digest of a state that doesn't depend on the order of its rows, for replays. Doubles count to `digits` decimals."""
    parts = [F.coalesce((F.round(c, digits) if t == "double" else F.col(c)).cast("string"), F.lit("\0")) for c, t in sorted(df.dtypes)]
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*parts).cast("decimal(38,0)")).alias("digest"))
