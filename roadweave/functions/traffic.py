"""Column functions of link dynamics, demand and zones."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-6
#: Windows of the day in minutes, and the demand multipliers of the default schedule.
PEAKS = {"morning": (420, 540), "midday": (690, 780), "evening": (1020, 1140)}
MULTIPLIERS = {("weekday", None): 1.0, ("weekday", "morning"): 1.7, ("weekday", "midday"): 1.15, ("weekday", "evening"): 1.55, ("weekend", None): 0.8, ("weekend", "midday"): 1.3, ("weekend", "evening"): 1.1}


def _floor(value, low: float) -> Column:
    return F.greatest(value, F.lit(low))


def safe_travel_time(free_flow, queue, capacity, eps: float = EPS) -> Column:
    """Free flow and the wait of the queue; a negative capacity fails."""
    return F.when(capacity >= 0, free_flow + queue / _floor(capacity, eps)).otherwise(F.raise_error("capacity is negative").cast("double"))


def edge_mass_balance(queue, stock, inflow, outflow, free_flow, capacity) -> Column:
    """Struct (outflow, stock, queue, travel_time) of an edge after a step: what flows out is there and fits the capacity, what doesn't get out queues."""
    out = F.when(capacity <= 0, 0.0).otherwise(F.least(outflow, stock + inflow, capacity))
    left = stock + inflow - out
    queued = F.least(_floor(queue + _floor(inflow - out, 0.0), 0.0), left)
    return F.struct(out.alias("outflow"), left.alias("stock"), queued.alias("queue"), safe_travel_time(free_flow, queued, capacity).alias("travel_time"))


def feasible_movement(sending, receiving, movement_cap) -> Column:
    return _floor(F.least(sending, receiving, movement_cap), 0.0)


def refreshed_travel_time(base_ticks, queue, capacity) -> Column:
    return _floor(base_ticks, 1e-3) + _floor(queue, 0.0) / _floor(capacity, 1e-3)


def effective_capacity(capacity, multiplier) -> Column:
    return capacity * multiplier


def free_flow_ticks(length_m, speed_mps, tick_seconds: float = 1.0) -> Column:
    return _floor(length_m / _floor(speed_mps, 1e-3) / tick_seconds, 1e-3)


def is_blocked(effective, is_blockable) -> Column:
    return (effective <= 0) & is_blockable


def storage_capacity(length_m, lanes, jam_spacing_m: float = 7.5) -> Column:
    if not 2 <= jam_spacing_m <= 20:
        raise ValueError("jam spacing is 2 to 20 m")
    return _floor(F.floor(length_m * lanes / jam_spacing_m), 1).cast("double")


def progress_after(progress, speed_mps, length_m, tick_seconds: float = 1.0) -> Column:
    return F.least(F.lit(1.0), progress + speed_mps * tick_seconds / length_m)


def event_multiplier(effect_model, severity) -> Column:
    """Capacity multiplier of an event; null for a model that has none."""
    cut = F.least(F.lit(1.0), _floor(1.0 - severity, 0.0))
    return F.when(effect_model == "closure", 0.0).when(effect_model == "capacity_reduction", cut)


def demand_multiplier(day_type, minute) -> Column:
    out = F.when((minute < 0) | (minute >= 1440), F.raise_error("minute is 0 to 1439").cast("double"))
    for (day, peak), value in MULTIPLIERS.items():
        if peak:
            a, b = PEAKS[peak]
            out = out.when((day_type == day) & (minute >= a) & (minute < b), value)
    return out.when(day_type == "weekday", MULTIPLIERS["weekday", None]).when(day_type == "weekend", MULTIPLIERS["weekend", None])


def scheduled_trips(population, base_rate, multiplier) -> Column:
    """Rounded half to even."""
    return F.bround(population * base_rate * multiplier, 0).cast("long")


def zone_capacities(zone_type, share, population: int) -> Column:
    """Struct (population, jobs, leisure) of a zone's type and its share of the population."""
    base = _floor(F.bround(population * share, 0), 1).cast("long")
    div = lambda x, n: F.floor(x / n)
    one = lambda x: _floor(x, 1).cast("long")
    rows = {
        "residential": (base, one(div(base, 5)), one(div(base, 4))),
        "cbd_commercial": (one(div(base, 5)), (base * 2).cast("long"), one(div(base, 2))),
        "industrial": (one(div(base, 8)), div(base * 3, 2).cast("long"), one(div(base, 6))),
    }
    mixed = (one(F.floor(base * 0.8)), one(F.floor(base * 0.9)), one(F.floor(base * 0.8)))
    cols = []
    for k, name in enumerate(("population", "jobs", "leisure")):
        out = F.when(zone_type == "residential", rows["residential"][k]).when(zone_type == "cbd_commercial", rows["cbd_commercial"][k]).when(zone_type == "industrial", rows["industrial"][k])
        cols.append(out.otherwise(mixed[k]).alias(name))
    return F.struct(*cols)


def poi_capacity(poi_type, population, jobs, leisure) -> Column:
    return _floor(F.floor(F.when(poi_type == "home", population).when(poi_type == "workplace", jobs).otherwise(leisure) / 10), 1).cast("long")


def landuse_delta(accessibility, gain: float) -> Column:
    return gain * _floor(accessibility, 0.0)


def landuse_applied(capacity, delta) -> Column:
    return _floor(capacity + delta, 0.0)


def runs_at(step, every: int) -> Column:
    return F.pmod(step, F.lit(every)) == 0


def min_emit_interval(tick_seconds, hz_limit) -> Column:
    return _floor(F.ceil(1 / (tick_seconds * hz_limit)), 1).cast("int")
