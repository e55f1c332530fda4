"""Cached candidate routes: why a set is made anew, merging, pruning; and the splicing of new tails into routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from roadweave.functions import routing as R

#: Columns of a cache besides what its sets hold.
KEYS = ("od_id", "origin_id", "destination_id")


def refresh_reasons(requests: DataFrame, cache: DataFrame, tick: int, interval: int = 8, incident_refreshes: bool = True) -> DataFrame:
    """requests (od_id, origin_id, destination_id, incident, forced; one row an od) with version of the cached set and `reason` to make it anew; null: it is used as it is.

    In this order: it is forced; no set is cached, or one between other nodes; an incident; the clock was moved back behind the last refresh;
    the last refresh is `interval` ticks ago. Null incident or forced: false.
    """
    if interval < 1:
        raise ValueError("the refresh interval is at least one tick")
    kept = cache.select("od_id", F.col("origin_id").alias("_o"), F.col("destination_id").alias("_d"), "refreshed_at", "version")
    x = requests.join(kept, "od_id", "left")
    same = F.col("refreshed_at").isNotNull() & (F.col("_o") == F.col("origin_id")) & (F.col("_d") == F.col("destination_id"))
    reason = (
        F.when(F.coalesce("forced", F.lit(False)), "forced").when(~F.coalesce(same, F.lit(False)), "missing")
        .when(F.coalesce("incident", F.lit(False)) & F.lit(incident_refreshes), "incident").when(F.col("refreshed_at") > tick, "clock").when(tick - F.col("refreshed_at") >= interval, "interval")
    )
    return x.select(*requests.columns, "version", reason.alias("reason"))


def refreshed(requests: DataFrame, cache: DataFrame, tick: int, build: Callable[[DataFrame], DataFrame], interval: int = 8, incident_refreshes: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cache, decisions) after a tick: sets with a reason are replaced by what `build` makes of their ods (od_id and its columns), a version on; all others stay, those not asked for too.

    cache: od_id, origin_id, destination_id, refreshed_at, version and the columns of `build`; an od that build gives no row has nulls there.
    """
    decisions = refresh_reasons(requests, cache, tick, interval, incident_refreshes)
    old = decisions.where("reason IS NOT NULL")
    made = old.select(*KEYS, F.lit(tick).alias("refreshed_at"), (F.coalesce("version", F.lit(0)) + 1).alias("version"))
    made = made.join(build(made.select(*KEYS)), "od_id", "left")
    return cache.join(old.select("od_id"), "od_id", "left_anti").unionByName(made.select(*cache.columns)), decisions


def pruned(cache: DataFrame, *scope: tuple[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): entries whose scope columns equal the current values, nulls included; counts is one row (n_kept, n_pruned)."""
    current = F.lit(True)
    for name, value in scope:
        current &= F.col(name).eqNullSafe(value)
    counts = cache.agg(F.count_if(current).alias("n_kept"), F.count_if(~current).alias("n_pruned"))
    return cache.where(current), counts


def tail_requests(agents: DataFrame, links: DataFrame) -> DataFrame:
    """(od_id, origin_id, destination_id, incoming_link_id): a search for each different pair of current link and destination of agents that still have links to go."""
    ends = links.select(F.col("link_id").alias("current_link_id"), F.col("dst_node_id").alias("origin_id"))
    asked = agents.where(F.size(_tail()) > 0).select("current_link_id", "destination_id").distinct().join(ends, "current_link_id").where("origin_id <> destination_id")
    key = F.concat_ws(":", "current_link_id", "destination_id")
    return asked.select(key.alias("od_id"), "origin_id", "destination_id", F.col("current_link_id").alias("incoming_link_id"))


def _place() -> Column:
    """Place from 1 of the current link in the path: where the pointer says, else its first occurrence, 0 if there is none."""
    at = F.try_element_at("path", F.greatest(F.col("at") + 1, F.lit(1)))
    return F.when((F.col("at") >= 0) & (at == F.col("current_link_id")), F.col("at") + 1).otherwise(F.array_position("path", F.col("current_link_id")).cast("int"))


def _tail() -> Column:
    return F.when(_place() > 0, F.slice("path", _place() + 1, F.size("path"))).otherwise(F.array().cast("array<int>"))


def _prefix() -> Column:
    return F.when(_place() > 0, F.slice("path", F.lit(1), F.greatest(_place(), F.lit(1)))).otherwise(F.array("current_link_id"))


def rerouted(agents: DataFrame, tails: DataFrame, costs: DataFrame) -> DataFrame:
    """agents with `route` (the path they take from now on), `reason` and `next_cooldown`.

    agents: agent_id, path, at (0-based place in it), current_link_id, destination_id, cooldown, willingness, delay_sensitivity, exploration, persistence.
    tails: incoming_link_id, destination_id, path, cost, one row for each pair. costs: link_id, cost. An agent that waits counts down; one without a tail,
    or whose new tail is missing or the same, goes on (`cooldown`, `no_tail`, `same_tail`); for others the traveller decides between what
    is left of the path and the new tail, which then follows the links up to the current one.
    """
    new = tails.select(F.col("incoming_link_id").alias("current_link_id"), "destination_id", F.col("path").alias("new_tail"), F.col("cost").alias("new_cost"))
    x = agents.withColumn("tail", _tail()).join(new, ["current_link_id", "destination_id"], "left")
    hops = x.select("agent_id", F.explode("tail").alias("link_id")).join(costs.select("link_id", F.col("cost").alias("step")), "link_id", "left")
    # a link without a cost above 0 makes the whole worthless
    left = hops.groupBy("agent_id").agg(F.when(F.bool_and(F.coalesce(F.col("step") > 0, F.lit(False))), F.sum("step")).otherwise(F.lit(float("inf"))).alias("old_cost"))
    x = x.join(left, "agent_id", "left")
    d = R.reroute_decision(F.lit(True), F.lit(0), F.col("old_cost"), F.col("new_cost"), F.col("willingness"), F.col("delay_sensitivity"), F.col("exploration"), F.col("persistence"))
    x = x.withColumn("d", d)
    idle = F.when(F.col("cooldown") > 0, "cooldown").when(F.size("tail") == 0, "no_tail").when(F.coalesce(F.size("new_tail"), F.lit(0)) <= 0, "no_tail").when(F.col("new_tail") == F.col("tail"), "same_tail")
    reason = F.coalesce(idle, F.col("d.reason"))
    after = F.when(F.col("cooldown") > 0, F.col("cooldown") - 1).when(idle.isNotNull(), F.col("cooldown")).otherwise(F.col("d.next_cooldown"))
    route = F.when(reason == "reroute", F.concat(_prefix(), F.col("new_tail"))).otherwise(F.col("path"))
    return x.select(*agents.columns, route.alias("route"), reason.alias("reason"), after.alias("next_cooldown"))
