"""Generated populations, places and trips; random choices are hashes of a seed and a key, so they don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadweave.functions import encoding as E
from roadweave.operators.ranks import ranked


def quotas(pool: DataFrame, group: list[str], key: str, capacity: str, total: Column) -> DataFrame:
    """pool with `quota`: whole shares of `total` in proportion to capacity, at most the capacity in all; what is left over goes to the largest fractions, then the largest capacities, then the first keys.

    A group without capacity is dealt in turn.
    """
    w = Window.partitionBy(*group)
    turn = Window.partitionBy(*group).orderBy(key)
    x = pool.withColumn("_sum", F.sum(F.greatest(capacity, F.lit(0))).over(w)).withColumn("_n", F.count("*").over(w)).withColumn("_place", F.row_number().over(turn) - 1).withColumn("_total", F.greatest(total, F.lit(0)))
    x = x.withColumn("_take", F.least("_total", "_sum")).withColumn("_scaled", F.col("_take") * F.try_divide(F.greatest(capacity, F.lit(0)), F.col("_sum")))
    x = x.withColumn("_floor", F.floor("_scaled"))
    order = Window.partitionBy(*group).orderBy(F.desc(F.col("_scaled") - F.col("_floor")), F.desc(capacity), key)
    x = x.withColumn("_left", F.col("_take") - F.sum("_floor").over(w)).withColumn("_rank", F.row_number().over(order))
    shared = F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")
    in_turn = F.floor(F.col("_total") / F.col("_n")) + (F.col("_place") < F.col("_total") % F.col("_n")).cast("long")
    return x.withColumn("quota", F.when(F.col("_sum") > 0, shared).otherwise(in_turn).cast("long")).drop("_sum", "_n", "_place", "_total", "_take", "_scaled", "_floor", "_left", "_rank")


def slots(quota: DataFrame, key: str) -> DataFrame:
    """One row per unit of a quota."""
    return quota.where("quota > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("unit"))


def leisure_preferences(pool: DataFrame, key: str, seed: int) -> DataFrame:
    """(start, poi, weight): for each place three in a row of the key order, around the end, with random weights that sum to 1."""
    n = ranked(pool.select(key), key, total="n").select(key, (F.col("rank") - 1).alias("i"), "n")
    starts = n.select(F.col(key).alias("start"), "i", "n", F.explode(F.sequence(F.lit(0), F.least("n", F.lit(3)).cast("int") - 1)).alias("k"))
    x = starts.withColumn("at", F.pmod(F.col("i") + F.col("k"), F.col("n"))).join(n.select(F.col(key).alias("poi"), F.col("i").alias("at")), "at")
    raw = 0.5 + E.uniform(E.fold_in(seed, F.col("start"), F.col("k")))
    x = x.withColumn("raw", raw)
    return x.select("start", "poi", (F.col("raw") / F.sum("raw").over(Window.partitionBy("start"))).alias("weight"))


def behavior_profiles(spark, count: int, seed: int) -> DataFrame:
    """Linear ramps over the profiles with a little hash noise."""
    k = F.col("profile_id")
    noise = lambda name: (E.uniform(E.fold_in(seed, k, F.lit(name))) - 0.5) * 0.05
    ramp = k / max(1, count - 1)
    return spark.range(count).select(F.col("id").cast("int").alias("profile_id")).select(
        "profile_id", (0.75 + 1.05 * ramp + noise("delay")).alias("delay_sensitivity"), (0.25 + 0.56 * ramp + noise("will")).alias("reroute_willingness"), (1.0 - 0.875 * ramp + noise("stay")).alias("persistence_bias"), (0.05 + 0.21 * ramp + noise("explore")).alias("exploration_bias")
    )


def sample_profiles(citizens: DataFrame, profiles: DataFrame, weight: str, seed: int) -> DataFrame:
    """citizens with profile_id drawn by weight, with replacement. The few profiles are each row's options."""
    options = profiles.agg(F.array_sort(F.collect_list(F.struct("profile_id", F.col(weight).cast("double").alias("weight")))).alias("o"))
    roll = E.uniform(E.fold_in(seed, F.col("citizen_id")))
    named = F.transform("o", lambda x: F.struct(x["profile_id"].cast("string").alias("name"), x["weight"].alias("weight")))
    return citizens.crossJoin(F.broadcast(options)).withColumn("profile_id", E.weighted_choice(named, roll, "0").cast("int")).drop("o")  # one row


def trip_requests(citizens: DataFrame, seed: int, start_tick: int, jitter: int) -> DataFrame:
    """Trips of citizens (citizen_id, origin, propensity, options: array of name and weight): those whose roll is within their propensity, to a weighted destination, at a jittered tick.

    ids follow the order of citizens: each range of them is counted first, so that no task sees them all.
    """
    k = F.col("citizen_id")
    roll = lambda name: E.uniform(E.fold_in(seed, k, F.lit(name)))
    x = citizens.where(roll("include") <= F.col("propensity")).select(
        "citizen_id", "origin", E.weighted_choice(F.col("options"), roll("type"), "leisure").alias("destination_type"), (start_tick + F.floor(roll("jitter") * (jitter + 1))).cast("int").alias("planned_depart_tick"), F.floor(k / 4096).alias("_range")
    )
    sizes = x.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("citizen_id"))
    return x.join(sizes, "_range").select((F.col("_before") + place - 1).alias("trip_request_id"), "citizen_id", "origin", "destination_type", "planned_depart_tick")


def ring_city(spark, nodes: int, bridges: int = 0) -> DataFrame:
    """Links (u, v, kind) of a hub with a ring: spokes and ring both ways, and chords between opposite ring nodes as bridges."""
    i = F.col("id")
    ring = spark.range(1, nodes).select(i.alias("a"), F.when(i == nodes - 1, 1).otherwise(i + 1).alias("b"), F.lit("ring").alias("kind"))
    spokes = spark.range(1, nodes).select(F.lit(0).cast("long").alias("a"), i.alias("b"), F.lit("radial").alias("kind"))
    half = max(1, (nodes - 1) // 2)
    chords = spark.range(1, bridges + 1).select(i.alias("a"), (1 + (i - 1 + half) % (nodes - 1)).alias("b"), F.lit("bridge").alias("kind"))
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    return ring.unionByName(spokes).unionByName(chords).select(both, "kind").select("e.*", "kind")


def flow_workload(spark, links: int, turns_per_link: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Links and turns of a synthetic dense network, for throughput runs."""
    k = F.col("link_id")
    u = lambda name, *x: E.uniform(E.fold_in(seed, *x, F.lit(name)))
    link = spark.range(links).select(F.col("id").alias("link_id")).select("link_id", (u("queue", k) * 40).alias("queue_vehicles"), (5 + u("cap", k) * 20).alias("capacity"), (1 + u("base", k) * 5).alias("base_ticks"), F.lit(True).alias("is_blockable"))
    turn = link.select(k.alias("from_link_id"), F.explode(F.sequence(F.lit(1), F.lit(turns_per_link))).alias("j"))
    f, j = F.col("from_link_id"), F.col("j")
    turn = turn.select("from_link_id", F.pmod(f * turns_per_link + j * 7 + 1, F.lit(links)).alias("to_link_id"), f.alias("node_id"), F.lit(False).alias("is_forbidden"), F.lit(1.0).alias("base_priority"), (u("demand", f, j) * 8).alias("turn_demand"))
    return link, turn
