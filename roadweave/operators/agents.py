"""Vehicles under integer budgets: admission, token commit, reservations; as ranks within what is shared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def within_budget(asks: DataFrame, budgets: DataFrame, key: list[str], order: list[str], budget: str) -> DataFrame:
    """asks with `granted`: the first rows of each key in the order, as many as its budget (none without one)."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return asks.withColumn("_rank", rank).join(budgets.select(*key, budget), key, "left").withColumn("granted", F.col("_rank") <= F.coalesce(F.col(budget), F.lit(0))).drop("_rank", budget)


def reservations(routes: DataFrame, demand: DataFrame, strength: float) -> DataFrame:
    """Vehicles of each route: od_id, candidate_id, n. routes: od_id, candidate_id, base, capacity; demand: od_id, demand.

    The n-th vehicle of a route costs base + strength * n / capacity; an od's vehicles take the cheapest units, ties by route. The costs of a route's units
    rise, so that ranking all units is the same as adding one vehicle after another.
    """
    units = routes.join(demand, "od_id").where(F.col("demand") > 0).withColumn("n", F.explode(F.sequence(F.lit(1), "demand")))
    marginal = F.col("base") + strength * F.col("n") / F.greatest("capacity", F.lit(1e-6))
    w = Window.partitionBy("od_id").orderBy("marginal", "candidate_id", "n")
    taken = units.withColumn("marginal", marginal).withColumn("r", F.row_number().over(w)).where("r <= demand").groupBy("od_id", "candidate_id").agg(F.count("*").alias("n"))
    return routes.select("od_id", "candidate_id").join(taken, ["od_id", "candidate_id"], "left").fillna(0, ["n"])


def admission(trips: DataFrame, space: DataFrame, free_slots: int) -> DataFrame:
    """trips with outcome 'admitted', 'no_route' or 'waiting'. trips: trip_id, link_id (of its first link; null: no route); space: link_id, space.

    In order of trip_id: a trip waits once the free slots are used up; before that it fails without a route, and takes a slot if its link has space. Slots are
    global, so after the ranks by link the trips that would take one are cut at the free_slots-th of them: only that trip's id is needed, which a sort of
    at most free_slots rows gives.
    """
    by_link = F.row_number().over(Window.partitionBy("link_id").orderBy("trip_id"))
    x = trips.withColumn("r", by_link).join(space, "link_id", "left").withColumn("fits", F.col("link_id").isNotNull() & (F.col("r") <= F.floor(F.coalesce("space", F.lit(0.0)))))
    last = x.where("fits").orderBy("trip_id").limit(free_slots).agg(F.count("*").alias("n"), F.max("trip_id").alias("last"))
    y = x.crossJoin(F.broadcast(last))  # one row
    open_ = (F.col("n") < free_slots) | (F.col("trip_id") <= F.col("last")) if free_slots else F.lit(False)
    return y.withColumn("outcome", F.when(~open_, "waiting").when(F.col("link_id").isNull(), "no_route").when(F.col("fits"), "admitted").otherwise("waiting")).select("trip_id", "link_id", "outcome")
