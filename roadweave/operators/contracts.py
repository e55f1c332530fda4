"""Contracts and invariants: every broken rule is a row that names the check, the rule and the subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KIND = "check string, code string, subject string"


def broken(df: DataFrame, check: str, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """(check, code, subject) for each row of df and rule that it breaks; all rules in one pass. A rule that is null isn't broken."""
    found = F.filter(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]), lambda c: c.isNotNull())
    return df.select(F.lit(check).alias("check"), F.explode(found).alias("code"), subject.cast("string").alias("subject"))


def without(df: DataFrame, check: str, code: str, subject: str, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df that refer to none of others. A null reference is one too."""
    return df.join(others.select(*on).distinct(), on, "left_anti").select(F.lit(check).alias("check"), F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"))


def repeated(df: DataFrame, check: str, code: str, key: str) -> DataFrame:
    """Keys that several rows have."""
    return df.groupBy(F.col(key).cast("string").alias("subject")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(check).alias("check"), F.lit(code).alias("code"), "subject")


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(rows: DataFrame, checks: tuple[str, ...]) -> DataFrame:
    """(check, n, passed) of each check, also of those without a broken rule."""
    names = F.explode(F.array(*map(F.lit, checks))).alias("check")
    all_ = rows.sparkSession.range(1).select(names)
    n = rows.groupBy("check").agg(F.count("*").alias("n"))
    return all_.join(n, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("passed"))


#: The eight checks of a state of the simulation.
INVARIANTS = ("active_agent_pool_consistency", "non_negative_queue", "finite_link_storage", "runtime_vehicle_queue_authority", "runtime_token_authority", "capacity_flags", "conservation", "trip_lifecycle_disjoint")


def invariants(links: DataFrame, agents: DataFrame, trips: DataFrame, totals: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(check, code, subject) of the eight checks of a state.

    links: link_id, queue, storage, outflow, inflow, capacity, receiving, flag, service_residual, receiving_residual, service_tokens, receiving_tokens;
    agents: agent_id, path, at, link_id (where the agent is; a vehicle of that link's queue); trips: trip_id, stage (one row for each stage a trip is in);
    totals: generated, pending, active, completed, failed (one row).
    """
    c = F.col
    finite = lambda x: ~(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    out_over, in_over = c("outflow") > c("capacity") + tolerance, c("inflow") > c("receiving") + tolerance
    link = c("link_id")
    per_link = agents.groupBy("link_id").agg(F.count("*").alias("n"))
    counted = links.select("link_id", F.floor(c("queue") + tolerance).alias("queue")).join(per_link, "link_id", "full_outer").select("link_id", F.coalesce("queue", F.lit(0)).alias("queue"), F.coalesce("n", F.lit(0)).alias("n"))
    whole = lambda x: F.abs(c(x) - F.round(x)) > tolerance
    unit = lambda x: (c(x) < 0) | (c(x) >= 1)
    at = F.try_element_at("path", F.greatest(c("at") + 1, F.lit(1)))
    stages = trips.groupBy("trip_id").agg(F.count_distinct("stage").alias("n"))
    pool, queue, storage, vehicles, tokens, flags, conservation, lifecycle = INVARIANTS
    return together([
        repeated(agents, pool, "agent_repeated", "agent_id"),
        broken(agents, pool, c("agent_id"), {"place_outside_path": (c("at") < 0) | (c("at") >= F.size("path")), "link_not_at_place": at != c("link_id")}),
        broken(links, queue, link, {"non_finite_queue": ~finite(c("queue")), "negative_queue": c("queue") < 0}),
        broken(links, storage, link, {"invalid_storage": ~finite(c("storage")) | (c("storage") < 1), "storage_exceeded": c("queue") > c("storage") + tolerance}),
        broken(counted, vehicles, link, {"queue_is_not_agents": c("queue") != c("n")}),
        broken(links, tokens, link, {"service_residual_outside_unit": unit("service_residual"), "receiving_residual_outside_unit": unit("receiving_residual"), "service_tokens_not_whole": whole("service_tokens"), "receiving_tokens_not_whole": whole("receiving_tokens")}),
        broken(links, flags, link, {"non_finite_flow": ~(finite(c("outflow")) & finite(c("inflow")) & finite(c("capacity")) & finite(c("receiving"))), "capacity_exceeded": out_over | in_over, "flag_mismatch": c("flag") != (out_over | in_over)}),
        broken(totals, conservation, F.lit("trips"), {"conservation_mismatch": c("generated") != c("pending") + c("active") + c("completed") + c("failed")}),
        broken(stages, lifecycle, c("trip_id"), {"trip_in_two_stages": c("n") > 1}),
    ])
