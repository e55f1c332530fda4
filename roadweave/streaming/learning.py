"""Running means of bandit arms over a stream of rewards, and lifecycles of events on a clock of ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _means(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, mean = state.get if state.exists else (0, 0.0)
    for pdf in batches:
        k, total = len(pdf), float(pdf["reward"].sum())
        mean = (mean * n + total) / (n + k) if n + k else 0.0
        n += k
    state.update((n, mean))
    yield pd.DataFrame({"od_id": [key[0]], "arm": [key[1]], "pulls": [n], "reward": [mean]})


def arm_means(rewards: DataFrame) -> DataFrame:
    """Pulls and mean reward of each (od_id, arm) so far, from rewards (od_id, arm, reward). Rows of a batch are summed before its state is touched."""
    return rewards.groupBy("od_id", "arm").applyInPandasWithState(_means, "od_id int, arm int, pulls long, reward double", "pulls long, reward double", "update", GroupStateTimeout.NoTimeout)


def event_lifecycle(messages: DataFrame) -> DataFrame:
    """(event_id, active_at, cleared_at, stage) of each event, from messages (event_id, tick, kind 'schedule', 'tick' or 'clear', start_tick, end_tick).

    An event is active from the first tick within its span and cleared at the first one after it, or when told; one that is cleared before it is active never is.
    The state of an event is two numbers that merge in any order, so rows are aggregated before they are shuffled; for update mode.
    """
    inside = (F.col("kind") != "clear") & (F.col("tick") >= F.col("start_tick")) & (F.col("tick") <= F.col("end_tick"))
    over = (F.col("kind") == "clear") | (F.col("tick") > F.col("end_tick"))
    x = messages.groupBy("event_id").agg(F.min(F.when(inside, F.col("tick"))).alias("first"), F.min(F.when(over, F.col("tick"))).alias("cleared_at"))
    active = F.when(F.col("cleared_at").isNull() | (F.col("first") < F.col("cleared_at")), F.col("first"))
    return x.select("event_id", active.alias("active_at"), "cleared_at", F.when(F.col("cleared_at").isNotNull(), "cleared").when(active.isNotNull(), "active").otherwise("scheduled").alias("stage"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by tumbling window of `ts` and type; rows later than the watermark don't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
