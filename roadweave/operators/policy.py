"""Policy plugins: named scorers of actions that learn from outcomes, run over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Policy(Protocol):
    """What a plugin gives: scores of actions from their features, row by row and vectorised."""

    name: str

    def score_actions(self, features: pd.DataFrame) -> pd.Series: ...


_PLUGINS: dict[str, Callable[[], Policy]] = {}


def register(name: str) -> Callable:
    """Registers a plugin's factory; a name is taken once."""

    def put(factory: Callable[[], Policy]) -> Callable[[], Policy]:
        if name in _PLUGINS:
            raise ValueError(f"{name} is registered already")
        _PLUGINS[name] = factory
        return factory

    return put


def plugin(name: str) -> Policy:
    if name not in _PLUGINS:
        raise KeyError(f"no policy {name}; there are {sorted(_PLUGINS)}")
    return _PLUGINS[name]()


def scored(actions: DataFrame, name: str, features: list[str]) -> DataFrame:
    """actions with `score` of the named plugin. The plugin is made on the driver, and its scores are whole Arrow batches."""
    policy = plugin(name)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        return policy.score_actions(x).astype("float64")

    return actions.withColumn("score", score(F.struct(*features)))


@register("linear")
class Linear:
    """Less cost and more reward is better."""

    name = "linear"

    def score_actions(self, features: pd.DataFrame) -> pd.Series:
        return features["reward"] - 0.01 * features["cost"]


class Learner(Protocol):
    """What a plugin that learns gives: its state is a table, so that any number of keys is kept and updates merge."""

    name: str
    version: str
    supports_online_update: bool
    supports_batch_context: bool

    def init(self, actions: DataFrame) -> DataFrame: ...

    def score_actions(self, actions: DataFrame, state: DataFrame) -> DataFrame: ...

    def update_online(self, state: DataFrame, outcomes: DataFrame) -> DataFrame: ...


_LEARNERS: dict[str, type] = {}


def register_learner(cls: type) -> type:
    """Registers a plugin that learns by its name: ValueError if the name is empty or taken, or if a method or a statement of identity is missing or of the wrong kind."""
    name = getattr(cls, "name", None)
    if not isinstance(name, str) or not name.strip():
        raise ValueError("a plugin needs a name")
    if name in _LEARNERS:
        raise ValueError(f"{name} is registered already")
    if not isinstance(getattr(cls, "version", None), str) or not cls.version.strip():
        raise ValueError("a plugin needs a version")
    for flag in ("supports_online_update", "supports_batch_context"):
        if not isinstance(getattr(cls, flag, None), bool):
            raise ValueError(f"{flag} must be true or false")
    for method in ("init", "score_actions", "update_online"):
        if not callable(getattr(cls, method, None)):
            raise ValueError(f"a plugin needs {method}")
    _LEARNERS[name] = cls
    return cls


def learner(name: str) -> Learner:
    if name not in _LEARNERS:
        raise KeyError(f"no learner {name}; there are {sorted(_LEARNERS)}")
    return _LEARNERS[name]()


@register_learner
class RunningMean:
    """The mean reward of each od's arm so far; an arm without an outcome scores `prior`."""

    name, version = "running_mean", "1"
    supports_online_update = supports_batch_context = True
    prior = 0.5

    def init(self, actions: DataFrame) -> DataFrame:
        return actions.select("od_id", "arm", F.lit(0).cast("long").alias("pulls"), F.lit(0.0).alias("total")).distinct()

    def score_actions(self, actions: DataFrame, state: DataFrame) -> DataFrame:
        x = actions.join(state, ["od_id", "arm"], "left")
        return x.select(*actions.columns, F.when(F.col("pulls") > 0, F.col("total") / F.col("pulls")).otherwise(self.prior).alias("score"))

    def update_online(self, state: DataFrame, outcomes: DataFrame) -> DataFrame:
        """outcomes: od_id, arm, reward. Sums merge in any order; arms not seen before are added, null rewards don't count."""
        new = outcomes.where("reward IS NOT NULL").groupBy("od_id", "arm").agg(F.count("*").alias("n"), F.sum("reward").alias("s"))
        x = state.join(new, ["od_id", "arm"], "full_outer")
        return x.select("od_id", "arm", (F.coalesce("pulls", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("pulls"), (F.coalesce("total", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("total"))
