"""Queries over the traffic projections, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadweave.sources.traffic import Traffic, oracle

MODULES = ("elementwise", "joins", "aggregates", "ranking", "graphs", "scalars", "ticks", "datasets", "checks", "interfaces")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of Traffic under its name; sql may name the projections."""

    def register(f: Callable[[Traffic], DataFrame]) -> Callable[[Traffic], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Traffic(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return register


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
