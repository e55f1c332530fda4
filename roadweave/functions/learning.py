"""Column functions of rewards, bandits and running means."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trip_reward(outcome, observed, baseline) -> Column:
    """1 / (1 + observed / baseline) of a completed trip (1 if not observed); one less for a failed one."""
    base = F.greatest(baseline, F.lit(1e-6))
    ratio = F.greatest(F.coalesce(observed, F.lit(0.0)), F.lit(0.0)) / base
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / (1 + ratio)))
    failed = F.least(F.lit(0.0), F.greatest(F.lit(-1.0), -1 + 1 / (1 + ratio)))
    return F.when(outcome == "completed", done).when(outcome == "failed", failed)


def ema(old, observed, rate: float) -> Column:
    if not 0 <= rate <= 1:
        raise ValueError("rate is 0 to 1")
    return (1 - rate) * old + rate * observed


def arm_update(value, reward, alpha: float) -> Column:
    return value + alpha * (reward - value)


def ucb(reward, pulls, all_pulls, scale: float = 1.0) -> Column:
    """Upper confidence bound; an arm that was never pulled comes first."""
    return F.when(pulls == 0, 1e9).otherwise(reward + scale * F.sqrt(F.log(F.greatest(all_pulls, F.lit(1)) + 1.0) / F.greatest(pulls, F.lit(1))))
