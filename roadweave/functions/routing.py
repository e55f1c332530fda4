"""Column functions of route costs, choice and rerouting."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

#: Cost of what can't be reached, and the cost from which a node counts as out of reach.
UNREACHABLE, OUT_OF_REACH = 1e12, 0.5e12


def generalized_cost(free_flow, queue_delay, event_delay, turn_penalty, density_delay, weights: tuple[float, float, float, float, float] = (1.0, 1.0, 1.0, 1.0, 1.0)) -> Column:
    """Weighted sum of a route's components; a negative one fails."""
    parts = (free_flow, queue_delay, event_delay, turn_penalty, density_delay)
    total = sum((w * c for w, c in zip(weights[1:], parts[1:], strict=True)), weights[0] * parts[0])
    return F.when(F.least(*parts) < 0, F.raise_error("a cost component is negative").cast("double")).otherwise(total)


def path_logit_utility(cost, path_size, sigma: float = 1.0, gamma: float = 1.0) -> Column:
    return -sigma * cost + gamma * F.log(F.greatest(path_size, F.lit(1e-12)))


def should_reroute(hard_event, eta_now, eta_ref, steps_since, threshold: float = 0.20, refractory: int = 20) -> Column:
    return hard_event | ((eta_ref > 0) & (eta_now > (1 + threshold) * eta_ref) & (steps_since >= refractory))


def _unit(x) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def reroute_score(willingness, delay_sensitivity, exploration, improvement) -> Column:
    d = F.greatest(F.lit(0.0), delay_sensitivity)
    gain = F.least(F.lit(1.0), improvement * (0.75 + 0.75 * d / (1 + d)))
    return 0.45 * _unit(willingness) + 0.35 * gain + 0.20 * _unit(exploration)


def persistence_resistance(persistence) -> Column:
    return 0.40 + 0.15 * F.abs(persistence) / (1 + F.abs(persistence))


def reroute_decision(incident, cooldown, current, candidate, willingness, delay_sensitivity, exploration, persistence, min_improvement: float = 0.05, cooldown_after: int = 3) -> Column:
    """Struct (reroutes, reason, improvement, score, next_cooldown): the first reason of no incident, cooldown, invalid costs and too little to gain, else the score against the traveller's persistence."""
    gain = F.greatest(F.lit(0.0), (current - candidate) / F.greatest(current, F.lit(1e-6)))
    valid = (current > 0) & (candidate > 0) & ~F.isnan(current) & ~F.isnan(candidate) & (current < float("inf")) & (candidate < float("inf"))
    score = reroute_score(willingness, delay_sensitivity, exploration, gain)
    goes = (score >= persistence_resistance(persistence)) & (willingness > 0)
    reason = F.when(~incident, "no_incident").when(cooldown > 0, "cooldown").when(~F.coalesce(valid, F.lit(False)), "invalid_costs").when(gain < min_improvement, "insufficient_improvement").when(goes, "reroute").otherwise("persistence")
    reached = reason.isin("reroute", "persistence")
    return F.struct(
        (reason == "reroute").alias("reroutes"),
        reason.alias("reason"),
        F.when(reached | (reason == "insufficient_improvement"), gain).otherwise(0.0).alias("improvement"),
        F.when(reached, score).otherwise(0.0).alias("score"),
        F.when(reason == "no_incident", cooldown).when(reason == "cooldown", cooldown - 1).when(reason == "reroute", cooldown_after).otherwise(0).alias("next_cooldown"),
    )


def normalised(score, over: WindowSpec, prefer_higher: bool = True) -> Column:
    """A set's scores as preferences from 0 to 1; all 1 where they hardly differ, all 0 where one isn't finite."""
    s = score if prefer_higher else -score
    finite = ~(F.isnan(score) | (F.abs(score) == float("inf")) | score.isNull())
    safe = F.when(finite, s).otherwise(0.0)
    low, high = F.min(safe).over(over), F.max(safe).over(over)
    scaled = F.when(high - low <= 1e-6, 1.0).otherwise((safe - low) / F.greatest(high - low, F.lit(1e-6)))
    return F.when(F.bool_and(finite).over(over), scaled).otherwise(0.0)


def mixed(baseline, adaptive, share, baseline_only) -> Column:
    return F.when(baseline_only | (share <= 0) | adaptive.isNull(), baseline).otherwise((1 - share) * baseline + share * adaptive)


def mix_share(target, low: float, high: float, learning) -> Column:
    return F.when(~learning, 0.0).otherwise(_unit(F.least(F.lit(high), F.greatest(F.lit(low), target))))


def blend_fallback(learning, incident, has_signal, valid) -> Column:
    """Why only the baseline counts this tick; null if the blend holds."""
    return F.when(~learning, "no_signal").when(incident, "incident_mode").when(~has_signal, "no_signal").when(~valid, "invalid_output")


def action_cost(link_cost, cost_to_go, blocked) -> Column:
    """Cost of taking a link: UNREACHABLE if it is blocked or its end is out of reach."""
    return F.when(~blocked & (F.coalesce(cost_to_go, F.lit(UNREACHABLE)) < OUT_OF_REACH), link_cost + cost_to_go).otherwise(UNREACHABLE)


def path_size_factor(lengths, usage_count) -> Column:
    """Mean share of a path's lengths by how many use it; 1 for an empty path."""
    total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)
    parts = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x / total / F.greatest(usage_count, F.lit(1)))
    return F.when(total <= 0, 1.0).otherwise(F.greatest(parts, F.lit(1e-12)))
