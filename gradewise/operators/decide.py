"""Verdicts and actions as columns: one ladder serves a row and a billion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewise.plans.spec import Gates


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def has_power(n: Column, defaults: Column, g: Gates) -> Column:
    return _sure((n >= g.min_n) & (defaults >= g.min_events))


def rank_order_pass(gini: Column, ci_low: Column, overall: Column, g: Gates) -> Column:
    """Above the floor, and near the pooled Gini or surely above the floor."""
    return _sure(gini >= g.gini_floor) & (_sure((overall != 0) & (gini / F.when(overall != 0, overall) >= g.gini_ratio_floor)) | _sure(ci_low >= g.gini_floor))


def calibration_pass(oe: Column, ece: Column, g: Gates) -> Column:
    return _sure(oe.between(g.oe_lo, g.oe_hi) & (ece <= g.ece_max))


def stability_pass(ratio: Column, g: Gates) -> Column:
    return F.coalesce(ratio >= g.vintage_gini_ratio_floor, F.lit(True))


def q1_verdict(n: Column, defaults: Column, gini: Column, ci_low: Column, overall: Column, oe: Column, ece: Column, ratio: Column, g: Gates) -> tuple[Column, Column]:
    """The verdict, and the failed pillars joined by semicolons."""
    power = has_power(n, defaults, g)
    failed = F.array_compact(F.array(
        F.when(~rank_order_pass(gini, ci_low, overall, g), F.lit("rank_order")),
        F.when(~calibration_pass(oe, ece, g), F.lit("calibration")),
        F.when(~stability_pass(ratio, g), F.lit("stability")),
    ))
    pillars = F.when(~power, F.lit("insufficient_power")).otherwise(F.array_join(failed, ";"))
    return F.when(~power, "INCONCLUSIVE").when(F.size(failed) > 0, "WEAK").otherwise("GOOD"), pillars


def is_important(volume_share: Column, default_share: Column, g: Gates) -> Column:
    return _sure(volume_share >= g.importance_share_floor) | _sure(default_share >= g.importance_share_floor)


def has_pillar(pillars: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(pillars, F.lit("")), ";"), name)


def ar_artifact_suspected(pillars: Column, triggered: Column, ratio: Column, gini: Column, g: Gates) -> Column:
    """A weak rank order that is gone at a matched approval rate."""
    return has_pillar(pillars, "rank_order") & _sure(triggered) & F.when(ratio.isNotNull(), ratio >= g.gini_ratio_floor).otherwise(_sure(gini >= g.gini_floor))


def refit_clears(delta: Column, delta_low: Column, brier_refit: Column, brier: Column, loss_refit: Column, loss: Column, g: Gates) -> Column:
    return _sure(delta >= g.min_delta_gini) & _sure(delta_low > 0) & (_sure(brier_refit < brier) | _sure(loss_refit < loss))


def q2_action(q1, pillars, important, divergent, delta, delta_low, brier_refit, brier, loss_refit, loss, g: Gates, stable=None, stability_reason=None) -> tuple[Column, Column]:
    """Action and reason for a segment."""
    stable = F.lit(True) if stable is None else F.coalesce(stable, F.lit(True))
    why = F.lit("") if stability_reason is None else F.coalesce(stability_reason, F.lit(""))
    rank_bad, calibration_bad = has_pillar(pillars, "rank_order"), has_pillar(pillars, "calibration")
    clears = refit_clears(delta, delta_low, brier_refit, brier, loss_refit, loss, g) & _sure(divergent)
    unstable = ~stable if g.refit_requires_stability else F.lit(False)
    information = F.lit("need_new_information_not_new_coefficients")
    steps = [
        (q1 == "INCONCLUSIVE", "NONE", F.lit("insufficient_power")),
        (~rank_bad & calibration_bad, "RECALIBRATE", F.lit("rank_order_ok_calibration_fail")),
        (q1 == "GOOD", "KEEP_POOLED", F.lit("performance_good")),
        (~rank_bad & ~_sure(divergent), "KEEP_POOLED", F.lit("no_split_trigger")),
        (~_sure(important), "KEEP_POOLED", F.lit("not_important_enough")),
        (delta.isNull(), "KEEP_POOLED", information),
        (clears & unstable, "MONITOR", F.concat_ws(":", F.lit("refit_predictors_unstable"), F.nullif(why, F.lit("")))),
        (clears, "SPLIT", F.lit("holdout_delta_gini_and_shape")),
        (rank_bad, "KEEP_POOLED", information),
    ]
    action, reason = F.lit("KEEP_POOLED"), F.lit("split_gates_failed")
    for test, name, text in reversed(steps):
        action, reason = F.when(test, name).otherwise(action), F.when(test, text).otherwise(reason)
    return action, reason


def q2_portfolio_action(q1, pillars, delta, delta_low, brier_refit, brier, loss_refit, loss, g: Gates, stable=None, stability_reason=None, whatif: bool = False) -> tuple[Column, Column]:
    """Action and reason for the whole book: never a split; only a what-if may ask for a refit."""
    stable = F.lit(True) if stable is None else F.coalesce(stable, F.lit(True))
    why = F.lit("") if stability_reason is None else F.coalesce(stability_reason, F.lit(""))
    rank_bad, calibration_bad = has_pillar(pillars, "rank_order"), has_pillar(pillars, "calibration")
    clears = refit_clears(delta, delta_low, brier_refit, brier, loss_refit, loss, g) & F.lit(whatif)
    unstable = ~stable if g.refit_requires_stability else F.lit(False)
    steps = [
        (q1 == "INCONCLUSIVE", "NONE", F.lit("insufficient_power")),
        (clears & unstable, "MONITOR", F.concat_ws(":", F.lit("refit_predictors_unstable"), F.nullif(why, F.lit("")))),
        (clears, "REFIT", F.lit("holdout_delta_gini_portfolio")),
        (~rank_bad & calibration_bad, "RECALIBRATE", F.lit("rank_order_ok_calibration_fail")),
        (q1 == "GOOD", "KEEP_POOLED", F.lit("performance_good")),
    ]
    action, reason = F.lit("KEEP_POOLED"), F.lit("need_new_information_not_new_coefficients")
    for test, name, text in reversed(steps):
        action, reason = F.when(test, name).otherwise(action), F.when(test, text).otherwise(reason)
    return action, reason
