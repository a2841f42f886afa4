"""Scores of findings as columns."""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column


@dataclass(frozen=True)
class Gates:
    """Weights and thresholds of a decision."""

    validity: float = 0.4
    novelty: float = 0.30
    tau: float = 0.55
    effect_floor: float = 0.03
    refine: float = 0.45
    strong_validity: float = 0.70
    w_validity: float = 0.5
    w_novelty: float = 0.4
    w_interpretability: float = 0.1


def p_score(p: Column) -> Column:
    """Piecewise in p; it jumps at 0.05 and at 0.1."""
    return (
        F.when(p < 0.001, 1.0)
        .when(p < 0.01, 1.0 - (p - 0.001) / 0.009 * 0.05)
        .when(p < 0.05, 0.95 - (p - 0.01) / 0.04 * 0.10)
        .when(p < 0.1, 0.75 - (p - 0.05) / 0.05 * 0.10)
        .otherwise(0.75 * F.exp(-3 * (p - 0.1)))
    )


def effect_score(effect: Column) -> Column:
    return 1 / (1 + F.exp(-8 * (F.abs(effect) - 0.12)))


def validity(p: Column, effect: Column, n: Column, head: Column | None = None, severity: Column | None = None) -> Column:
    """Strength of evidence in 0..1: p counts less the more rows there are."""
    w = 0.3 + 0.5 / (1 + F.pow(n / 1000.0, 1.5))
    v = w * p_score(p) + (1 - w) * effect_score(effect)
    if head is not None:
        v = F.when(head.isin("interact", "heterogeneity") & (n > 1000) & (F.abs(effect) < 0.03), F.least(v, F.lit(0.5))).otherwise(v)
    v = F.when(p >= 0.05, F.least(v, F.lit(0.3))).otherwise(v)
    if severity is not None:
        v = v * F.when(severity == "review", 0.95).when(severity == "material", 0.8).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def after_replication(v: Column, status: Column) -> Column:
    return F.when(status == "not_replicated", v * 0.8).otherwise(v)


def flags(p: Column, effect: Column, n: Column, coverage: Column, v: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Names of what a reader should know about a result."""
    e = F.abs(effect)
    rules = [
        ("very_high_p_value", p > 0.1), ("high_p_value", (p > 0.05) & (p <= 0.1)), ("very_low_p_value", p < 0.001),
        ("very_small_effect_size", e < 0.05), ("small_effect_size", (e >= 0.05) & (e < 0.1)), ("very_large_effect_size", e > 1),
        ("extremely_small_sample_size", n < 10), ("very_small_sample_size", (n >= 10) & (n < 30)), ("small_sample_for_small_effect", (e < 0.1) & (n < 100)), ("moderate_sample_size", (n >= 30) & (n < 100)),
        ("very_low_coverage", coverage < 0.01), ("low_coverage", (coverage >= 0.01) & (coverage < 0.05)),
        ("very_low_validity", v < 0.3), ("low_validity", (v >= 0.3) & (v < 0.5)), ("possible_low_power", (p > 0.05) & (p <= 0.1) & (n < 100)),
    ]
    if lo is not None and hi is not None:
        width = hi - lo
        outside = (effect < lo - 0.1 * width) | (effect > hi + 0.1 * width)
        rules += [("invalid_confidence_interval", outside | (width > 2)), ("wide_confidence_interval", (width > 1) & (width <= 2))]
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules)))


def guarded_effect(effect: Column) -> Column:
    """Effects that can't be: beyond 10 in size they count as 5; NaN and infinite ones as none."""
    e = F.when(~F.isnan(effect) & (F.abs(effect) != float("inf")), effect)
    return F.when(F.abs(e) > 10, F.signum(e) * 5).otherwise(e)


def novelty_step(similarity: Column) -> Column:
    """By the similarity (0..1) of the nearest earlier finding; null if there is none."""
    return F.when(similarity.isNull(), 0.9).when(similarity >= 0.85, 0.2).when(similarity >= 0.7, 0.6).otherwise(0.75)


def novelty(structural: Column, embedding: Column, surprise: Column, tautology: Column, derivative: Column) -> Column:
    blend = 0.25 * structural + 0.25 * embedding + 0.5 * surprise
    return F.when(tautology, 0.0).when(derivative, F.least(blend, F.lit(0.4))).otherwise(blend)


def interpretability(cross: Column, controlled: Column, deep: Column) -> Column:
    return 0.5 + F.when(cross, 0.2).otherwise(0.0) + F.when(controlled, 0.15).otherwise(0.0) + F.when(deep, 0.15).otherwise(0.0)


def overall(v: Column, nov: Column, inter: Column, g: Gates = Gates()) -> Column:
    return g.w_validity * v + g.w_novelty * nov + g.w_interpretability * inter


def decide(v: Column, nov: Column, total: Column, effect: Column, g: Gates = Gates()) -> Column:
    refine = total >= g.refine
    return (
        F.when(v < g.validity, F.when(refine, "refine").otherwise("reject"))
        .when(nov < g.novelty, F.when((v >= g.strong_validity) & refine, "refine").otherwise("reject"))
        .when(total >= g.tau, F.when(F.abs(effect) >= g.effect_floor, "accept").otherwise("refine"))
        .when(refine, "refine")
        .otherwise("reject")
    )


def ranking(nov: Column, v: Column) -> Column:
    return nov * F.least(F.lit(1.0), v / 0.6)


def quality(total: Column, v: Column, anchor: Column) -> Column:
    """Order of context: anchors first, then the better findings."""
    return 0.7 * F.when(anchor, 1.0).otherwise(0.5) + 0.3 * (0.6 * F.coalesce(total, F.lit(0.0)) + 0.4 * F.coalesce(v, F.lit(0.0)))
