"""Numeric and vector scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; missing places count as 0."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1; 0 if a norm is 0."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.when(norm > 0, norm)).otherwise(0.0)


def clamped_cosine(a: Column, b: Column) -> Column:
    """Cosine with negative values raised to 0."""
    return clamp(cosine(a, b))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def exact_mean(x: Column, digits: int = 4) -> Column:
    """Aggregate: the mean of values of so many decimals, none below 0, rounded half up to as many; summed as integers, so that no order of
    summation shows."""
    total, n = F.sum(F.round(x * 10**digits).cast("bigint")), F.count(x)
    return F.when(n > 0, F.floor((2 * total + n) / F.when(n > 0, 2 * n)) / 10**digits)


def squared_distance(a: Column, b: Column) -> Column:
    diffs = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d * d)


def popularity_weight(score: Column, floor: float = 0.1) -> Column:
    return F.lit(floor) + (1 - floor) * F.coalesce(score, F.lit(0.0))


def leaderboard_score(hit: Column, mrr: Column) -> Column:
    """0.7 hit rate + 0.3 reciprocal rank, each of 4 decimals, rounded half up to 4."""
    return F.floor((14 * F.round(hit * 10_000) + 6 * F.round(mrr * 10_000) + 10) / 20) / 10_000


def joint_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of scores; a missing score counts as 0, weights that sum to 0 give 0."""
    total = sum(w for _, w in parts)
    return sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0)) / total if total > 0 else F.lit(0.0)


def judged_match(problem: Column, method: Column, specificity: Column) -> Column:
    """Problem and method together at least 5 and specificity at least 2."""
    return (problem + method >= 5) & (specificity >= 2)


def strict_match(problem: Column, method: Column, specificity: Column) -> Column:
    return (problem + method >= 5) & (specificity >= 3)


def soft_score(problem: Column, method: Column, specificity: Column) -> Column:
    return (problem + method + specificity) / 9


def recency(months: Column, rate: float = 0.9) -> Column:
    return F.pow(F.lit(rate), F.greatest(months, F.lit(0)))


def specificity(title: Column, rationale: Column, approach: Column, weights: tuple[float, float, float] = (0.2, 0.4, 0.4), full: int = 80) -> Column:
    """A title at all, and the lengths of rationale and approach up to ``full`` characters, by weight."""
    def length(c: Column) -> Column:
        return F.least(F.lit(1.0), F.length(F.trim(F.coalesce(c, F.lit("")))) / full)

    has = F.when(F.trim(F.coalesce(title, F.lit(""))) != "", 1.0).otherwise(0.0)
    wt, wr, wa = weights
    return F.round(clamp((has * wt + length(rationale) * wr + length(approach) * wa) / sum(weights)), 4)
