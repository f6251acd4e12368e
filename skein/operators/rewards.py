"""Rewards of proposals: gates, adherence, coherence, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V

#: Fixed weights of evidence quality, adherence and coherence.
REWARD_WEIGHTS = (0.4, 0.3, 0.3)
INVALID_REWARD = -0.05


def adherence(text: Column, keywords: Column, operator: Column) -> Column:
    """The share of the operator's keywords that the text holds; without keywords 1 if it holds the operator's own name, else 0."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.size(F.coalesce(keywords, F.array().cast("array<string>")))
    hits = F.size(F.filter(keywords, lambda k: low.contains(k)))
    return F.round(F.when(n > 0, hits / F.when(n > 0, n)).otherwise(F.when(low.contains(F.lower(F.trim(operator))), 1.0).otherwise(0.0)), 4)


def coherence(text: Column, innovation: Column, technical: list[str], full: int = 200) -> Column:
    """0.4 length up to ``full`` characters + 0.3 technical words up to five + 0.3 overlap with the innovation's words; 0 for a blank text."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = T.token_set(t)
    vocabulary = F.least(F.lit(1.0), F.size(F.array_intersect(words, F.array(*map(F.lit, technical)))) / max(1, min(5, len(technical))))
    score = 0.4 * F.least(F.lit(1.0), F.length(t) / full) + 0.3 * vocabulary + 0.3 * T.overlap(words, T.token_set(F.coalesce(innovation, F.lit(""))))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.round(V.clamp(score), 4))


def combined(evidence: Column, adherence_: Column, coherence_: Column, weights: tuple[float, float, float] = REWARD_WEIGHTS, digits: int = 4) -> Column:
    e, a, c = weights
    parts = [F.coalesce(x, F.lit(0.0)) * w for x, w in ((evidence, e), (adherence_, a), (coherence_, c))]
    return F.round(V.clamp((parts[0] + parts[1] + parts[2]) / sum(weights)), digits)


def gates(text: Column, known: Column, operator: Column, closed: Column, least_chars: int = 40, digits: int = 6) -> Column:
    """The first gate that a text fails: format (too short), grounding (cites what isn't known), operator (not of the closed list); null if none."""
    cited = T.citations(text, digits)
    ungrounded = F.size(F.array_except(cited, F.coalesce(known, F.array().cast("array<string>")))) > 0
    return (
        F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < least_chars, "format")
        .when(ungrounded, "grounding")
        .when(~F.coalesce(F.array_contains(closed, operator), F.lit(False)), "operator")
    )


def gated_reward(reward: Column, gate: Column) -> Column:
    return F.when(gate.isNull(), F.coalesce(reward, F.lit(0.0))).otherwise(INVALID_REWARD)


def proposal_as_prediction(proposal: Column, gap: Column, most: int = 500) -> Column:
    """A proposal's first line as title, the gap as rationale, and gap and body, cut, as approach."""
    title = F.trim(F.regexp_replace(F.split_part(F.trim(proposal), F.lit("\n"), F.lit(1)), r"^#+\s*", ""))
    body = F.trim(F.regexp_replace(proposal, r"^[^\n]*\n?", ""))
    return F.struct(title.alias("title"), gap.alias("rationale"), F.substring(F.concat_ws(" ", gap, F.when(body != "", body)), 1, most).alias("approach"))


def triple_of(prediction: Column) -> Column:
    """The triple that a prediction stands for: its title, the operator "extend", and its rationale up to the first full stop."""
    return F.struct(prediction["title"].alias("base_direction"), F.lit("extend").alias("operator"), F.split_part(prediction["rationale"], F.lit("."), F.lit(1)).alias("gap"))


def rendered_references(refs: Column, most: int) -> Column:
    """The first references, numbered, one a line."""
    return F.array_join(F.transform(F.slice(F.coalesce(refs, F.array().cast("array<string>")), 1, most), lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r)), "\n")


def alignment(df: DataFrame, prompt: str, reward: str, measures: list[str]) -> DataFrame:
    """Per prompt the candidate of the best reward, averaged: prompts, mean reward, mean measures, shares of invalid and zero rewards."""
    best = df.groupBy(prompt).agg(F.max_by(F.struct(reward, *measures), F.struct(F.coalesce(reward, F.lit(float("-inf"))), *measures)).alias("b"), F.count_if(F.col(reward).isNull()).alias("_bad"), F.count_if(F.col(reward) == 0).alias("_zero"), F.count("*").alias("_n"))
    means = [F.round(F.avg(f"b.{m}"), 4).alias(m) for m in (reward, *measures)]
    return best.agg(F.count("*").alias("prompts"), *means, F.round(F.sum("_bad") / F.sum("_n"), 4).alias("invalid"), F.round(F.sum("_zero") / F.sum("_n"), 4).alias("zero"))
