"""Backtests: ranked predictions of rolling windows, matched one to one with the papers that came after, and the metrics of the matches.

A window is a strategy, a topic and a cutoff (date). Its train side are the topic's papers published up to the cutoff, its future side those
after it up to the end of the month ``horizon`` months later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import exact_mean, judged_match, leaderboard_score
from skein.operators import folds

METRICS = ("hit_at_k", "coverage_at_k", "precision_at_k", "mrr", "lead_time", "duplicate_rate")


def future_end(cut: Column, horizon: int) -> Column:
    return F.last_day(F.add_months(F.trunc(cut, "month"), horizon))


def side_counts(papers: DataFrame, windows: DataFrame, horizon: int) -> DataFrame:
    """papers: topic_id, published; windows: topic_id, cut. Per distinct window train_n and future_n.

    Papers are counted per topic and day first; running sums over those days answer both ends of every window, so no paper meets a window.
    """
    days = papers.filter("published is not null").groupBy("topic_id", F.col("published").alias("day")).agg(F.count("*").alias("n"))
    asked = windows.select("topic_id", "cut").distinct()
    none = F.lit(0).cast("bigint")
    points = days.withColumn("cut", F.lit(None).cast("date")).unionByName(asked.select("topic_id", F.col("cut").alias("day"), none.alias("n"), "cut"))
    points = points.unionByName(asked.select("topic_id", future_end(F.col("cut"), horizon).alias("day"), none.alias("n"), "cut"))
    upto = Window.partitionBy("topic_id").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = points.withColumn("upto", F.sum("n").over(upto)).filter("cut is not null").groupBy("topic_id", "cut").agg(F.min("upto").alias("train_n"), F.max("upto").alias("_all"))
    return sums.select("topic_id", "cut", "train_n", (F.col("_all") - F.col("train_n")).alias("future_n"))


def evaluate(predictions: DataFrame, candidates: DataFrame, sides: DataFrame, k: int, horizon: int, min_train: int) -> DataFrame:
    """predictions: strategy_id, topic_id, cut, rank (1 to n); candidates: those, paper, score, published: the matching future papers.
    sides: as ``side_counts`` gives them. The metrics of each window with enough train papers and some future.

    In order of rank each prediction takes its best free paper; one whose matching papers are all taken is a blocked duplicate.
    """
    window = ["strategy_id", "topic_id", "cut"]
    taken = folds.greedy_match(candidates, window, k)
    dates = candidates.select("topic_id", "paper", "published").distinct()
    hits = taken.join(dates, ["topic_id", "paper"]).select(*window, "rank", F.datediff("published", "cut").alias("_days"), F.lit(1).alias("_hit"))
    able = candidates.filter(F.col("rank") <= k).select(*window, "rank").distinct().withColumn("_able", F.lit(1))
    each = predictions.filter(F.col("rank") <= k).select(*window, "rank").join(able, [*window, "rank"], "left").join(hits, [*window, "rank"], "left")
    n, matched = F.count("*"), F.count("_hit")
    per = each.groupBy(*window).agg(n.alias("n"), matched.alias("matched"), F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("_first"), F.sum("_days").alias("_days"), F.count_if(F.col("_able").isNotNull() & F.col("_hit").isNull()).alias("_blocked"))
    j = per.join(sides.filter((F.col("train_n") >= min_train) & (F.col("future_n") > 0)), ["topic_id", "cut"])
    span = F.datediff(future_end(F.col("cut"), horizon), "cut")
    return j.select(
        *window, "train_n", "future_n", "matched", (F.col("matched") > 0).cast("double").alias("hit_at_k"), F.round(F.col("matched") / F.col("future_n"), 4).alias("coverage_at_k"),
        F.round(F.col("matched") / F.least(F.lit(k), "n"), 4).alias("precision_at_k"), F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.coalesce(F.col("_days") / (F.col("matched") * span), F.lit(0.0)), 4).alias("lead_time"), F.round(F.col("_blocked") / F.col("n"), 4).alias("duplicate_rate"),
    )


def per_topic(evaluated: DataFrame, total: str = "ALL") -> DataFrame:
    """Means over the windows of each topic, and of all topics weighted by their windows."""
    topics = evaluated.groupBy(F.col("topic_id").alias("topic")).agg(F.count("*").alias("windows"), *(exact_mean(F.col(m)).alias(m) for m in METRICS))

    def weighted(m: str) -> Column:
        w = F.sum("windows")
        return F.floor((2 * F.sum(F.round(F.col(m) * 10_000).cast("bigint") * F.col("windows")) + w) / (2 * w)) / 10_000

    everything = topics.agg(F.lit(total).alias("topic"), F.sum("windows").alias("windows"), *(weighted(m).alias(m) for m in METRICS))
    return topics.unionByName(everything.filter("windows is not null"))


def by_record(evaluated: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per strategy and topic that it predicted: windows, hit rate, reciprocal rank and score; one without any window has an error instead."""
    per = evaluated.groupBy("strategy_id", "topic_id").agg(F.count("*").alias("windows"), exact_mean(F.col("hit_at_k")).alias("hit"), exact_mean(F.col("mrr")).alias("mrr"))
    j = predicted.select("strategy_id", "topic_id").distinct().join(per, ["strategy_id", "topic_id"], "left").fillna(0, ["windows"])
    return j.withColumns({"score": leaderboard_score(F.col("hit"), F.col("mrr")), "error": F.when(F.col("windows") == 0, "no window with train and future papers")})


def judged_evaluation(predictions: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """predictions: strategy_id, topic_id, cut, rank; judged: those, paper, score (order of retrieval), problem, method, specificity (0 to 3, null
    where the reply could not be read). Per window: precision over k, reciprocal rank of the first match, mean soft score of the
    matches, judgements made and their share that failed. Each prediction takes its first match that is still free."""
    window = ["strategy_id", "topic_id", "cut"]
    grades = ["problem", "method", "specificity"]
    matching = judged.filter(F.coalesce(judged_match(*(F.col(g) for g in grades)), F.lit(False)))
    taken = folds.greedy_match(matching, window, k).select(*window, "rank", "paper")
    soft = taken.join(matching.select(*window, "rank", "paper", (F.col("problem") + F.col("method") + F.col("specificity")).alias("_points")), [*window, "rank", "paper"])
    hits = soft.groupBy(*window).agg(F.count("*").alias("matched"), F.min("rank").alias("_first"), F.sum("_points").alias("_points"))
    calls = judged.groupBy(*window).agg(F.count("*").alias("judge_calls"), F.count_if(F.greatest(*(F.col(g).isNull() for g in grades))).alias("_failed"))
    all_windows = predictions.select(*window).distinct()
    j = all_windows.join(hits, window, "left").join(calls, window, "left").fillna(0, ["matched", "judge_calls", "_failed"])
    return j.select(
        *window, "matched", "judge_calls", (F.col("matched") > 0).cast("double").alias("hit_at_k"), F.round(F.col("matched") / k, 4).alias("precision_at_k"), F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.coalesce(F.col("_points") / (9 * F.col("matched")), F.lit(0.0)), 4).alias("soft_score"), F.round(F.when(F.col("judge_calls") > 0, F.col("_failed") / F.col("judge_calls")).otherwise(0.0), 4).alias("failed_share"),
    )


def reranked(predictions: DataFrame, window: list[str], order: list[Column], k: int) -> DataFrame:
    """Predictions given as a table: those of each window numbered anew from 1 in order, at most k."""
    return predictions.withColumn("rank", F.row_number().over(Window.partitionBy(*window).orderBy(*order))).filter(F.col("rank") <= k)


def delayed_feedback(proposals: DataFrame, taken: DataFrame, window: list[str]) -> DataFrame:
    """One event per proposal: the paper that its rank took in the window, with its score, or none with score 0."""
    return proposals.join(taken.select(*window, "rank", "paper", "score"), [*window, "rank"], "left").withColumns({"matched": F.col("paper").isNotNull(), "score": F.coalesce("score", F.lit(0.0))})
