"""Strategies, embedders, judges and rewards by name, as functions over DataFrames and columns.

A strategy takes the corpus (topic_id, published, title), windows (topic_id, cut) and k, and gives predictions: topic_id, cut, rank, title,
rationale, approach, key_terms. An embedder and a judge take columns and give a column; a reward takes a table and gives it with the
column reward. Models that run elsewhere come in as strategies, embedders or judges that look up a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import lexical

Strategy = Callable[[DataFrame, DataFrame, int], DataFrame]
Embedder = Callable[[Column], Column]
Judge = Callable[[Column, Column], Column]
Reward = Callable[[DataFrame], DataFrame]


def term_pairs(corpus: DataFrame, windows: DataFrame, k: int, months: int = 6, terms: int = 10) -> DataFrame:
    """Predictions out of the most frequent title words of the window's last months, in pairs. A paper goes to the months whose windows can see
    it, and meets them by month."""
    seen = corpus.filter("published is not null").withColumn("m", F.explode(F.sequence(D.month_index(F.col("published")), D.month_index(F.col("published")) + months - 1)))
    met = windows.withColumn("m", D.month_index(F.col("cut"))).join(seen, ["topic_id", "m"]).filter("published <= cut")
    words = met.select("topic_id", "cut", F.explode(T.tokens(F.col("title"))).alias("t")).filter((F.length("t") >= 4) & ~F.col("t").isin(*T.TERM_STOP_WORDS))
    counted = words.groupBy("topic_id", "cut", "t").agg(F.count("*").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("topic_id", "cut").orderBy(F.desc("n"), "t"))).filter(F.col("r") <= terms)
    lists = top.groupBy("topic_id", "cut").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("w"))
    n = F.size("w")
    each = lists.select("topic_id", "cut", "w", F.explode(F.sequence(F.lit(0), F.lit(2 * k - 1))).alias("i"))
    pairs = each.select("topic_id", "cut", "i", F.get("w", F.col("i") % n).alias("a"), F.get("w", (F.col("i") * 3 + 1) % n).alias("b")).filter("a <> b").dropDuplicates(["topic_id", "cut", "a", "b"])
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id", "cut").orderBy("i"))).filter(F.col("rank") <= k)
    return ranked.select(
        "topic_id", "cut", "rank", F.concat_ws(" ", "a", F.lit("meets"), "b").alias("title"), F.concat(F.lit("Recent papers name "), "a", F.lit(" and "), "b", F.lit(" often.")).alias("rationale"),
        F.concat(F.lit("Compare "), "a", F.lit(" with and without "), "b", F.lit(".")).alias("approach"), F.array("a", "b").alias("key_terms"),
    )


def latest_titles(corpus: DataFrame, windows: DataFrame, k: int, months: int = 6) -> DataFrame:
    """Predictions that repeat the titles of the window's latest papers: the baseline that knows only the past."""
    seen = corpus.filter("published is not null").withColumn("m", F.explode(F.sequence(D.month_index(F.col("published")), D.month_index(F.col("published")) + months - 1)))
    met = windows.withColumn("m", D.month_index(F.col("cut"))).join(seen, ["topic_id", "m"]).filter("published <= cut")
    r = met.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id", "cut").orderBy(F.desc("published"), "paper_id"))).filter(F.col("rank") <= k)
    return r.select("topic_id", "cut", "rank", "title", F.lit("").alias("rationale"), F.lit("").alias("approach"), F.array().cast("array<string>").alias("key_terms"))


def static(table: DataFrame) -> Strategy:
    """The strategy that looks its predictions up in a table of the same columns."""
    return lambda corpus, windows, k: table.join(windows, ["topic_id", "cut"], "left_semi").filter(F.col("rank") <= k)


STRATEGIES: dict[str, Strategy] = {"term_pairs": term_pairs, "latest_titles": latest_titles}
EMBEDDERS: dict[str, Embedder] = {"hashed": lexical.hashed_embedding}
JUDGES: dict[str, Judge] = {"overlap": lambda idea, paper: T.overlap(T.token_set(idea), T.token_set(paper))}


def named(kind: str, registry: dict, name: str):
    if name not in registry:
        raise ValueError(f"no {kind} {name!r}: one of {sorted(registry)}")
    return registry[name]


def generate(name: str, corpus: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    return named("strategy", STRATEGIES, name)(corpus, windows, k).withColumn("strategy", F.lit(name))


def judge_reply(name: str, idea: Column, paper: Column) -> Column:
    """The reply of a judge that answers by rule, in the form of a model's: its score has four decimals."""
    return F.concat(F.lit("Score: "), F.format_number(V.clamp(named("judge", JUDGES, name)(idea, paper)), 4), F.lit("\nReasoning: by rule"))


def make_reward(parts: dict[str, float], invalid: Column | None = None, invalid_reward: float = -0.05) -> Reward:
    """A reward: the weighted mean of the columns, or the reward of invalid rows."""

    def reward(df: DataFrame) -> DataFrame:
        value = F.round(V.clamp(V.joint_score([(F.when(~F.isnan(c), F.col(c)), w) for c, w in parts.items()])), 4)
        return df.withColumn("reward", value if invalid is None else F.when(invalid, invalid_reward).otherwise(value))

    return reward


def chained(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Steps one after another as one: the plan is built whole before anything runs."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run
