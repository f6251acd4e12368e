"""Rolling windows over a dated corpus: cutoffs, train and future splits, per-window evaluation and roll-ups.

A corpus has the columns topic, paper_id, published (date) and score. Rows with a null date belong to no window. The
train side of a cutoff is everything published up to and including it; the future side is everything after it up to the end
of the month ``horizon`` months later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.dates import month_index


def _dated(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.col("published").isNotNull()).withColumn("m", month_index(F.col("published")))


def first_of(index: Column) -> Column:
    return F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1))


def cutoffs(corpus: DataFrame, horizon: int) -> DataFrame:
    """The months that have papers and at least ``horizon`` months after them, as m and the first day, cutoff."""
    months = _dated(corpus).groupBy("m").agg(F.lit(1).alias("one"))  # a few hundred rows however large the corpus
    last = months.agg(F.max("m").alias("last"))
    return months.join(F.broadcast(last), F.col("m") <= F.col("last") - horizon).select("m", first_of(F.col("m")).alias("cutoff"))


def _daily(corpus: DataFrame) -> DataFrame:
    """One row per topic and month, first days apart: all that the counts of any cutoff need."""
    first = F.dayofmonth("published") == 1
    return _dated(corpus).groupBy("topic", "m").agg(
        F.count("*").alias("n"), F.sum("score").alias("s"), F.count_if(first).alias("n1"), F.sum(F.when(first, F.col("score"))).alias("s1")
    )


def kept_windows(corpus: DataFrame, horizon: int, min_train: int) -> DataFrame:
    """Windows with enough train rows and some future: running sums over months, never papers times cutoffs."""
    months = _daily(corpus)
    grid = cutoffs(corpus, horizon).crossJoin(months.select("topic").distinct())  # months x topics
    cells = grid.join(months, ["topic", "m"], "full_outer").fillna(0, ["n", "s", "n1", "s1"])
    past = Window.partitionBy("topic").orderBy("m").rangeBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("topic").orderBy("m").rangeBetween(Window.currentRow, horizon)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = cells.withColumns({
        "train_n": zero(F.sum("n").over(past)) + F.col("n1"),
        "train_sum": zero(F.sum("s").over(past)) + F.col("s1"),
        "future_n": F.sum("n").over(ahead) - F.col("n1"),
    })
    return out.filter((F.col("cutoff").isNotNull()) & (F.col("train_n") >= min_train) & (F.col("future_n") > 0)).select("topic", "cutoff", "m", "train_n", "train_sum", "future_n")


def split_counts(corpus: DataFrame, horizon: int, min_train: int) -> DataFrame:
    return kept_windows(corpus, horizon, min_train).select("topic", "cutoff", "train_n", "future_n")


def future_pairs(corpus: DataFrame, windows: DataFrame, horizon: int) -> DataFrame:
    """Papers with every window whose future holds them: each paper goes to horizon + 1 months, then an equi-join."""
    papers = _dated(corpus).withColumn("w", F.explode(F.sequence(F.col("m") - horizon, F.col("m"))))
    w = windows.withColumnRenamed("m", "w")
    return papers.join(w, ["topic", "w"]).filter(F.col("published") > F.col("cutoff")).drop("w", "m")
