"""Episodes, grids, samples and checks of training and evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.dates import month_index, month_of_index
from skein.operators.mapping import small
from skein.operators.running import places, running


def calendar_windows(bounds: DataFrame, length: int, step: int) -> DataFrame:
    """bounds: one row of first and last month index. Windows of ``length`` months every ``step`` months; the last are cut at the end."""
    starts = bounds.select(F.posexplode(F.sequence("first", "last", F.lit(step))).alias("index", "s"), "last")
    end = F.least(F.col("s") + length - 1, F.col("last"))
    return starts.select("index", month_of_index(F.col("s")).alias("start_month"), month_of_index(end).alias("end_month"))


def episodes(papers: DataFrame, date: str, past: int, horizon: int, step: int) -> DataFrame:
    """Cutoff months (as indices) every ``step`` months, with the papers of the ``past`` months before and of ``horizon`` months from each."""
    months = papers.filter(F.col(date).isNotNull()).groupBy(month_index(F.col(date)).alias("m")).agg(F.count("*").alias("n"))
    bounds = months.agg(F.min("m").alias("f"), F.max("m").alias("l"))
    cuts = bounds.filter(F.col("f") + past <= F.col("l") - horizon).select(F.explode(F.sequence(F.col("f") + past, F.col("l") - horizon, F.lit(step))).alias("cutoff"))
    grid = cuts.select("cutoff", F.explode(F.sequence(F.col("cutoff") - past, F.col("cutoff") + horizon - 1)).alias("m")).join(months, "m", "left")
    return grid.groupBy("cutoff").agg(F.coalesce(F.sum(F.when(F.col("m") < F.col("cutoff"), F.col("n"))), F.lit(0)).alias("train_n"), F.coalesce(F.sum(F.when(F.col("m") >= F.col("cutoff"), F.col("n"))), F.lit(0)).alias("future_n"))


def grid(topics: DataFrame, cuts: DataFrame, papers: DataFrame, horizon: int) -> DataFrame:
    """topics x cuts (episode, cutoff), each with its numbers of train and future papers. Papers are reduced to days per topic first."""
    days = papers.filter("published is not null").groupBy("topic_id", "published").agg(F.count("*").alias("n"))
    end = F.last_day(F.add_months("cutoff", horizon))
    cells = topics.crossJoin(small(cuts)).join(days, "topic_id", "left")
    return cells.groupBy("topic_id", "episode").agg(
        F.coalesce(F.sum(F.when(F.col("published") <= F.col("cutoff"), F.col("n"))), F.lit(0)).alias("train_n"), F.coalesce(F.sum(F.when((F.col("published") > F.col("cutoff")) & (F.col("published") <= end), F.col("n"))), F.lit(0)).alias("future_n")
    )


def round_robin(df: DataFrame, group: list[str], key: str, limit: int) -> DataFrame:
    """The first rows of all groups, then the second ones, and so on, up to ``limit``."""
    r = df.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(key)) - 1)
    return r.orderBy("position", *group).limit(limit)


def label_pairs(df: DataFrame, group: str, key: str, idea: str, candidate: str) -> DataFrame:
    """Each row's idea with its own candidate (label 1), and with that of the next row of its group, in order of the key (label 0)."""
    r = places(df, [group], [key], "r", "n")
    own = r.select(group, key, F.lit(1).alias("label"), idea, candidate)
    other = r.select(F.col(group).alias("_g"), F.col("r").alias("_r"), F.col(candidate).alias("_c"))
    wrong = r.filter("n > 1").join(other, (F.col(group) == F.col("_g")) & (F.col("_r") == F.col("r") % F.col("n") + 1))
    return own.unionByName(wrong.select(group, key, F.lit(0).alias("label"), idea, F.col("_c").alias(candidate)))


def sampling_plan(spark: SparkSession, temperatures: list[float], top_ps: list[float], n: int) -> DataFrame:
    """n parameter settings in cycles: temperatures turn fastest."""
    i = F.col("id").cast("int")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    return spark.range(n).select(i.alias("i"), pick(temperatures, i).alias("temperature"), pick(top_ps, F.floor(i / len(temperatures))).alias("top_p"))


def last_rows(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group, in order."""
    w = Window.partitionBy(*group)
    kept = df.withColumn("_r", F.row_number().over(w.orderBy(*(F.desc(o) for o in order)))).filter(F.col("_r") <= n)
    return kept.withColumn("position", F.row_number().over(w.orderBy(F.desc("_r")))).drop("_r")


def aligned(values: Column, i: Column, n: Column) -> Column:
    """The value for place i of n: the list repeats each value n / its length times; a list of one holds for all, null if n isn't a multiple."""
    return F.when(n % F.size(values) == 0, F.get(values, F.floor(i / (n / F.size(values))).cast("int")))


def counts_asof(df: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """Each row with the number of rows of its group that come strictly earlier: sums over the group's distinct orders."""
    per = df.groupBy(*group, order).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    sums = per.select(*(F.col(c).alias(f"_{c}") for c in [*group, order]), F.coalesce(before, F.lit(0)).alias("earlier"))
    return df.join(sums, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, order]]).select(key, *group, order, "earlier")


def violations(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Per rule the number of rows that break it, and of all rows; one pass."""
    sums = df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(name) for name, c in rules))
    return sums.select("total", F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name, _ in rules))).alias("r")).select("r.rule", "r.n", "total")


def group_invariant(df: DataFrame, parts: list[str], order: str, size: int, same: list[str]) -> DataFrame:
    """Consecutive groups of ``size`` rows of each part: how many, how many agree in the columns, how many are short."""
    g = running(df, parts, [order], F.lit(1), "g").withColumn("g", F.floor(F.col("g") / size))
    per = g.groupBy(*parts, "g").agg(F.count("*").alias("n"), F.count_distinct(*same).alias("d"))
    return per.groupBy(*parts).agg(F.count("*").alias("groups"), F.count_if(F.col("d") == 1).alias("uniform"), F.count_if(F.col("n") < size).alias("short"))


def fill_up(first: DataFrame, retry: DataFrame, group: list[str], title: str, order: list[str], k: int) -> DataFrame:
    """Rows of the first table, then of the retry, once per title key of a group, until k a group."""
    both = first.withColumn("_part", F.lit(0)).unionByName(retry.withColumn("_part", F.lit(1))).withColumn("_key", T.title_key(F.col(title)))
    one = both.withColumn("_d", F.row_number().over(Window.partitionBy(*group, "_key").orderBy("_part", *order))).filter(F.col("_d") == 1)
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("_part", *order))).filter(F.col("place") <= k).drop("_part", "_key", "_d")
