"""Rank statistics, distances between distributions and grouped measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators.running import running
from skein.plans.cut import cut
from skein.plans.spread import spread


def average_ranks(df: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
    """``df`` with ranks from 1 in which equal values share their mean rank.

    Counts per distinct value are ranked, so a value shared by many rows costs one row; a group's values need not fit one task.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    ranks = running(counts, group, [value], F.col("_n"), "_below").withColumn(name, F.col("_below") + (F.col("_n") + 1) / 2).drop("_n", "_below")
    return df.join(ranks.withColumnsRenamed({c: f"_{c}" for c in [*group, value]}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, value]]).drop(*(f"_{c}" for c in [*group, value]))


def auc(df: DataFrame, value: str, label: str, group: list[str]) -> DataFrame:
    """Area under the ROC curve per group; 0.5 if a class is empty. Rows without value or label are left out."""
    r = average_ranks(df.filter(F.col(value).isNotNull() & F.col(label).isNotNull()), value, group, "r")
    p, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    u = F.sum(F.when(F.col(label) == 1, F.col("r"))) - p * (p + 1) / 2
    return r.groupBy(*group).agg(p.alias("positives"), n.alias("negatives"), F.round(F.when((p > 0) & (n > 0), u / F.when((p > 0) & (n > 0), p * n)).otherwise(0.5), 6).alias("auc"))


def mann_whitney(df: DataFrame, value: str, first: Column, group: list[str]) -> DataFrame:
    """U of the rows of the first sample against the others, and the one-sided p-value by the normal approximation, corrected for
    ties and continuity; null p if a sample is empty or all values are equal."""
    rows = df.filter(F.col(value).isNotNull()).withColumn("first", first)
    r = average_ranks(rows, value, group, "r")
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("t"))
    ties = counts.groupBy(*group).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    m, n = F.count_if("first"), F.count_if(~F.col("first"))
    u = r.groupBy(*group).agg(m.alias("m"), n.alias("n"), (F.coalesce(F.sum(F.when(F.col("first"), F.col("r"))), F.lit(0.0)) - m * (m + 1) / 2).alias("u")).join(ties, group) if group else r.agg(m.alias("m"), n.alias("n"), (F.coalesce(F.sum(F.when(F.col("first"), F.col("r"))), F.lit(0.0)) - m * (m + 1) / 2).alias("u")).crossJoin(ties)
    size = F.col("m") + F.col("n")
    variance = F.col("m") * F.col("n") / 12 * (size + 1 - F.col("ties") / F.when(size > 1, size * (size - 1)))
    z = (F.col("u") - F.col("m") * F.col("n") / 2 - 0.5) / F.sqrt(F.when(variance > 0, variance))
    return u.select(*group, "m", "n", F.round("u", 4).alias("u"), F.round(z, 6).alias("z"), F.round(1 - normal_cdf(z), 6).alias("p"))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution by the Abramowitz-Stegun polynomial 26.2.17, within 7.5e-8."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def spearman(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """Correlation of average ranks per group, 0 where it isn't defined."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_ranks(average_ranks(rows, x, group, "rx"), y, group, "ry")
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    c = F.covar_pop("rx", "ry") / F.when(spread > 1e-12, spread)
    return r.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.coalesce(c, F.lit(0.0)), 4).alias("rho"))


def group_advantage(df: DataFrame, group: list[str], reward: str) -> DataFrame:
    """Reward less the group's mean, over the group's population deviation (1 if that is 0)."""
    per = df.groupBy(*(F.col(g).alias(f"_{g}") for g in group)).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_sd"))
    j = df.join(per, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    advantage = (F.col(reward) - F.col("_mean")) / F.when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(1.0)
    return j.withColumn("advantage", F.round(advantage, 6)).drop("_mean", "_sd", *(f"_{g}" for g in group))


def min_max(df: DataFrame, value: str, name: str) -> DataFrame:
    """Values scaled to 0..1 over the table; a constant column gives 1, null stays null. Two rows of bounds are broadcast."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    return df.join(F.broadcast(bounds)).withColumn(name, F.when(F.col(value).isNotNull(), F.round(scaled, 6))).drop("_lo", "_hi")


def wasserstein(df: DataFrame, value: str, second: Column, steps: int = 1024) -> DataFrame:
    """One row: the distance between the distributions of two samples, by the area between their distribution functions. Rows without a
    value are left out.

    Distinct values are cut into ``steps`` equal ranges; each range is summed by itself and starts from the sums of those before it, so
    only the table of ranges is ever in one task.
    """
    rows = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(~second).alias("a"), F.count_if(second).alias("b"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    wide = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    ranged = rows.join(F.broadcast(ends)).withColumn("r", F.coalesce(F.floor((F.col("v") - F.col("lo")) / wide * steps), F.lit(0))).drop("lo", "hi")
    per = ranged.groupBy("r").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"), F.min("v").alias("first"))
    order, before = Window.orderBy("r"), Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("r", F.coalesce(F.sum("ra").over(before), F.lit(0)).alias("pa"), F.coalesce(F.sum("rb").over(before), F.lit(0)).alias("pb"), F.lead("first").over(order).alias("next"), F.sum("ra").over(Window.partitionBy()).alias("na"), F.sum("rb").over(Window.partitionBy()).alias("nb"))
    w = Window.partitionBy("r").orderBy("v")
    j = ranged.join(F.broadcast(per), "r")
    width = F.coalesce(F.lead("v").over(w), F.col("next")) - F.col("v")
    area = F.abs((F.col("pa") + F.sum("a").over(w)) / F.col("na") - (F.col("pb") + F.sum("b").over(w)) / F.col("nb")) * width
    return j.select(area.alias("area")).agg(F.round(F.sum("area"), 6).alias("distance"))


def mmd(df: DataFrame, vector: str, second: Column, key: str) -> DataFrame:
    """One row: unbiased squared maximum mean discrepancy of two samples of vectors under a Gaussian kernel, and its bandwidth: half the
    median of all squared distances, those to itself included. It needs all pairs, which meet as pairs of blocks of about 250 vectors; the
    distances are cut once."""
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), second.alias("s"))
    n = max(1, -(-rows.count() // 250))
    side = rows.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))
    blocks = F.sequence(F.lit(0), F.lit(n - 1))
    left = spread(side.select("*", F.explode(blocks).alias("other")), "block", "other")
    right = spread(side.withColumnRenamed("block", "other").select("*", F.explode(blocks).alias("block")), "block", "other")

    def distances(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = np.zeros((len(a), len(b)))
        for x, y in zip(np.stack(a.v.to_numpy()).astype(np.float64).T, np.stack(b.v.to_numpy()).astype(np.float64).T):
            d += (x[:, None] - y[None, :]) ** 2
        x, y = np.repeat(a.s.to_numpy(dtype=bool), len(b)), np.tile(b.s.to_numpy(dtype=bool), len(a))
        off = np.repeat(a.k.to_numpy(), len(b)) != np.tile(b.k.to_numpy(), len(a))
        return pd.DataFrame({"x": x, "y": y, "off": off, "d": d.ravel()})

    usable = "v is not null and s is not null"
    pairs = cut(left.filter(usable).groupBy("block", "other").cogroup(right.filter(usable).groupBy("block", "other")).applyInPandas(distances, "x boolean, y boolean, off boolean, d double"))
    bandwidth = pairs.agg((F.percentile("d", 0.5) / 2).alias("h"))
    kernel = F.exp(-F.col("d") / F.col("h") / 2)
    x, y, xy = (~F.col("x") & ~F.col("y") & F.col("off")), (F.col("x") & F.col("y") & F.col("off")), (F.col("x") != F.col("y"))
    mean = lambda c: F.avg(F.when(c, kernel))
    return pairs.join(F.broadcast(bandwidth)).agg(F.round(mean(x) + mean(y) - 2 * mean(xy), 6).alias("mmd"), F.round(F.max("h"), 6).alias("bandwidth"))


def impact_buckets(df: DataFrame, count: Column, value: Column) -> DataFrame:
    """Means of a value where a count is below 5, below 50, or more; rows without a count are "all"."""
    bucket = F.when(count.isNull(), "all").when(count < 5, "low").when(count < 50, "mid").otherwise("high")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def thirds(fraction: Column) -> Column:
    """early, mid or late third of a fraction; null stays null."""
    return F.when(fraction < 1 / 3, "early").when(fraction < 2 / 3, "mid").when(fraction.isNotNull(), "late")


def validation_report(df: DataFrame, group: list[str], score: str, label: str, least_auc: float = 0.75) -> DataFrame:
    """Per group: medians and maxima by label, AUC, negatives at or above the positives' median, and whether all is well."""
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    med = rows.groupBy(*group).agg(
        F.median(F.when(F.col(label) == 1, F.col(score))).alias("positive_median"), F.median(F.when(F.col(label) == 0, F.col(score))).alias("negative_median"), F.max(F.when(F.col(label) == 0, F.col(score))).alias("negative_max")
    )
    leaks = rows.join(med, group).groupBy(*group).agg(F.count_if((F.col(label) == 0) & (F.col(score) >= F.col("positive_median"))).alias("leaks"))
    both = auc(rows, score, label, group).join(med, group).join(leaks, group)
    return both.withColumn("passed", (F.col("auc") >= least_auc) & (F.col("leaks") == 0))
