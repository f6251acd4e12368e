"""Running sums and places within groups, without a group ever being in one task.

A window over a group gathers the group; a topic or a source can be a third of all rows. Here the rows are cut into ranges along group and
order; each range is summed by itself and starts from the sums of its group's ranges before it, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.cut import cut


def running(df: DataFrame, group: list[str], order: list[str | Column], weight: Column, before: str, total: str | None = None) -> DataFrame:
    """``df`` with the sum of the weights of its group's earlier rows and, if named, of all of the group's rows.

    The order should tell all rows of a group apart; equal rows come in any order, and together in one range.
    """
    at = [F.col(o) if isinstance(o, str) else o for o in order]
    # written once: ranges come from a sample and must not be drawn again
    ranged = cut(df.withColumn("_w", weight).repartitionByRange(*group, *at).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part", *group).agg(F.sum("_w").alias("_s"))
    past = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.coalesce(F.sum("_s").over(past), F.lit(0)).alias("_start"), F.sum("_s").over(Window.partitionBy(*group)).alias("_total"))
    within = F.sum("_w").over(Window.partitionBy("_part", *group).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1))
    j = ranged.withColumn("_within", F.coalesce(within, F.lit(0))).join(starts, [F.col("_part") == F.col("_p"), *(F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group))])
    out = j.withColumn(before, F.col("_start") + F.col("_within"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_w", "_part", "_p", "_start", "_total", "_within", *(f"_g{i}" for i in range(len(group))))


def places(df: DataFrame, group: list[str], order: list[str | Column], place: str, total: str | None = None) -> DataFrame:
    """``df`` with each row's place in its group from 1 and, if named, the number of the group's rows."""
    return running(df, group, order, F.lit(1), place, total).withColumn(place, F.col(place) + 1)
