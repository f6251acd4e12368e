"""The N highest-scoring distinct items of every group, however large a group is.

1. One pass takes the number of rows and the range of the scores, another the groups' numbers of rows.
2. Only groups of more than ``rows / MAX_THRESHOLDS`` rows can burden a task; there can be no more than MAX_THRESHOLDS of them, which
   bounds what is broadcast. Per such group and score bin (``bins`` equal steps of the range) a 64-bit mask is kept with one bit set per hashed id. The masks
   merge by OR before and after the shuffle, and the number of bits set never exceeds the number of distinct ids, so it is a
   safe count under repeated rows. The highest bin at and above which a group surely has N distinct items is its threshold.
3. Rows below the threshold of their group are dropped. Copies of an item (equal in group, id and score) merge by a hash of all three, before
   and after a shuffle, so that no number of them meets in a task. The rest are ranked exactly by descending score and ascending id; the
   rank limit is applied before the shuffle as well as after it, so a group's task never gets more than N items per map task.

Cases: a row whose score is null or NaN, or whose id is null, is no item. Infinite scores rank as such. A null group key is a
group of its own. Rows equal in group, id and score are one item; an id with two scores is two. Groups smaller than N come out
whole, an empty table gives an empty result, and columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_THRESHOLDS = 20_000


def thresholds(items: DataFrame, keys: list[str], n: int, low: float, high: float, least_rows: int, bins: int = 1024) -> DataFrame:
    """Per group of at least ``least_rows`` rows: the bin at or above which it surely has n distinct items."""
    large = items.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") >= least_rows).select(*(F.col(k).alias(f"large_{k}") for k in keys))
    of_large = items.join(F.broadcast(large), [F.col(k).eqNullSafe(F.col(f"large_{k}")) for k in keys])
    at = _bin(low, high, bins)
    masks = of_large.groupBy(*keys, at.alias("bin")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(xxhash64(id), 64) as int)))").alias("mask"))
    sure = Window.partitionBy(*keys).orderBy(F.desc("bin"))
    counted = masks.withColumn("sure", F.sum(F.bit_count("mask")).over(sure))
    return counted.filter(F.col("sure") >= n).groupBy(*keys).agg(F.max("bin").alias("from_bin"))


def _bin(low: float, high: float, bins: int):
    step = (high - low) / bins or 1.0
    return F.when(F.col("score") >= high, bins).when(F.col("score") <= low, 0).otherwise(F.floor((F.col("score") - low) / step)).cast("int")


def top_n(df: DataFrame, keys: list[str], item: str, score: str, n: int, bins: int = 1024) -> DataFrame:
    """Columns: the keys, the item's id, the score, and place from 1 to n."""
    items = df.select(*(F.col(k).alias(f"key{i}") for i, k in enumerate(keys)), F.col(item).alias("id"), F.col(score).cast("double").alias("score"))
    items = items.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("id").isNotNull())
    by = [f"key{i}" for i in range(len(keys))]
    finite = F.when(F.abs("score") < float("inf"), F.col("score"))
    rows, low, high = items.agg(F.count("*"), F.min(finite), F.max(finite)).first()
    if rows and low is not None:
        least = max(8 * n, rows // MAX_THRESHOLDS + 1)
        limits = thresholds(items, by, n, low, high, least, bins).select(*(F.col(k).alias(f"limit_{k}") for k in by), "from_bin")
        same = [F.col(k).eqNullSafe(F.col(f"limit_{k}")) for k in by]
        items = items.join(F.broadcast(limits), same, "left").filter(F.col("from_bin").isNull() | (_bin(low, high, bins) >= F.col("from_bin"))).select(*by, "id", "score")
    one = items.dropDuplicates()
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    ranked = one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return ranked.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col("id").alias(item), F.col("score").alias(score), F.col("place").cast("long").alias("place"))
