"""Mapping values through a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension that may be broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has no more than so many rows, which is counted first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def exact_map(df: DataFrame, value: str, names: DataFrame, name: str, target: str, default: str) -> DataFrame:
    """``df`` with the column mapped: the target whose name equals the value, trimmed and in lower case; else the default.

    A name of several targets means the least of them. Null and blank values map to the default.
    """
    keys = names.groupBy(F.lower(F.trim(name)).alias("_name")).agg(F.min(target).alias("_target"))
    joined = df.join(small(keys), F.lower(F.trim(value)) == F.col("_name"), "left")
    return joined.withColumn("mapped", F.coalesce("_target", F.lit(default))).drop("_name", "_target")
