"""Spreading rows for steps whose cost is computing, not bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def tasks(df: DataFrame) -> int:
    """Three tasks a core, and no fewer than the session's shuffle partitions: adaptive merging by bytes would leave such steps too few."""
    spark = df.sparkSession
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by the keys into that many tasks."""
    return df.repartition(tasks(df), *keys)
