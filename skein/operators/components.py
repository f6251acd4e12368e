"""Connected components of an edge table, by rounds of joins that never gather a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.cut import cut


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: a, b (no nulls; loops and repeats do no harm). Columns node, component: the smallest node that it is connected with.

    Alternates two steps, each one join or aggregation and one cut: every node's larger neighbours are hung on its smallest
    neighbour, then its smaller neighbours are. The edges end as stars around the smallest nodes, after
    about log(n) squared rounds at most. Hub nodes are reduced to minima before the shuffle.
    """
    now = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).distinct()
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
        large = cut(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
        now = cut(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
