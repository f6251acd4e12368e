"""Aggregations of terms, keyword clusters, memories, coverage and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators.components import components
from skein.operators.running import places, running
from skein.plans.cut import cut


def top_terms(docs: DataFrame, text: Column, limit: int, least_chars: int = 4, stop: tuple[str, ...] = T.TERM_STOP_WORDS) -> DataFrame:
    """The most frequent tokens: term, n; by count, then term."""
    terms = docs.select(F.explode(T.tokens(text)).alias("term")).filter((F.length("term") >= least_chars) & ~F.col("term").isin(*stop))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(limit)


def document_keywords(docs: DataFrame, key: str, keywords: str) -> DataFrame:
    """Columns key, kw: the distinct trimmed lower-case keywords of more than two characters of each document."""
    return docs.select(key, F.explode(keywords).alias("raw")).select(key, F.trim(F.lower("raw")).alias("kw")).filter(F.length("kw") > 2).distinct()


def frequent_pairs(kw: DataFrame, key: str, least: int) -> DataFrame:
    """Columns a, b, n: keywords, a < b, that stand together in at least ``least`` documents; only keywords as frequent can."""
    often = kw.groupBy("kw").agg(F.count("*").alias("f")).filter(F.col("f") >= least)
    kept = kw.join(often, "kw").select(key, "kw")
    a, b = kept.withColumnRenamed("kw", "a"), kept.withColumnRenamed("kw", "b")
    return a.join(b, key).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def cluster_members(kw: DataFrame, key: str, least: int) -> DataFrame:
    """Columns kw, f, cluster: keywords of at least ``least`` documents, and the least keyword of those they are joined with through frequent pairs."""
    often = kw.groupBy("kw").agg(F.count("*").alias("f")).filter(F.col("f") >= least)
    found = components(frequent_pairs(kw, key, least).select("a", "b"))
    return often.join(found.select(F.col("node").alias("kw"), "component"), "kw", "left").select("kw", "f", F.coalesce("component", "kw").alias("cluster"))


def keyword_clusters(kw: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """Columns cluster (its least keyword), keywords, total: keywords joined through frequent pairs; the ``most`` of greatest total frequency.

    Only the clusters reported list their keywords.
    """
    member = cut(cluster_members(kw, key, least))
    top = member.groupBy("cluster").agg(F.sum("f").alias("total")).orderBy(F.desc("total"), "cluster").limit(most)
    lists = member.join(F.broadcast(top), "cluster").groupBy("cluster", "total").agg(F.sort_array(F.collect_list(F.struct((-F.col("f")).alias("f"), "kw"))).alias("m"))
    return lists.select("cluster", F.array_join(F.transform("m", lambda x: x["kw"]), "|").alias("keywords"), "total").orderBy(F.desc("total"), "cluster")


def cluster_momentum(kw_docs: DataFrame, members: DataFrame, key: str, months: Column, last: int, recent_months: int) -> DataFrame:
    """members: kw, cluster. Per cluster: documents, recent ones, and 2 * recent + recent - max(1, total div months)."""
    hits = kw_docs.join(members, "kw").select("cluster", key, months.alias("m")).distinct()
    counted = hits.groupBy("cluster").agg(F.count("*").alias("total"), F.count_if(F.col("m").between(last - recent_months + 1, last)).alias("recent"))
    expected = F.greatest(F.lit(1), F.floor(F.col("total") / max(1, recent_months)))
    return counted.withColumn("momentum", (F.col("recent") * 2 + F.col("recent") - expected).cast("double"))


def build_memory(samples: DataFrame, last: int) -> DataFrame:
    """samples: z (struct of three strings), source, m (month index), ord (struct to order by). One row per triple: frequency, first
    source and month in order, and recency 0.9 ** months since."""
    grouped = samples.groupBy("z").agg(F.count("*").alias("frequency"), F.min_by(F.struct("source", "m"), "ord").alias("first"))
    return grouped.select("z.*", "frequency", F.col("first.source").alias("source"), F.col("first.m").alias("m"), V.recency(F.lit(last) - F.col("first.m")).alias("recency"))


def top_memory(memory: DataFrame, n: int, weights: tuple[float, float, float] = (0.45, 0.35, 0.20)) -> DataFrame:
    """The n entries of the greatest blend of recency, frequency over the greatest frequency, and tanh of utility."""
    most = memory.agg(F.greatest(F.max("frequency"), F.lit(1)).alias("_most"))
    r, f, u = weights
    blend = (r * V.clamp(F.col("recency")) + f * F.col("frequency") / F.col("_most") + u * V.clamp(F.tanh(F.col("utility")))) / sum(weights)
    return memory.join(F.broadcast(most)).withColumn("blend", F.round(blend, 9)).drop("_most").orderBy(F.desc("blend"), *memory.columns[:3]).limit(n)


def bucket_memory(papers: DataFrame, bucket: Column, date: str, key: str, title: str, cutoff: Column, window_months: int, limit: int) -> DataFrame:
    """Per bucket up to the cutoff: papers, recent papers, and the latest one's title; by recent, total, name."""
    days = int(window_months * 30.44)
    rows = papers.filter(F.col(date) <= cutoff).withColumn("bucket", bucket).filter("bucket is not null")
    grouped = rows.groupBy("bucket").agg(F.count("*").alias("total"), F.count_if(F.datediff(cutoff, F.col(date)) <= days).alias("recent"), F.max_by(title, F.struct(date, key)).alias("latest"))
    return grouped.orderBy(F.desc("recent"), F.desc("total"), "bucket").limit(limit)


def gated_coverage(pairs: DataFrame, group: list[str], cluster: str, similarity: str, least: float) -> DataFrame:
    """Mean over clusters of their greatest similarity, where that is at least ``least``, else 0."""
    best = pairs.groupBy(*group, cluster).agg(F.max(similarity).alias("best"))
    return best.groupBy(*group).agg(F.count("*").alias("clusters"), F.round(F.avg(F.when(F.col("best") >= least, F.col("best")).otherwise(0.0)), 5).alias("coverage"))


def novelty(items: DataFrame, key: str, similar: DataFrame, similarity: str) -> DataFrame:
    """One less the greatest similarity of each item; 1 for an item that is compared with nothing."""
    best = similar.groupBy(key).agg(F.max(similarity).alias("_s"))
    return items.select(key).join(best, key, "left").select(key, F.round(F.coalesce(1 - F.greatest(F.col("_s"), F.lit(0.0)), F.lit(1.0)), 5).alias("novelty"))


def weighted_rollup(df: DataFrame, group: list[str], weight: str, metrics: list[str]) -> DataFrame:
    """Means weighted by ``weight``; a missing metric counts as 0, NaN makes the mean NaN, no weight gives 0."""
    w = F.sum(weight)
    return df.groupBy(*group).agg(w.alias(weight), *(F.round(F.when(w > 0, F.sum(F.coalesce(F.col(m), F.lit(0.0)) * F.col(weight)) / F.when(w > 0, w)).otherwise(0.0), 4).alias(m) for m in metrics))


def coverage_audit(df: DataFrame, topic: str, cutoff: str) -> DataFrame:
    """One row: rows, distinct topics and windows, and rows that repeat a window."""
    windows = df.groupBy(topic, cutoff).agg(F.count("*").alias("n"))
    return windows.agg(F.sum("n").alias("rows"), F.count_distinct(topic).alias("topics"), F.count("*").alias("windows"), F.sum(F.col("n") - 1).alias("repeated"))


def status_rollup(df: DataFrame, group: list[str], status: Column) -> DataFrame:
    """running if any row is, else failed if any is, else completed if all are, else pending."""
    s = df.withColumn("_s", status)
    out = F.when(F.bool_or(F.col("_s") == "running"), "running").when(F.bool_or(F.col("_s") == "failed"), "failed").when(F.bool_and(F.col("_s") == "completed"), "completed").otherwise("pending")
    return s.groupBy(*group).agg(F.count("*").alias("n"), out.alias("status"))


def midpoint_sample(df: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """Of each group's rows in order those at places int((slot + 0.5) / limit * n) for slots 0 to limit - 1; all rows of a group of no more."""
    r = running(df, group, order, F.lit(1), "_i", "_n")
    # slot s picks i if int((s + 0.5) / limit * n) = i: some s with (i * limit / n) - 0.5 <= s < ((i + 1) * limit / n) - 0.5
    low, high = F.ceil(F.col("_i") * limit / F.col("_n") - 0.5), F.ceil((F.col("_i") + 1) * limit / F.col("_n") - 0.5)
    return r.filter((F.col("_n") <= limit) | ((low < high) & (high > 0) & (low < limit))).drop("_i", "_n")


def quantile_groups(df: DataFrame, group: list[str], value: str, key: str, share: float, least: int) -> DataFrame:
    """top and bottom rows of each group by value: int(n * share) of either, at least ``least``, never more than half."""
    r = places(df, group, [F.desc(value), key], "_i", "_n")
    end = F.least(F.greatest(F.floor(F.col("_n") * share), F.lit(least)), F.floor(F.col("_n") / 2))
    side = F.when(F.col("_i") <= end, "top").when(F.col("_i") > F.col("_n") - end, "bottom")
    return r.withColumn("side", side).filter("side is not null").drop("_i", "_n")


def split_labels(df: DataFrame, order: list[str], train: float, validation: float, name: str = "split") -> DataFrame:
    """train, validation, test by place in the order: the first int(n * train) rows, then int(n * validation)."""
    r = places(df, [], order, "_i", "_n")
    i, n = F.col("_i"), F.col("_n")
    return r.withColumn(name, F.when(i <= F.floor(n * train), "train").when(i <= F.floor(n * train) + F.floor(n * validation), "validation").otherwise("test")).drop("_i", "_n")
