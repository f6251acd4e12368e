"""Abusive language in documents: scores, and rates per source."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.llm.abuse import score
from skein.sources.tables import table


def _scored(spark, d, keep=()):
    labels = table(spark, d, "doc_labels").select(F.col("doc_id").alias("id"), F.col("abusive").alias("label"))
    return score(table(spark, d, "documents"), labels, "doc_id", "text", "lang", list(keep))


def p8_found(spark, d):
    return _scored(spark, d).filter("abusive").select("doc_id")


def p8_scores(spark, d):
    return _scored(spark, d)


def p8_rates(spark, d):
    """Per source: documents, abusive ones, their share, and the mean score."""
    return _scored(spark, d, ["source"]).groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("abusive").alias("abusive_n"), F.round(F.avg(F.col("abusive").cast("double")), 4).alias("rate"), F.round(F.avg("score"), 4).alias("mean_score")
    )


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
