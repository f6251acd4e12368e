"""Documents packed into containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.llm.pack import pack_texts
from skein.plans.cut import cut
from skein.sources.tables import table

CAPACITY = 2048


def p7_containers(spark, d):
    """One row per piece of a document, with the container it is in."""
    return pack_texts(table(spark, d, "documents"), "doc_id", "text", CAPACITY)


def p7_fill(spark, d):
    """One row: documents, tokens, containers, the share of all room that is filled, and the median number of places along the curve that
    the documents of a container span."""
    pieces = cut(p7_containers(spark, d))
    used = pieces.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count_if(F.col("piece") == 0).alias("begun"), (F.max("position") - F.min("position") + 1).alias("span"))
    return used.agg(
        F.sum("begun").alias("documents"), F.sum("used").alias("tokens"), F.count("*").alias("containers"), F.max("used").alias("most_used"), F.round(F.sum("used") / (F.count("*") * CAPACITY), 4).alias("filled"),
        F.percentile_approx(F.when(F.col("span") > 1, F.col("span")), 0.5).alias("median_span"),
    )


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
