"""Token ids of all documents, and the round trip through them."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.llm.encode import decode, encode
from skein.sources.tables import table


def p6_ids(spark, d):
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark, d):
    """Per source: documents, tokens, bytes, and texts that decoding doesn't give back byte by byte (none)."""
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    ids = p6_ids(spark, d)
    back = decode(ids, "doc_id", "ids").select("doc_id", F.col("text").alias("back"))
    sizes = ids.select("doc_id", F.size("ids").alias("tokens"))
    both = documents.join(back, "doc_id").join(sizes, "doc_id")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return both.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.octet_length(raw)).alias("bytes"), F.count_if(raw != F.col("back")).alias("differing"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip}
SQL: dict[str, str] = {}
