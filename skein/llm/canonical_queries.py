"""Typed operators of the samples and training rows, mapped to the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.llm.canonical import map_values
from skein.plans.spread import spread
from skein.sources.tables import table


def _typed(spark, d):
    samples = table(spark, d, "hindsight_samples").select(F.lit("hindsight").alias("field"), F.col("sample_id").alias("row_id"), F.col("innovation.operator").alias("typed"))
    rows = table(spark, d, "dz_rows")
    target = rows.select(F.lit("dz_target").alias("field"), F.col("dz_id").alias("row_id"), F.col("target_z.operator").alias("typed"))
    closed = rows.select(F.lit("dz_closed").alias("field"), F.col("dz_id").alias("row_id"), F.col("operator_closed").alias("typed"))
    typed = samples.unionByName(target).unionByName(closed).filter(F.col("typed").isNotNull())
    return spread(typed, "field", "row_id").dropDuplicates(["field", "row_id"])


def _mapped(spark, d):
    inventory = table(spark, d, "operator_inventory")
    return map_values(_typed(spark, d), "typed", inventory, "op_id", [F.array("op_id", "op_name"), F.coalesce("aliases", F.array().cast("array<string>"))])


def p1_found(spark, d):
    mapped = _mapped(spark, d)
    return mapped.filter(F.col("op_id").isNotNull() & (F.col("op_id") != F.col("typed"))).select("field", "row_id", "op_id")


def p1_report(spark, d):
    """Per field and entry: how many rows mean it, exactly or freely typed; unmatched values under their own name."""
    mapped = _mapped(spark, d).filter(F.col("op_id").isNotNull())
    return mapped.groupBy("field", "op_id").agg(F.count("*").alias("rows"), F.count_if(F.col("op_id") != F.col("typed")).alias("freely_typed"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL: dict[str, str] = {}
