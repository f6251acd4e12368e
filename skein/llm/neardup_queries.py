"""Predictions that say nearly the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.llm.neardup import NearDuplicates
from skein.sources.tables import table

LEAST = 0.7
FIELDS = ["title", "rationale", "approach"]


def _near(spark, d):
    return NearDuplicates(table(spark, d, "idea_predictions"), "pred_id", FIELDS, LEAST)


def p3_found(spark, d):
    return _near(spark, d).pairs().select(F.col("a").alias("pred_a"), F.col("b").alias("pred_b"))


def p3_groups(spark, d):
    """One row per prediction: its group and its number of links."""
    return _near(spark, d).groups().select(F.col("id").alias("pred_id"), F.col("group").alias("group_id"), "links")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
SQL = {
    "p3_found": f"""with w as (select distinct pred_id id, list_distinct(regexp_extract_all(lower(concat_ws(' ', title, rationale, approach)), '[a-z0-9]+')) w from idea_predictions),
  worded as (select id, any_value(w) w from w where len(w) > 0 group by id),
  pairs as (select a.id pred_a, b.id pred_b, len(list_intersect(a.w, b.w)) c, len(a.w) la, len(b.w) lb from worded a join worded b on a.id < b.id
   and least(len(a.w), len(b.w)) >= {LEAST} * greatest(len(a.w), len(b.w)))
  select pred_a, pred_b from pairs where c / (la + lb - c) >= {LEAST}"""
}
