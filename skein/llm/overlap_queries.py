"""Evaluation samples that also stand among the training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.llm.overlap import overlaps
from skein.sources.tables import table

LAST_CUTOFF, LEAST, LEAST_WORDS = "2024-03-31", 0.75, 8


def _evaluation(spark, d):
    samples = table(spark, d, "hindsight_samples").filter(F.col("split").isin("validation", "test"))
    return samples.select(F.col("sample_id").alias("eval_id"), F.col("future_paper_id").alias("paper"), F.col("innovation.gap").alias("passage"), "split", "source")


def _training(spark, d):
    """Rows whose cutoff, a month standing for its first day, is no later than the last training day."""
    cutoff = F.trim("cutoff_t")
    day = F.when(cutoff.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(cutoff, F.lit("-01"))).otherwise(cutoff)
    rows = table(spark, d, "dz_rows").filter(F.try_to_date(day, "yyyy-MM-dd") <= F.lit(LAST_CUTOFF).cast("date"))
    return rows.select(F.col("dz_id").alias("train_id"), F.col("source_future_id").alias("paper"), F.col("target_z.gap").alias("passage"))


def p5_found(spark, d):
    found = overlaps(_evaluation(spark, d), _training(spark, d), LEAST, LEAST_WORDS)
    return found.select(F.col("eval_id").alias("sample_id"), F.col("train_id").alias("dz_id"))


def p5_report(spark, d):
    """Per split and source: evaluation samples, those found among the training rows by paper, by passage, and at all."""
    samples = _evaluation(spark, d).dropDuplicates(["eval_id"])
    found = overlaps(_evaluation(spark, d), _training(spark, d), LEAST, LEAST_WORDS)
    per = found.groupBy("eval_id").agg(F.bool_or("same_paper").alias("by_paper"), F.max("coverage").isNotNull().alias("by_passage"), F.count("*").alias("pairs"))
    joined = samples.select("eval_id", "split", "source").join(per, "eval_id", "left")
    return joined.groupBy("split", "source").agg(
        F.count("*").alias("samples"), F.count_if("by_paper").alias("by_paper"), F.count_if("by_passage").alias("by_passage"), F.count("pairs").alias("found"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")
    )


_PAIRS = f"""e as (select distinct on (sample_id) sample_id, split, source, regexp_replace(regexp_extract(future_paper_id, '(?:^|[^0-9])([0-9]{{4}}[._/ -]?[0-9]{{8}})(?:[^0-9]|$)', 1), '[^0-9]', '', 'g') p,
  list_distinct(regexp_extract_all(lower(innovation.gap), '[a-z0-9]+')) w from hindsight_samples where split in ('validation', 'test')),
 t as (select distinct on (dz_id) dz_id, regexp_replace(regexp_extract(source_future_id, '(?:^|[^0-9])([0-9]{{4}}[._/ -]?[0-9]{{8}})(?:[^0-9]|$)', 1), '[^0-9]', '', 'g') p,
  list_distinct(regexp_extract_all(lower(target_z.gap), '[a-z0-9]+')) w from dz_rows
  where try_cast(case when len(trim(cutoff_t)) = 7 then trim(cutoff_t) || '-01' else trim(cutoff_t) end as date) <= date '{LAST_CUTOFF}'),
 same as (select sample_id, dz_id from e join t on e.p = t.p and len(e.p) = 12),
 alike as (select sample_id, dz_id from (select *, len(list_intersect(e.w, t.w)) c, len(e.w) le, len(t.w) lt from e join t on len(e.w) >= {LEAST_WORDS} and len(t.w) >= {LEAST_WORDS}) where c / (le + lt - c) >= {LEAST})"""
QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": f"with {_PAIRS} select * from same union select * from alike",
    "p5_report": f"""with {_PAIRS}, found as (select * from same union select * from alike)
 select split, source, count(*) samples, count(*) filter (where sample_id in (select sample_id from same)) by_paper, count(*) filter (where sample_id in (select sample_id from alike)) by_passage,
 count(*) filter (where sample_id in (select sample_id from found)) found, coalesce(sum((select count(*) from found f where f.sample_id = e.sample_id)), 0)::bigint pairs from e group by split, source""",
}
