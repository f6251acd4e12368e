"""Writers. All go through Spark's commit protocol, so a reader never sees a part of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X


def markdown(paper_id: Column, title: Column, date: Column, keywords: Column, url: Column, abstract: Column, refs: Column) -> Column:
    """A paper as Markdown: title, preamble, abstract, numbered references."""
    numbered = F.array_join(F.transform(refs, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r)), "\n")
    lines = [
        F.concat(F.lit("# "), title), F.lit(""), F.concat(F.lit("Paper ID: "), paper_id), F.concat(F.lit("Date: "), date.cast("string")),
        F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", "))), F.concat(F.lit("Source URL: "), url), F.lit(""),
        F.when(abstract.isNotNull(), F.concat(F.lit("# Abstract\n"), abstract, F.lit("\n"))), F.when(F.size(refs) > 0, F.concat(F.lit("# References\n"), numbered)),
    ]
    return F.concat_ws("\n", *lines)


def write_markdown(papers: DataFrame, path: str) -> None:
    """papers: month, text (as ``markdown`` gives it); one folder a month, many papers a file, parted by form feeds, as ``markdown_pages`` reads them."""
    papers.select("month", F.translate("text", "\f", " ").alias("value")).write.mode("overwrite").partitionBy("month").option("lineSep", "\f").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_corpus(df: DataFrame, path: str) -> None:
    """A corpus table partitioned by month; ``df`` has the column month. Rows are clustered by month first, so a month is few files."""
    df.repartition("month").write.mode("overwrite").partitionBy("month").parquet(path)


def write_index(df: DataFrame, path: str) -> None:
    df.repartition("kind", "cutoff").write.mode("overwrite").partitionBy("kind", "cutoff").parquet(path)


def write_memory(df: DataFrame, path: str) -> None:
    """Memory snapshots of all cutoffs in one table."""
    df.write.mode("overwrite").partitionBy("cutoff").parquet(path)


def training_rows(df: DataFrame, source: str, prompt: Column, truth: Column, extra: list[str]) -> DataFrame:
    """data_source, prompt, ground_truth, extra_info (JSON of the named columns)."""
    return df.select(F.lit(source).alias("data_source"), prompt.alias("prompt"), truth.alias("ground_truth"), F.to_json(F.struct(*extra)).alias("extra_info"))


def write_training_rows(rows: DataFrame, path: str, preview: str, lines: int = 20) -> None:
    rows.write.mode("overwrite").parquet(path)
    rows.limit(lines).write.mode("overwrite").json(preview)


def write_scored_pairs(df: DataFrame, path: str) -> None:
    """CSV with previews of at most 160 characters on one line."""
    cut = [X.shortened(F.regexp_replace(c, r"\s+", " "), 160).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*cut).write.mode("overwrite").csv(path, header=True)


def _by_cutoff(a: Column, b: Column) -> Column:
    return F.when(a["cutoff_date"] < b["cutoff_date"], -1).when(a["cutoff_date"] > b["cutoff_date"], 1).otherwise(0)


def artifact(windows: DataFrame, header: dict[str, str]) -> DataFrame:
    """Windows (topic_id, cutoff_date, evaluation map) nested per topic, a row a topic, under the run's header."""
    nested = windows.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("cutoff_date", "evaluation")), _by_cutoff).alias("windows"))
    return nested.select(*(F.lit(v).alias(k) for k, v in header.items()), "topic_id", "windows")


def batch_requests(targets: DataFrame, done: DataFrame, prompt: Column) -> DataFrame:
    """Lines of requests under topic|episode|paper (at most 64 characters), without those already done."""
    cid = F.substring(F.concat_ws("|", "topic_id", "episode_id", "paper_id"), 1, 64)
    todo = targets.withColumn("custom_id", cid).join(done.select("custom_id").distinct(), "custom_id", "left_anti")
    return todo.select("custom_id", F.to_json(F.struct(F.col("custom_id"), F.lit("POST").alias("method"), F.struct(prompt.alias("prompt")).alias("body"))).alias("value"))
