"""Incremental runs with Structured Streaming: every call takes what is new since its checkpoint and ends.

The checkpoint folder is a stream's memory and keeps a second run of the same stream out. Folders lie in the shared folder of the
session unless the caller names others.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.cut import new_place


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder}/{name}.parquet*")


def run_once(stream: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """Write what is new to the table at ``place`` and read the table."""
    query = stream.writeStream.format("parquet").option("path", f"{place}/table").option("checkpointLocation", f"{place}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/table")


def partial_counts(stream: DataFrame, keys: list[Column], sums: dict[str, Column], place: str | None = None) -> DataFrame:
    """Counts and sums per key over all batches so far: each batch appends its own, and reading adds them up.

    No state is kept, so a run costs what is new, and a batch that is repeated after a failure replaces its own part.
    """
    place = place or new_place(stream.sparkSession, "stream")

    def save(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))
        part.write.mode("overwrite").parquet(f"{place}/parts/batch={number}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    parts = stream.sparkSession.read.parquet(f"{place}/parts").drop("batch")
    names = [c for c in parts.columns if c not in ("n", *sums)]
    return parts.groupBy(*names).agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in sums))


def new_rows(stream: DataFrame, keys: list[str], time: str, lookback: str, place: str | None = None) -> DataFrame:
    """Rows whose key has not come within ``lookback`` of event time; later ones than that are dropped."""
    once = stream.withWatermark(time, lookback).dropDuplicatesWithinWatermark(keys)
    return run_once(once, place or new_place(stream.sparkSession, "stream"))


def ingest(entries: DataFrame, known: DataFrame, key: str, updated: str, now: Column, lookback_days: int) -> DataFrame:
    """Entries to add: updated within the lookback and of a key that isn't known, one per key (the last updated)."""
    fresh = entries.filter(F.col(updated) >= now - F.make_dt_interval(F.lit(lookback_days)))
    last = fresh.groupBy(key).agg(F.max_by(F.struct(*entries.columns), F.struct(updated, F.xxhash64(*[c for c, t in entries.dtypes if not t.startswith("map")]))).alias("e")).select("e.*")
    return last.join(known.select(key).distinct(), key, "left_anti")


def stream_ema(stream: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3, place: str | None = None) -> DataFrame:
    """The moving average of each key over all its events, in the order of each batch; the last row of a key holds."""
    names = [key, *order, value]

    def update(k: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, u = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(parts)).sort_values(order)
        for v in rows[value]:
            n, u = n + 1, u + alpha * (v - u)
        state.update((n, u))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [round(u, 6)]})

    out = stream.select(*names).groupBy(key).applyInPandasWithState(update, f"{key} bigint, n bigint, ema double", "n bigint, u double", "append", "NoTimeout")
    rows = run_once(out, place or new_place(stream.sparkSession, "stream"))
    return rows.groupBy(key).agg(F.max("n").alias("n"), F.max_by("ema", "n").alias("ema"))


def pending(windows: DataFrame, done: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Windows that no row of ``done`` with this run's fingerprint covers; rows of another fingerprint are an error."""
    checked = done.filter(F.assert_true(F.col("fingerprint") == fingerprint, F.lit("the state is of another configuration")).isNull())
    return windows.join(checked.select(*keys).distinct(), keys, "left_anti")


def cached(asked: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Those asked with their cached columns, and those that the cache lacks."""
    return asked.join(cache, keys), asked.join(cache.select(*keys).distinct(), keys, "left_anti")


def remember(answers: DataFrame, place: str) -> None:
    """Append new answers to the cache table at ``place``; a crash leaves the table as it was."""
    answers.write.mode("append").parquet(place)


def retried(results: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """Results with those of a further round for the keys that had none."""
    return results.unionByName(again.join(results.select(key), key, "left_anti"))
