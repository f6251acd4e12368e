"""Similarity by shared tokens and matching runs of characters, hashed embeddings and clusters: what needs Python, in Arrow batches, and
retrieval, which compares so many pairs that it runs in Java (``Lexical.java``).

The sequence ratio is the standard library's, whose rule for popular characters in long texts no other measure reproduces. It costs
time in proportion to both lengths, so retrieval meets candidates by shared tokens first. It is computed here with the library's rules,
but over the places of the first text that can match alone, which is several times as fast for texts that have popular characters.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from difflib import get_close_matches
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from skein.functions import text as T
from skein.plans.cut import cut
from skein.plans.jvm import java_class
from skein.plans.spread import tasks

#: Blocks of fewer pairs aren't split; none holds more queries.
LEAST_PAIRS, MOST_QUERIES = 500_000, 20_000


@lru_cache(maxsize=4096)
def _places(b: str) -> dict[str, list[int]]:
    """Where each character of a text of 200 characters or more stands; without those of more than a hundredth of it."""
    out: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        out.setdefault(c, []).append(j)
    most = len(b) // 100 + 1
    return {c: js for c, js in out.items() if len(js) <= most}


def _short(a: str, b: str) -> int:
    """Characters in matching runs, b being too short for popular characters: the longest run, the first of them, then those beside it."""
    todo, total, find = [(0, len(a), 0, len(b))], 0, b.find
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        besti, size, i = alo, 0, alo
        while i + size < ahi:
            if find(a[i : i + size + 1], blo, bhi) < 0:
                i += 1
                continue
            besti, size = i, size + 1
        if size:
            bestj = find(a[besti : besti + size], blo, bhi)
            total += size
            if alo < besti and blo < bestj:
                todo.append((alo, besti, blo, bestj))
            if besti + size < ahi and bestj + size < bhi:
                todo.append((besti + size, ahi, bestj + size, bhi))
    return total


def ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio()."""
    if not a and not b:
        return 1.0
    if len(b) < 200:
        return 2.0 * _short(a, b) / (len(a) + len(b))
    places = _places(b)
    hits = [(i, js) for i, c in enumerate(a) if (js := places.get(c))]
    at = [i for i, _ in hits]
    todo, total = [(0, len(a), 0, len(b))], 0
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        besti, bestj, size, before, runs = alo, blo, 0, -2, {}
        for i, js in hits[bisect_left(at, alo) : bisect_left(at, ahi)]:
            if i != before + 1:
                runs = {}
            before, new = i, {}
            for j in js:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                n = new[j] = runs.get(j - 1, 0) + 1
                if n > size:
                    besti, bestj, size = i - n + 1, j - n + 1, n
            runs = new
        while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
            besti, bestj, size = besti - 1, bestj - 1, size + 1
        while besti + size < ahi and bestj + size < bhi and a[besti + size] == b[bestj + size]:
            size += 1
        if size:
            total += size
            if alo < besti and blo < bestj:
                todo.append((alo, besti, blo, bestj))
            if besti + size < ahi and bestj + size < bhi:
                todo.append((besti + size, ahi, bestj + size, bhi))
    return 2.0 * total / (len(a) + len(b))


def sequence_ratio(a: Column, b: Column) -> Column:
    """SequenceMatcher's ratio of two lower-cased texts; null counts as empty, two empty texts as equal."""

    @F.pandas_udf("double")
    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p or "", q or "") for p, q in zip(x, y)], dtype="float64")

    return ratios(F.lower(a), F.lower(b))


def lexical_similarity(a: Column, b: Column) -> Column:
    """0.65 token Jaccard + 0.35 sequence ratio."""
    return 0.65 * T.jaccard(T.token_set(a), T.token_set(b)) + 0.35 * sequence_ratio(a, b)


def blockwise(queries: DataFrame, docs: DataFrame, group: list[str], mode: str, columns: str, k: int = 1, wide: int = 1, least: float = 0.0, shares: int = 4) -> DataFrame:
    """queries: the group's columns, q, text, day (null: all documents count); docs: the group's columns, p, text, day; texts in lower case.
    What ``Lexical.java`` finds in this mode, with these columns.

    A block is some of a group's queries and all of its documents, in one row. A group has as many blocks as its share of all pairs asks for,
    so that no task has much more to do than another and documents are sent no more often than tasks need them: all pairs are ``shares`` times
    as many blocks as there are tasks."""
    spark = queries.sparkSession
    parts = 4 * tasks(queries)
    sides = queries.select(*group, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(docs.select(*group, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = cut(sides.groupBy(*group).agg(F.sum("l").alias("l"), F.sum("r").alias("r")))
    most = max((counts.agg(F.sum(F.col("l").cast("double") * F.col("r"))).first()[0] or 0) / (shares * tasks(queries)), LEAST_PAIRS)
    n = counts.select(*group, F.greatest(F.lit(1), F.ceil(F.col("l").cast("double") * F.col("r") / most), F.ceil(F.col("l") / MOST_QUERIES)).alias("blocks"))
    one = F.coalesce("blocks", F.lit(1).cast("bigint"))
    left = queries.join(n, group, "left").select(*group, F.pmod(F.xxhash64("q"), one).alias("block"), F.struct("q", "text", F.unix_date("day").alias("day")).alias("query"))
    right = docs.join(n, group, "left").select(*group, F.explode(F.sequence(F.lit(0).cast("bigint"), one - 1)).alias("block"), F.struct("p", "text", F.unix_date("day").alias("day")).alias("doc"))
    keys = [*group, "block"]
    both = left.unionByName(right, allowMissingColumns=True).repartition(parts, *keys).groupBy(*keys).agg(F.collect_list("query").alias("queries"), F.sort_array(F.collect_list("doc")).alias("docs"))
    kinds = T_.ArrayType(T_.StructType.fromDDL(columns))
    name = f"skein_{mode}_{uuid.uuid4().hex}"
    lexical = java_class(spark, Path(__file__).with_name("Lexical.java")).getConstructors()[0]
    args = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 4)
    args[0], args[1], args[2], args[3] = mode, k, wide, float(least)
    spark._jsparkSession.udf().register(name, lexical.newInstance(args), spark._jvm.org.apache.spark.sql.types.DataType.fromJson(kinds.json()))
    return both.select(F.explode_outer(F.call_udf(name, F.col("queries"), F.col("docs"))).alias("found")).filter("found is not null").select("found.*")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def two_stage_retrieval(queries: DataFrame, docs: DataFrame, group: list[str], k: int, least: float = 0.0, wide: int = 50) -> DataFrame:
    """queries: the group's columns, q, text, day; docs: the group's columns, p, text, day. The max(10 k, wide) documents of most token overlap
    with each query, within equal groups and of days up to the query's, rescored by lexical similarity: the k best of at least ``least``;
    ties by document key."""
    columns = f"q {_kind(queries, 'q')}, p {_kind(docs, 'p')}, score double, place int"
    return blockwise(queries.withColumn("text", F.lower("text")), docs.withColumn("text", F.lower("text")), group, "rescored", columns, k, max(10 * k, wide), least, shares=2)


def nearest(queries: DataFrame, docs: DataFrame, group: list[str]) -> DataFrame:
    """queries: the group's columns, q, text, day; docs: the group's columns, text, day. Per query the greatest lexical similarity with a
    document of its group of a day up to its own: q, s; no row without such a document. Every pair is compared whose token Jaccard and
    lengths don't rule it out, until its matching runs show that it can't be the greatest."""
    docs = docs.select(*group, F.lit(0).alias("p"), F.lower("text").alias("text"), "day")
    return blockwise(queries.withColumn("text", F.lower("text")), docs, group, "nearest", f"q {_kind(queries, 'q')}, s double")


def diversity(items: DataFrame, group: list[str], order: list[Column], text: str, k: int = 5) -> DataFrame:
    """Mean lexical distance between the first k items of each group in order; 0 for a group of one."""
    few = items.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("n") <= k).select(*group, "n", F.coalesce(text, F.lit("")).alias("t"))
    a, b = few.withColumnsRenamed({"n": "na", "t": "ta"}), few.withColumnsRenamed({"n": "nb", "t": "tb"})
    pairs = a.join(b, group).filter("na < nb").groupBy(*group).agg(F.round(F.avg(1 - lexical_similarity(F.col("ta"), F.col("tb"))), 4).alias("diversity"))
    return few.select(*group).distinct().join(pairs, group, "left").fillna(0.0, ["diversity"])


def close_category(df: DataFrame, value: str, categories: list[str], cutoff: float = 0.6) -> DataFrame:
    """Distinct values with the category most alike by sequence ratio, if at least ``cutoff``: value, category. For a short list of categories."""

    @F.pandas_udf("string")
    def close(x: pd.Series) -> pd.Series:
        return pd.Series([next(iter(get_close_matches(v, categories, n=1, cutoff=cutoff)), None) if v else None for v in x], dtype="object")

    return df.select(value).distinct().withColumn("category", close(F.lower(F.col(value))))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Counts of whitespace words hashed into so many places (blake2b), divided by their norm; a text without words is all zero."""

    @F.pandas_udf("array<float>")
    def embed(x: pd.Series) -> pd.Series:
        out = []
        for t in x:
            v = np.zeros(dims, dtype=np.float32)
            for w in (t or "").lower().split():
                v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") % dims] += 1
            norm = np.linalg.norm(v)
            out.append(v / norm if norm else v)
        return pd.Series(out)

    return embed(text)


def cluster_labels(x: np.ndarray, k: int, rounds: int = 25, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from k rows far apart: the first drawn with the seed, each next the one farthest from those chosen."""
    k = min(k, len(x))
    chosen = [int(np.random.default_rng(seed).integers(len(x)))]
    nearest = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(1))
    centres = x[chosen].copy()
    labels = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        labels = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2).argmin(1)
        moved = np.stack([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return labels


def cluster_coverage(vectors: DataFrame, group: list[str], key: str, vector: str, matched: str, k: int = 8) -> DataFrame:
    """Per group (one window's future papers) the share of k clusters that hold a matched paper: clusters, covered, coverage. Rows are joined
    to their labels by key, so a paper without a vector is in no cluster."""

    def run(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        labels = cluster_labels(np.stack(rows.v.to_numpy()).astype(np.float64), k)
        n, covered = len(set(labels)), len(set(labels[rows.matched.to_numpy(dtype=bool)]))
        return pd.DataFrame([[*names, n, covered, round(covered / n, 4)]], columns=[*group, "clusters", "covered", "coverage"])

    kinds = ", ".join(f"{g} {vectors.schema[g].dataType.simpleString()}" for g in group)
    usable = vectors.filter(F.col(vector).isNotNull()).select(*group, F.col(key).alias("key"), F.col(vector).alias("v"), F.coalesce(matched, F.lit(False)).alias("matched"))
    return usable.groupBy(*group).applyInPandas(run, f"{kinds}, clusters bigint, covered bigint, coverage double")
