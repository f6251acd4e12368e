"""Joins of papers, topics, predictions and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.lexical import blockwise
from skein.operators.mapping import small


def topic_terms(topics: DataFrame) -> DataFrame:
    """Columns topic, term: the distinct names, aliases and keywords of each topic as phrases of tokens."""
    none = F.array().cast("array<string>")
    terms = F.concat(F.array("topic_name"), F.coalesce("aliases", none), F.coalesce("keywords", none))
    return topics.select(F.col("topic_id").alias("topic"), F.explode(terms).alias("raw")).select("topic", T.phrase(F.col("raw")).alias("term")).filter("term <> ''").distinct()


def phrase_join(docs: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """Columns key, topic: every topic one of whose terms stands in the text as whole tokens.

    Runs of one to the longest term's number of tokens are exploded and met with the terms by equality, so the work grows with the
    texts and not with texts times terms.
    """
    longest = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    toks = docs.select(key, T.tokens(text).alias("t"))

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.array_join(F.slice("t", i, n), " "))

    grams = [runs_of(n) for n in range(1, longest + 1)]
    guarded = [F.when(F.size("t") >= n, g).otherwise(F.array().cast("array<string>")) for n, g in enumerate(grams, 1)]
    runs = toks.select(key, F.explode(F.array_distinct(F.concat(*guarded))).alias("term"))
    return runs.join(small(terms), "term").select(key, "topic").distinct()


def token_retrieval(queries: DataFrame, query_key: str, query_text: Column, docs: DataFrame, doc_key: str, doc_text: Column, k: int, group: list[str]) -> DataFrame:
    """The k documents of each query, within equal groups, by overlap of their token sets; ties by document key; no shared token, no row.

    Words meet within blocks of a group's queries with all its documents, in one task each (``Lexical.java``), so no pair is ever written.
    """
    q = queries.select(*group, F.col(query_key).alias("q"), F.lower(query_text).alias("text"), F.lit(None).cast("date").alias("day"))
    p = docs.select(*group, F.col(doc_key).alias("p"), F.lower(doc_text).alias("text"), F.lit(None).cast("date").alias("day"))
    columns = f"q {q.schema['q'].dataType.simpleString()}, p {p.schema['p'].dataType.simpleString()}, common bigint, qn int, pn int, place int"
    found = blockwise(q, p, group, "overlap", columns, k)
    scored = found.withColumn("overlap", F.round(F.col("common") / F.least("qn", "pn"), 6)).withColumn("jaccard", F.round(F.col("common") / (F.col("qn") + F.col("pn") - F.col("common")), 6))
    return scored.select("q", "p", "common", "overlap", "jaccard", "place")


def priority_join(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """rows: row_id, paper, cutoff, fallback; samples: sample_id, paper, cutoff, value.

    Columns row_id, value, how: the sample of the same paper and cutoff ("exact"), else the paper's latest one ("latest"), else the
    row's own fallback ("derived"). Ties go to the smallest sample id.
    """
    s = samples.select("sample_id", "paper", F.col("cutoff").alias("s_cutoff"), "value")
    exact = s.groupBy("paper", F.col("s_cutoff").alias("cutoff")).agg(F.min_by("value", "sample_id").alias("exact_value"), F.lit(1).alias("has_exact"))
    order = F.struct(F.col("s_cutoff"), -F.col("sample_id"))
    latest = s.groupBy("paper").agg(F.max_by("value", order).alias("latest_value"), F.lit(1).alias("has_latest"))
    joined = rows.join(exact, ["paper", "cutoff"], "left").join(latest, "paper", "left")
    value = F.when(F.col("has_exact") == 1, F.col("exact_value")).when(F.col("has_latest") == 1, F.col("latest_value")).otherwise(F.col("fallback"))
    how = F.when(F.col("has_exact") == 1, "exact").when(F.col("has_latest") == 1, "latest").otherwise("derived")
    return joined.select("row_id", value.alias("value"), how.alias("how"))


def fan_out(episodes: DataFrame, samples: DataFrame) -> DataFrame:
    """episodes: episode, paper; samples: sample_id, paper. One row per sample of an episode's papers; one with a null sample for an episode without."""
    found = episodes.join(samples, "paper").select("episode", "sample_id")
    bare = episodes.select("episode").distinct().join(found, "episode", "left_anti").withColumn("sample_id", F.lit(None).cast("bigint"))
    return found.unionByName(bare)


def first_wins(df: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """Per key the value of its first row in the order."""
    return df.groupBy(key).agg(F.min_by(F.struct(value), F.struct(*order))[value].alias(value))


def citation_overlap(papers: DataFrame, key: str, refs: str) -> DataFrame:
    """Columns a, b, shared: pairs of papers, a < b, and the references that both cite, for papers that share one."""
    cites = papers.select(F.col(key).alias("p"), F.explode(F.array_distinct(refs)).alias("ref")).filter("ref is not null")
    a, b = cites.withColumnRenamed("p", "a"), cites.withColumnRenamed("p", "b")
    return a.join(b, "ref").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def hit_control_citation(candidates: DataFrame, cites: DataFrame) -> DataFrame:
    """candidates: group, paper, hit (boolean); cites: paper, ref, and ref is a candidate's paper.

    Per hit and control: papers, and the share that some other paper cites.
    """
    cited = cites.select(F.col("ref").alias("paper")).distinct().withColumn("cited", F.lit(1))
    joined = candidates.join(cited, "paper", "left")
    return joined.groupBy("hit").agg(F.count("*").alias("papers"), F.round(F.avg(F.coalesce("cited", F.lit(0))), 6).alias("cited_share"))


def hierarchy_fill(dimension: DataFrame, facts: DataFrame, key: str, zeros: dict) -> DataFrame:
    """Every row of the dimension, with its facts or their defaults."""
    return dimension.join(facts, key, "left").fillna(zeros)
