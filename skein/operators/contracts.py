"""Records and contracts: selection, defaults, nesting, payloads, rewards with reasons, and what a daily run needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vectors as V


def selected(asked: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Each distinct id asked for, with whether the dimension knows it; ``require`` turns unknown ones into an error."""
    known = dimension.select(key).distinct().withColumn("known", F.lit(True))
    return asked.select(key).filter(F.col(key).isNotNull()).distinct().join(known, key, "left").fillna(False, ["known"])


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows, or an error at the first that breaks the condition."""
    return df.filter(F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(message)).isNull())


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """The table itself; an empty one is an error."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def train_cutoffs(cutoffs: DataFrame, cutoff: str, evaluated: str | None = None, strict: bool = True) -> DataFrame:
    """Cutoffs with the one evaluated (the last unless named; a name that is none of them is an error) and whether they are trained on: if strict, only
    earlier ones are."""
    chosen = cutoffs.agg(F.max(cutoff if evaluated is None else F.when(F.col(cutoff) == evaluated, F.col(cutoff))).alias("evaluated"))
    chosen = require(chosen, F.col("evaluated").isNotNull(), "the cutoff to evaluate is not among the cutoffs")
    return cutoffs.join(F.broadcast(chosen)).withColumn("trained", F.col(cutoff) < F.col("evaluated") if strict else F.lit(True))  # one row


def active(runs: Column) -> Column:
    """Of an array of topic runs those that differ from a fresh one."""
    return F.filter(runs, lambda r: (r["matched_paper_count"] > 0) | (r["generation_status"] != "pending") | (r["backtest_status"] != "pending"))


def flattened(records: DataFrame) -> DataFrame:
    """records: id, name, topic_runs (array of topic_id, topic_name, cutoff, predictions), generation (cutoff, predictions). One row per
    prediction, nested runs exploded; a record without runs gives those of its own generation under the topic "legacy"."""
    legacy = F.array(F.struct(F.lit("legacy").alias("topic_id"), F.lit("Legacy").alias("topic_name"), F.col("generation.cutoff").alias("cutoff"), F.col("generation.predictions").alias("predictions")))
    runs = F.when(F.size(F.coalesce("topic_runs", F.array())) > 0, F.col("topic_runs")).when(F.col("generation").isNotNull(), legacy)
    r = records.select("id", "name", F.explode(runs).alias("r")).select("id", "name", "r.topic_id", "r.topic_name", F.coalesce("r.cutoff", F.lit("")).alias("cutoff"), F.explode("r.predictions").alias("p"))
    return r.select("id", "name", "topic_id", "topic_name", "cutoff", "p.*").orderBy(F.desc("cutoff"), "topic_name", "name", "rank", "id")


def defaults(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Columns as they are, missing ones by their default: null, and for strings blank, counts as missing."""
    text = {c for c, t in df.dtypes if t == "string"}
    return df.withColumns({c: F.coalesce(F.when(F.trim(c) != "", F.trim(c)) if c in text else F.col(c), v) for c, v in values.items()})


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows whose key isn't in the new ones, and the new ones: create and update by key; ``deleted`` drops keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys.select(*key).distinct(), key, "left_anti")


def joined_errors(df: DataFrame, group: list[str], name: str, error: Column) -> DataFrame:
    """Per group "name: error" of the rows that have one, in order of the name, parted by semicolons; null if none has."""
    e = df.select(*group, F.col(name).alias("_n"), error.alias("_e")).withColumn("_e", F.when(F.col("_e") != "", F.concat_ws(": ", "_n", "_e")))
    lists = e.groupBy(*group).agg(F.sort_array(F.collect_list("_e")).alias("_l"))
    return lists.select(*group, F.when(F.size("_l") > 0, F.array_join("_l", "; ")).alias("errors"))


def calendar_label(month: Column, validation: str | None, test: str | None) -> Column:
    """train, validation or test of a month YYYY-MM, by the first month of either part."""
    if validation and test and test < validation:
        raise ValueError("the test part must not begin before validation")
    out = F.lit("train")
    if validation:
        out = F.when(month >= validation, "validation").otherwise(out)
    return F.when(month >= test, "test").otherwise(out) if test else out


def first_future(papers: DataFrame, windows: DataFrame, horizon: int, n: int, end: Column) -> DataFrame:
    """papers: topic_id, paper_id, published; windows: topic_id, cut. The first n papers of each window's future in the order of publication."""
    later = windows.join(papers.filter("published is not null"), "topic_id").filter((F.col("published") > F.col("cut")) & (F.col("published") <= end))
    place = F.row_number().over(Window.partitionBy("topic_id", "cut").orderBy("published", "paper_id"))
    return later.withColumn("place", place).filter(F.col("place") <= n).select("topic_id", "cut", "paper_id", "place")


def payload_topic(named: Column, alternative: Column, of_paper: Column) -> Column:
    """The first of the three that isn't blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in (named, alternative, of_paper)), F.lit(""))


def metric_reward(mode: str, parts: dict[str, Column]) -> Column:
    """The one metric of the mode, between 0 and 1, rounded to 4 places; missing counts as 0, an unknown mode is an error."""
    if mode not in parts:
        raise ValueError(f"unsupported mode {mode!r}: one of {sorted(parts)}")
    x = F.coalesce(F.when(~F.isnan(parts[mode]), parts[mode]), F.lit(0.0))
    return F.round(V.clamp(x), 4)


def strict_reason(innovation: Column, rollout: Column, claimed: Column, finished: Column, gate: Column) -> Column:
    """The first reason for which a completion is invalid; null if it is valid."""
    return (
        F.when(innovation.isNull(), "missing_innovation").when(F.coalesce(F.size(rollout), F.lit(0)) <= 0, "stepwise_rollout_required")
        .when(~innovation.eqNullSafe(claimed), "innovation_mismatch").when(~F.coalesce(finished, F.lit(False)), "unfinished_rollout").otherwise(gate)
    )


def rubric_block(topic: Column, focus: Column, criteria: Column, must_not: Column) -> Column:
    """A rubric as plain lines for a judge."""
    none = F.array().cast("array<string>")
    listed = lambda head, c: F.when(F.size(F.coalesce(c, none)) > 0, F.concat(F.array(F.lit(head)), F.transform(c, lambda x: F.concat(F.lit("  - "), x)))).otherwise(none)
    head = F.array(F.concat(F.lit("Topic: "), topic))
    lines = F.concat(head, F.when(F.size(F.coalesce(focus, none)) > 0, F.array(F.concat(F.lit("Operator focus: "), F.array_join(focus, ", ")))).otherwise(none), listed("Match criteria:", criteria), listed("Disqualifying criteria:", must_not))
    return F.array_join(lines, "\n")


def memory_lines(df: DataFrame, group: list[str], entry: Column, order: list[str]) -> DataFrame:
    """Memory entries as JSON, one a line, in order."""
    lists = df.select(*group, F.struct(*order, F.to_json(entry).alias("_j")).alias("_x")).groupBy(*group).agg(F.sort_array(F.collect_list("_x")).alias("_l"))
    return lists.select(*group, F.size("_l").alias("entries"), F.array_join(F.transform("_l", lambda x: x["_j"]), "\n").alias("memory_text"))


def community_overlap(sets: DataFrame, key: str, members: str, community: DataFrame) -> DataFrame:
    """Per row the share of its members (authors, references) that stand in some other row of the community; 0 for a row without any.

    community: the same columns. A member counts for a row if a community row of another key has it, so members are counted once by
    rows, not paired.
    """
    each = lambda df: df.select(F.col(key).alias("_k"), F.explode(F.array_distinct(members)).alias("_m")).filter("_m is not null")
    pool = each(community).groupBy("_m").agg(F.count_distinct("_k").alias("_rows"), F.min("_k").alias("_one"))
    shared = each(sets).join(pool, "_m", "left").groupBy("_k").agg(F.count("*").alias("_own"), F.count_if((F.col("_rows") > 1) | ((F.col("_rows") == 1) & (F.col("_one") != F.col("_k")))).alias("_common"))
    return sets.select(key).join(shared, F.col(key) == F.col("_k"), "left").select(key, F.coalesce(F.round(F.col("_common") / F.col("_own"), 6), F.lit(0.0)).alias("overlap"))


def corpus_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """queries: topic_id, q, words; docs: topic_id, p, month, words. The k documents of each query's topic by the greater of token overlap and
    Jaccard, then by month and id; documents without a shared token don't come out.

    Tokens of both sides meet by equality, within a topic.
    """
    d = docs.withColumn("n", F.size("words"))
    left = queries.select("topic_id", "q", F.explode("words").alias("t"))
    right = d.select("topic_id", "p", F.explode("words").alias("t"))
    met = left.join(right, ["topic_id", "t"]).groupBy("topic_id", "q", "p").agg(F.count("*").alias("common"))
    j = met.join(queries.select("q", F.size("words").alias("nq")), "q").join(d.select("p", "month", "n"), "p")
    score = F.round(F.greatest(F.col("common") / F.least("nq", "n"), F.col("common") / (F.col("nq") + F.col("n") - F.col("common"))), 6)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "month", "p"))
    return j.withColumn("score", score).withColumn("place", place).filter(F.col("place") <= k).select("q", "p", "month", "score", "place")


def validated(df: DataFrame, group: list[str], positive: Column, auc: DataFrame, version: str, least: float = 0.7) -> DataFrame:
    """Buffered rows per group: accepted, and one version on, only if both sides have rows and the AUC is at least ``least``; else a reason."""
    sides = df.groupBy(*group).agg(F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives"), F.max(version).alias("_v"))
    j = sides.join(auc, group, "left")
    enough = (F.col("positives") > 0) & (F.col("negatives") > 0)
    ok = enough & (F.coalesce("auc", F.lit(0.0)) >= least)
    return j.select(*group, "positives", "negatives", ok.alias("accepted"), (F.col("_v") + ok.cast("int")).alias("version"), F.when(~enough, "too few rollouts").when(ok, "passed").otherwise("rejected").alias("reason"))


def memory_of(paper_keywords: Column, title: Column, summary: Column) -> Column:
    """A paper's triple by rule: three keywords, or five words of the title; the operator "extend"; the first 100 characters of the summary, or the title."""
    words = F.array_join(F.slice(F.filter(F.split(F.trim(title), r"\s+"), lambda w: w != ""), 1, 5), " ")
    base = F.when(F.size(F.coalesce(paper_keywords, F.array().cast("array<string>"))) > 0, F.array_join(F.slice(paper_keywords, 1, 3), " ")).otherwise(words)
    return F.struct(base.alias("base_direction"), F.lit("extend").alias("operator"), F.coalesce(F.when(summary != "", F.substring(summary, 1, 100)), title).alias("gap"))

