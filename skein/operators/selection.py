"""Selections, contexts, priors, audits and comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.mapping import small
from skein.operators.running import places


def base_score(words: Column, signals: Column) -> Column:
    """0.75 coverage of the signal terms + 0.25 specificity (words up to 30); 0 without signals."""
    n = F.size(signals)
    covered = F.size(F.array_intersect(signals, words)) / F.when(n > 0, n)
    return F.when(n > 0, F.round(0.75 * covered + 0.25 * F.least(F.size(words) / 30, F.lit(1.0)), 4)).otherwise(0.0)


def latest(df: DataFrame, group: list[str], date: str) -> DataFrame:
    """The rows of each group at its greatest date: the maxima are aggregated first and joined back."""
    top = df.groupBy(*group).agg(F.max(date).alias("_top"))
    named = top.select(*(F.col(g).alias(f"_{g}") for g in group), "_top")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    return df.join(named, [*same, F.col(date) == F.col("_top")]).drop("_top", *(f"_{g}" for g in group))


def recent_rows(df: DataFrame, group: list[str], date: str, key: str, cutoff: Column, months: int, fallback: int) -> DataFrame:
    """``df`` with the column part: recent within so many months of the cutoff, else long_term; in a group with none recent, its last
    ``fallback`` rows are."""
    near = F.col(date) >= F.add_months(cutoff, -months)
    any_near = df.groupBy(*(F.col(g).alias(f"_{g}") for g in group)).agg(F.bool_or(near).alias("_has"))
    r = places(df, group, [F.desc(date), F.desc(key)], "_place").join(any_near, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    recent = F.when(F.col("_has"), near).otherwise(F.col("_place") <= fallback)
    return r.withColumn("part", F.when(recent, "recent").otherwise("long_term")).drop("_has", "_place", *(f"_{g}" for g in group))


def materialized(df: DataFrame, key: str, ids: str, lookup: DataFrame, lookup_key: str, value: str) -> DataFrame:
    """Columns key, found: the values of a row's ids that the lookup has, in the order of the ids; an empty list if there is none."""
    each = df.select(key, F.posexplode(ids).alias("_o", "_id"))
    met = each.join(lookup.select(F.col(lookup_key).alias("_id"), F.coalesce(F.col(value), F.lit("-")).alias("_v")), "_id")
    lists = met.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias("found"))
    return df.select(key).join(lists, key, "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def prior(samples: DataFrame, key: str, text: str, memory: DataFrame, entry: str, known: str, group: list[str], least: float = 1e-6) -> DataFrame:
    """The greatest of log(similarity * strength) over the memory entries of the group, at least log(least).

    Strength falls with an entry's age in rows: 1 for the newest. Only entries that share a token can beat the floor, so samples
    and entries meet by tokens; the others get the floor.
    """
    m = places(memory, group, [entry], "_r", "_n").select(*group, F.col(entry).alias("_e"), T.token_set(F.col(known)).alias("_b"), (F.col("_r") / F.col("_n")).alias("_strength"))
    s = samples.select(*group, F.col(key).alias("_k"), T.token_set(F.col(text)).alias("_a"))
    left = s.select(*group, "_k", F.size("_a").alias("_na"), F.explode("_a").alias("_t"))
    right = m.select(*group, "_e", F.size("_b").alias("_nb"), "_strength", F.explode("_b").alias("_t"))
    common = left.join(right, [*group, "_t"]).groupBy("_k", "_e", "_na", "_nb", "_strength").agg(F.count("*").alias("_c"))
    value = F.col("_c") / (F.col("_na") + F.col("_nb") - F.col("_c")) * F.col("_strength")
    best = common.groupBy("_k").agg(F.max(value).alias("_best"))
    return samples.select(key).join(best, F.col(key) == F.col("_k"), "left").select(key, F.round(F.ln(F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(least))), 6).alias("log_prior"))


def audited(df: DataFrame, key: str, ids: str, cutoff: Column, papers: DataFrame) -> DataFrame:
    """Columns key, fault: none (no ids), unknown (an id without a paper), late (a paper published after the cutoff) or ok; the first that holds."""
    each = df.select(key, cutoff.alias("_cut"), F.explode(ids).alias("paper_id")).join(papers.withColumn("_known", F.lit(True)), "paper_id", "left")
    found = each.groupBy(key).agg(F.bool_or(F.col("_known").isNull()).alias("_unknown"), F.bool_or(F.col("published") > F.col("_cut")).alias("_late"))
    j = df.select(key, F.size(ids).alias("_n")).join(found, key, "left")
    return j.select(key, F.when(F.col("_n") == 0, "none").when(F.col("_unknown"), "unknown").when(F.col("_late"), "late").otherwise("ok").alias("fault"))


def run_table(windows: DataFrame, name: str, order: list[str], k: int = 5) -> DataFrame:
    """windows: name, hit, strict, k. One row per name, those of the order first and present even without windows, then the others."""
    spark = windows.sparkSession
    per = windows.groupBy(name).agg(F.count("*").alias("windows"), F.count_if("hit").alias("hits"), F.count_if("strict").alias("strict_hits"), F.count_if(F.col("k") < k).alias("short"))
    fixed = spark.createDataFrame(list(enumerate(order)), f"pos int, {name} string")
    j = per.withColumn("status", F.lit("scored")).join(fixed, name, "full_outer").fillna(0, ["windows", "hits", "strict_hits", "short"])
    return j.select(F.coalesce("pos", F.lit(len(order))).alias("pos"), name, "windows", "hits", "strict_hits", "short", F.coalesce("status", F.lit("not scored")).alias("status")).orderBy("pos", name)


def memory_before(samples: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """samples: sample_id, topic_id, m, own; entries: topic_id, m, source, op. Per sample its topic's n most frequent operators of months before
    its own, without entries of its own paper: op:count joined by bars.

    Counts are running sums per topic, operator and month, joined on the distinct months of the samples; a sample's own paper is then
    subtracted.
    """
    per = entries.groupBy("topic_id", "op", "m").agg(F.count("*").alias("c"))
    months = samples.select("topic_id", F.col("m").alias("at")).distinct()
    upto = per.join(months, "topic_id").filter("m < at").groupBy("topic_id", "at", "op").agg(F.sum("c").alias("c"))
    own = entries.filter("source is not null").groupBy("topic_id", "source", "op", "m").agg(F.count("*").alias("o"))
    mine = samples.filter("own is not null").join(own.withColumnRenamed("m", "em"), (F.col("own") == F.col("source")) & (samples["topic_id"] == own["topic_id"]) & (F.col("em") < F.col("m"))).groupBy("sample_id", "op").agg(F.sum("o").alias("o"))
    null_own = entries.filter("source is null").groupBy("topic_id", "op", F.col("m").alias("em")).agg(F.count("*").alias("o"))
    theirs = samples.filter("own is null").join(null_own, "topic_id").filter("em < m").groupBy("sample_id", "op").agg(F.sum("o").alias("o"))
    counts = samples.join(upto, (samples["topic_id"] == upto["topic_id"]) & (F.col("m") == F.col("at"))).select("sample_id", "op", "c").join(mine.unionByName(theirs), ["sample_id", "op"], "left")
    left = counts.withColumn("n", F.col("c") - F.coalesce("o", F.lit(0))).filter("n > 0")
    top = left.withColumn("r", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("n"), "op"))).filter(F.col("r") <= n)
    lists = top.groupBy("sample_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "op", "n"))), lambda x: F.concat(x["op"], F.lit(":"), x["n"].cast("string"))), "|").alias("memory"))
    return samples.select("sample_id").join(small(lists), "sample_id", "left").fillna("", ["memory"])
