"""Ordered folds: steps whose outcome depends on the steps before, over the short sorted list of each group.

Lists are limited to what can matter where the rule allows it: with k predictions only the k best candidates of each can ever be
taken. Deduplication, selection by marginal relevance and moving averages take whole groups, which must be those of one window, prompt
or entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T


def greedy_match(candidates: DataFrame, window: list[str], k: int) -> DataFrame:
    """candidates: the window's columns, rank, paper, score. Columns: the window's, rank, paper, score.

    In order of rank each prediction takes its best paper that none before it took; order of preference: score, then the larger
    paper id. Predictions of rank above k are left out.
    """
    best = Window.partitionBy(*window, "rank").orderBy(F.desc("score"), F.desc("paper"))
    few = candidates.filter(F.col("rank") <= k).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    lists = few.groupBy(*window).agg(F.sort_array(F.collect_list(F.struct("rank", "n", "paper", "score"))).alias("list"))
    kind = "array<struct<rank:int,paper:string,score:double>>"

    def step(taken: Column, c: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["rank"] == c["rank"]) | (t["paper"] == c["paper"]))
        new = F.array(F.struct(c["rank"].cast("int").alias("rank"), c["paper"].cast("string").alias("paper"), c["score"].cast("double").alias("score")))
        return F.when(free, F.concat(taken, new)).otherwise(taken)

    taken = F.aggregate("list", F.array().cast(kind), step)
    return lists.select(*window, F.explode(taken).alias("t")).select(*window, "t.rank", "t.paper", "t.score")


def greedy_dedupe(items: DataFrame, group: list[str], order: list[str], key: str, text: Column, least: float = 0.8, title: str | None = None, strict: bool = False) -> DataFrame:
    """The items of each group that are not like an earlier kept one, in order: the group's columns, key, and position.

    Like: token Jaccard of at least ``least`` (above it if ``strict``), or, if a title column is named, the same title key. A group is one
    prompt's or window's list: its rows come together in one task, and each is compared with those kept.
    """
    n = Window.partitionBy(*group).orderBy(*order)
    titled = T.title_key(F.coalesce(F.col(title), F.lit(""))) if title else F.lit(None).cast("string")
    few = items.withColumns({"n": F.row_number().over(n), "tok": T.token_set(text), "tk": titled})
    lists = few.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("n", F.col(key).alias("key"), "tok", "tk"))).alias("list"))

    def step(kept: Column, c: Column) -> Column:
        def like(x: Column) -> Column:
            j = T.jaccard(x["tok"], c["tok"])
            near = j > least if strict else j >= least
            return F.coalesce(near | (x["tk"] == c["tk"]), near)

        return F.when(F.exists(kept, like), kept).otherwise(F.concat(kept, F.array(c)))

    kept = F.aggregate("list", F.filter("list", lambda x: F.lit(False)), step)
    return lists.select(*group, F.posexplode(kept).alias("position", "x")).select(*group, F.col("x.key").alias(key), "position")


def mmr_select(items: DataFrame, group: list[str], key: str, score: str, text: Column, k: int, weight: float = 0.65) -> DataFrame:
    """k items of each group, one after another: the best by weight * score + (1 - weight) * novelty, where novelty is one less the
    greatest token Jaccard with those chosen; the first by score alone. Ties go to the earlier by score, then key. All items
    of the group are compared. Columns: the group's, key, place, mmr.
    """
    n = Window.partitionBy(*group).orderBy(F.desc(score), key)
    pool = items.withColumns({"n": F.row_number().over(n), "tok": T.token_set(text)})
    lists = pool.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("n", F.col(key).alias("key"), F.col(score).alias("score"), "tok"))).alias("list"))

    def step(chosen: Column, place: Column) -> Column:
        left = F.filter("list", lambda c: ~F.exists(chosen, lambda x: x["n"] == c["n"]))

        def value(c: Column) -> Column:
            near = F.aggregate(chosen, F.lit(0.0), lambda m, x: F.greatest(m, T.jaccard(x["tok"], c["tok"])))
            return F.when(F.size(chosen) == 0, c["score"]).otherwise(F.round(weight * c["score"] + (1 - weight) * (1 - near), 9))

        rated = F.transform(left, lambda c: F.struct(value(c).alias("mmr"), (-c["n"]).alias("m"), c["n"].alias("n"), c["key"].alias("key"), c["tok"].alias("tok")))
        best = F.array_max(rated)
        return F.when(best.isNull(), chosen).otherwise(F.concat(chosen, F.array(best)))

    empty = F.transform(F.filter("list", lambda x: F.lit(False)), lambda c: F.struct(c["score"].alias("mmr"), (-c["n"]).alias("m"), c["n"].alias("n"), c["key"].alias("key"), c["tok"].alias("tok")))
    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, step)
    return lists.select(*group, F.posexplode(chosen).alias("p", "x")).select(*group, F.col("x.key").alias(key), (F.col("p") + 1).alias("place"), F.round("x.mmr", 4).alias("mmr"))


def ema(events: DataFrame, group: list[str], order: list[str], value: str, alpha: float = 0.3, start: float = 0.0) -> DataFrame:
    """The exponential moving average of each group's values in order: u + alpha * (value - u) from ``start``."""
    lists = events.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("v")))).alias("list"))
    return lists.select(*group, F.size("list").alias("n"), F.round(F.aggregate("list", F.lit(start), lambda u, e: u + alpha * (e["v"] - u)), 6).alias("ema"))


def search_states(actions: DataFrame, key: str, most_searches: int, most_selected: int) -> DataFrame:
    """actions: key, step, type (search, select or finish), ids (array). The state after the last valid action of each key.

    A search beyond ``most_searches``, a selection of ids that no search surfaced or beyond ``most_selected``, and anything after
    finish are invalid: they are counted and change nothing.
    """
    lists = actions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("step", "type", "ids"))).alias("list"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("surfaced"), none.alias("selected"), F.lit(0).alias("searches"), F.lit(False).alias("done"), F.lit(0).alias("invalid"))

    def state(s: Column, **new: Column) -> Column:
        return F.struct(*(new.get(f, s[f]).alias(f) for f in ("surfaced", "selected", "searches", "done", "invalid")))

    def step(s: Column, a: Column) -> Column:
        searched = state(s, surfaced=F.array_union(s["surfaced"], a["ids"]), searches=s["searches"] + 1)
        picked = F.array_union(s["selected"], a["ids"])
        can_select = (F.size(F.array_except(a["ids"], s["surfaced"])) == 0) & (F.size(picked) <= most_selected)
        return (
            F.when(s["done"], state(s, invalid=s["invalid"] + 1))
            .when((a["type"] == "search") & (s["searches"] < most_searches), searched)
            .when((a["type"] == "select") & can_select, state(s, selected=picked))
            .when(a["type"] == "finish", state(s, done=F.lit(True)))
            .otherwise(state(s, invalid=s["invalid"] + 1))
        )

    s = F.aggregate("list", start, step)
    return lists.select(key, s.alias("s")).select(key, F.size("s.surfaced").alias("surfaced"), F.array_join("s.selected", "|").alias("selected"), "s.searches", "s.done", "s.invalid")


def balanced_split(sizes: DataFrame, key: str, size: str, parts: int) -> DataFrame:
    """Longest first, each to the part with the least so far (the lower number on ties): key, part. For the rows of one dimension."""
    lists = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col(size)).alias("s"), F.col(key).alias("key")))).alias("list"))
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), parts).alias("load"), F.array().cast("array<struct<key:string,part:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        least = (F.array_position(a["load"], F.array_min(a["load"])) - 1).cast("int")
        load = F.transform(a["load"], lambda v, i: F.when(i == least, v - x["s"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(a["out"], F.array(F.struct(x["key"].cast("string").alias("key"), least.alias("part")))).alias("out"))

    return lists.select(F.explode(F.aggregate("list", start, step)["out"]).alias("o")).select(F.col("o.key").alias(key), F.col("o.part").alias("part"))


def duplicate_penalty(items: DataFrame, group: list[str], key: str, text: Column, least: float = 0.85, longer_than: int = 3) -> DataFrame:
    """Per item, how many others of its group share at least ``least`` (Jaccard) of their longer words, and that share of the others."""
    t = items.select(*group, F.col(key).alias("key"), T.blank_split(text, longer_than).alias("w"))
    a, b = t.withColumnsRenamed({"key": "a", "w": "wa"}), t.withColumnsRenamed({"key": "b", "w": "wb"})
    pairs = a.join(b, group).groupBy(*group, "a").agg(F.count_if((F.col("a") != F.col("b")) & (T.jaccard(F.col("wa"), F.col("wb")) >= least)).alias("alike"), (F.count("*") - 1).alias("others"))
    return pairs.select(*group, F.col("a").alias(key), "alike", F.round(F.when(F.col("others") > 0, F.col("alike") / F.col("others")).otherwise(0.0), 4).alias("penalty"))

