"""Backtests, running sums, contracts and strategies against plain Python and by hand."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import backtest as B
from skein.operators import contracts as C
from skein.operators.running import places, running
from skein.plans import cut, strategies

DAY = datetime.date


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def apart(spark):
    """Small ranges are not merged, as large ones would not be."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, False)
    yield
    spark.conf.unset(name)


def test_running_sums_split_a_hot_group(spark, apart):
    """One group of half the rows: sums are right, and no range holds the group."""
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.5 else rng.choice([None, "a", "b"]), i, rng.randrange(5)) for i in range(4000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, i long, w long")
    got = running(df, ["g"], ["i"], F.col("w"), "before", "total")
    want, sums = [], {}
    for g, i, w in sorted(data, key=lambda x: x[1]):
        want.append((g or "", i, w, sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + w
    assert sorted((r.g or "", r.i, r.w, r.before) for r in got.collect()) == sorted(want)
    assert {(r.g, r.total) for r in got.select("g", "total").distinct().collect()} == set(sums.items())
    parts = df.repartitionByRange("g", "i").withColumn("p", F.spark_partition_id()).filter("g = 'hot'").groupBy("p").count().collect()
    assert len(parts) > 1
    numbered = places(df, [], [F.desc("i")], "n")
    assert sorted((r.n, r.i) for r in numbered.collect()) == [(n, 4000 - n) for n in range(1, 4001)]
    assert places(df.limit(0), ["g"], ["i"], "n").count() == 0


def test_backtest_by_hand(spark):
    papers = [("t", "p1", DAY(2024, 1, 10)), ("t", "p2", DAY(2024, 1, 31)), ("t", "f1", DAY(2024, 2, 1)), ("t", "f2", DAY(2024, 4, 30)), ("t", "late", DAY(2024, 5, 1)), ("t", "null", None), ("u", "x", DAY(2024, 1, 1))]
    p = spark.createDataFrame(papers, "topic_id string, paper string, published date")
    windows = spark.createDataFrame([("t", DAY(2024, 1, 31)), ("t", DAY(2024, 1, 31)), ("u", DAY(2024, 1, 31)), ("none", DAY(2024, 1, 31))], "topic_id string, cut date")
    sides = B.side_counts(p, windows, 3)
    assert rows(sides) == [("none", DAY(2024, 1, 31), 0, 0), ("t", DAY(2024, 1, 31), 2, 2), ("u", DAY(2024, 1, 31), 1, 0)]
    cut_day = DAY(2024, 1, 31)
    predictions = spark.createDataFrame([("s", "t", cut_day, r) for r in (1, 2, 3, 9)] + [("s", "u", cut_day, 1)], "strategy_id string, topic_id string, cut date, rank int")
    # 2 takes f1, since 1 has no match; 3 wants f1 as well and finds it taken
    candidates = spark.createDataFrame([("s", "t", cut_day, 2, "f1", 0.9, DAY(2024, 2, 1)), ("s", "t", cut_day, 3, "f1", 0.8, DAY(2024, 2, 1)), ("s", "t", cut_day, 9, "f2", 0.8, DAY(2024, 4, 30))], "strategy_id string, topic_id string, cut date, rank int, paper string, score double, published date")
    got = B.evaluate(predictions, candidates, sides, 5, 3, 1).collect()
    assert len(got) == 1  # u has no future
    r = got[0]
    assert (r.train_n, r.future_n, r.matched, r.hit_at_k, r.coverage_at_k, r.precision_at_k, r.mrr, r.duplicate_rate) == (2, 2, 1, 1.0, 0.5, round(1 / 3, 4), 0.5, round(1 / 3, 4))
    assert r.lead_time == round(1 / 90, 4)
    topics = {x.topic: x for x in B.per_topic(B.evaluate(predictions, candidates, sides, 5, 3, 1)).collect()}
    assert set(topics) == {"t", "ALL"} and topics["ALL"].mrr == 0.5
    records = rows(B.by_record(B.evaluate(predictions, candidates, sides, 5, 3, 1), predictions).select("topic_id", "windows", "score", "error"))
    assert records == [("t", 1, 0.85, None), ("u", 0, None, "no window with train and future papers")]
    assert B.per_topic(B.evaluate(predictions.limit(0), candidates.limit(0), sides, 5, 3, 1)).count() == 0


def test_judged_evaluation_by_hand(spark):
    day = DAY(2024, 1, 31)
    predictions = spark.createDataFrame([("s", "t", day, r) for r in (1, 2)] + [("z", "t", day, 1)], "strategy_id string, topic_id string, cut date, rank int")
    judged = spark.createDataFrame([("s", "t", day, 1, "a", 2.0, 3, 1, 3), ("s", "t", day, 1, "b", 1.0, 3, 2, 2), ("s", "t", day, 2, "b", 2.0, 3, 3, 3), ("s", "t", day, 2, "c", 1.0, None, 3, 3)], "strategy_id string, topic_id string, cut date, rank int, paper string, score double, problem int, method int, specificity int")
    got = {r.strategy_id: r for r in B.judged_evaluation(predictions, judged, 5).collect()}
    assert (got["s"].matched, got["s"].precision_at_k, got["s"].mrr, got["s"].soft_score, got["s"].judge_calls, got["s"].failed_share) == (1, 0.2, 1.0, round(7 / 9, 4), 4, 0.25)
    assert (got["z"].matched, got["z"].mrr, got["z"].judge_calls, got["z"].failed_share) == (0, 0.0, 0, 0.0)


def test_nested_runs_explode_in_order(spark):
    kind = "id string, name string, topic_runs array<struct<topic_id:string,topic_name:string,cutoff:string,predictions:array<struct<rank:int>>>>, generation struct<cutoff:string,predictions:array<struct<rank:int>>>"
    run = lambda t, c, *ranks: {"topic_id": t, "topic_name": t.upper(), "cutoff": c, "predictions": [{"rank": r} for r in ranks]}
    data = [("1", "n1", [run("b", "2024-01-31", 2, 1), run("a", "2024-02-29", 1)], None), ("2", "n2", [], {"cutoff": "2024-01-31", "predictions": [{"rank": 1}]}), ("3", "n3", None, None)]
    got = C.flattened(spark.createDataFrame(data, kind)).collect()
    assert [(r.id, r.topic_id, r["rank"]) for r in got] == [("1", "a", 1), ("1", "b", 1), ("1", "b", 2), ("2", "legacy", 1)]


def test_contracts(spark):
    df = spark.createDataFrame([("a", " ", None), ("b", "x", 3)], "id string, name string, n int")
    assert rows(C.defaults(df, {"name": F.lit("-"), "n": F.lit(0)})) == [("a", "-", 0), ("b", "x", 3)]
    assert rows(C.upsert(df, df.filter("id = 'a'").withColumn("n", F.lit(9)), ["id"]).select("id", "n")) == [("a", 9), ("b", 3)]
    with pytest.raises(ValueError, match="no papers"):
        C.not_empty(df.limit(0), "papers")
    with pytest.raises(Exception, match="not among"):
        C.train_cutoffs(df.select(F.col("id").alias("m")), "m", "zzz").collect()
    assert rows(C.train_cutoffs(df.select(F.col("id").alias("m")), "m")) == [("a", "b", True), ("b", "b", False)]
    with pytest.raises(ValueError, match="must not begin"):
        C.calendar_label(F.lit("2024-01"), "2024-06", "2024-01")
    with pytest.raises(ValueError, match="unsupported mode"):
        C.metric_reward("x", {"soft": F.lit(1.0)})
    with pytest.raises(ValueError, match="no strategy"):
        strategies.generate("x", df, df, 1)
    sets = spark.createDataFrame([("p", ["x", "y"]), ("q", ["y", "y", None]), ("r", [])], "k string, m array<string>")
    assert rows(C.community_overlap(sets, "k", "m", sets)) == [("p", 0.5), ("q", 1.0), ("r", 0.0)]
    errors = spark.createDataFrame([("s", "b", "bad"), ("s", "a", "worse"), ("s", "c", ""), ("t", "a", None)], "s string, t string, e string")
    assert rows(C.joined_errors(errors, ["s"], "t", F.col("e"))) == [("s", "a: worse; b: bad"), ("t", None)]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut.shared_dir(Session())
