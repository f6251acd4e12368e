"""Operators against plain Python on small random input, and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import aggregates as A
from skein.operators import episodes as P
from skein.operators import folds, joins
from skein.operators import statistics as S
from skein.operators import windows as W
from skein.operators.components import components
from skein.operators.mapping import exact_map


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = [(0, i) for i in range(1, 200)]
    assert {c for _, c in rows(components(spark.createDataFrame(star, "a long, b long")))} == {0}


def test_greedy_match(spark):
    rng = random.Random(2)
    for trial in range(4):
        cands = [("w", r, f"p{p}", rng.choice([0.2, 0.5, 0.8])) for r in range(1, 6) for p in range(8) if rng.random() < 0.6]
        used, want = set(), []
        for r in range(1, 6):
            free = sorted(((s, p) for _, q, p, s in cands if q == r and p not in used), reverse=True)
            if free:
                used.add(free[0][1])
                want.append(("w", r, free[0][1], free[0][0]))
        got = rows(folds.greedy_match(spark.createDataFrame(cands, "w string, rank int, paper string, score double"), ["w"], 5))
        assert got == want, trial


def tok_jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a | b else 0.0


def test_greedy_dedupe(spark):
    rng = random.Random(3)
    items = [(g, i, " ".join(rng.choice("abcdef") for _ in range(4))) for g in range(3) for i in range(12)]
    want = []
    for g in range(3):
        kept = []
        for _, i, t in (x for x in items if x[0] == g):
            if not any(tok_jaccard(t, k) >= 0.8 for _, k in kept):
                want.append((g, i, len(kept)))
                kept.append((i, t))
    assert rows(folds.greedy_dedupe(spark.createDataFrame(items, "g int, i int, t string"), ["g"], ["i"], "i", F.col("t"), 0.8)) == want


def test_mmr(spark):
    rng = random.Random(4)
    items = [("g", i, round(rng.random(), 2), " ".join(rng.choice("abcdefgh") for _ in range(3))) for i in range(10)]
    pool = sorted(items, key=lambda x: (-x[2], x[1]))
    chosen = []
    while pool and len(chosen) < 4:
        def value(c):
            if not chosen:
                return c[2]
            return round(0.65 * c[2] + 0.35 * (1 - max(tok_jaccard(c[3], x[3]) for x, _ in chosen)), 9)

        best = max(pool, key=lambda c: (value(c), -pool.index(c)))
        chosen.append((best, value(best)))
        pool.remove(best)
    got = rows(folds.mmr_select(spark.createDataFrame(items, "g string, i int, s double, t string"), ["g"], "i", "s", F.col("t"), 4))
    assert [r[1] for r in sorted(got, key=lambda r: r[2])] == [c[1] for c, _ in chosen]


def test_ema_and_split(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 0.5), ("b", 1, 2.0)], "k string, t int, v double")
    assert rows(folds.ema(df, ["k"], ["t"], "v")) == [("a", 2, round(0.15 + 0.3 * (1 - 0.15), 6)), ("b", 1, 0.6)]
    sizes = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 3)], "k string, n long")
    assert rows(folds.balanced_split(sizes, "k", "n", 2)) == [("a", 0), ("b", 1), ("c", 1), ("d", 0)]


def test_search_states(spark):
    acts = [("x", 0, "search", ["p"]), ("x", 1, "select", ["q"]), ("x", 2, "select", ["p"]), ("x", 3, "finish", []), ("x", 4, "search", ["r"])]
    assert rows(folds.search_states(spark.createDataFrame(acts, "k string, step int, type string, ids array<string>"), "k", 2, 2)) == [("x", 1, "p", 1, True, 2)]


def test_auc_and_ranks(spark):
    rng = random.Random(5)
    data = [("g", rng.randrange(6), rng.randrange(2)) for _ in range(60)] + [("one", 1, 1), ("one", 2, None)]
    got = {r.g: r.auc for r in S.auc(spark.createDataFrame(data, "g string, v int, y int"), "v", "y", ["g"]).collect()}
    pos, neg = [v for g, v, y in data if g == "g" and y == 1], [v for g, v, y in data if g == "g" and y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got["g"] == pytest.approx(want, abs=1e-6) and got["one"] == 0.5


def test_mann_whitney_p(spark):
    df = spark.createDataFrame([(v, v > 3) for v in range(8)], "v int, f boolean")
    r = S.mann_whitney(df, "v", F.col("f"), []).first()
    mu, sd = 8.0, math.sqrt(16 / 12 * 9)
    assert r.u == 16 and r.p == pytest.approx(0.5 * math.erfc((16 - mu - 0.5) / sd / math.sqrt(2)), abs=1e-6)


def test_spearman_degenerate(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 3.0), ("r", 1.0, 1.0), ("r", 2.0, 5.0)], "g string, x double, y double")
    assert {r.g: r.rho for r in S.spearman(df, "x", "y", ["g"]).collect()} == {"c": 0.0, "r": 1.0}


def test_advantage_of_constant_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 2.0)], "g string, r double")
    assert sorted(r.advantage for r in S.group_advantage(df, ["g"], "r").collect()) == [-1.0, 0.0, 0.0, 1.0]


def test_wasserstein(spark):
    df = spark.createDataFrame([(0.0, False), (1.0, False), (2.0, True), (3.0, True)], "v double, s boolean")
    assert S.wasserstein(df, "v", F.col("s")).first()[0] == 2.0


def test_windows_on_the_cutoff(spark):
    day = [("t", i, d, 1.0) for i, d in enumerate(["2024-01-01", "2024-01-02", "2024-02-01", "2024-03-31", "2024-04-01"])]
    corpus = spark.createDataFrame(day, "topic string, paper_id int, d string, score double").select("topic", "paper_id", F.to_date("d").alias("published"), "score")
    got = {str(r.cutoff): (r.train_n, r.future_n) for r in W.split_counts(corpus, 2, 1).collect()}
    assert got == {"2024-01-01": (1, 3), "2024-02-01": (3, 2)}


def test_midpoint_sample(spark):
    df = spark.createDataFrame([("g", i) for i in range(23)] + [("h", 1)], "g string, i int")
    got = rows(A.midpoint_sample(df, ["g"], ["i"], 5))
    assert got == [("g", int((s + 0.5) / 5 * 23)) for s in range(5)] + [("h", 1)]


def test_weighted_rollup_counts_missing_as_zero(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, None), ("z", 0, 1.0)], "g string, w long, m double")
    assert rows(A.weighted_rollup(df, ["g"], "w", ["m"])) == [("a", 4, 0.25), ("z", 0, 0.0)]


def test_clusters(spark):
    kw = [(d, k) for d in range(3) for k in ("a", "b")] + [(9, "c"), (8, "c"), (7, "c")]
    got = rows(A.keyword_clusters(spark.createDataFrame(kw, "d int, kw string"), "d", 3, 12))
    assert got == [("a", "a|b", 6), ("c", "c", 3)]


def test_phrase_join_needs_whole_tokens(spark):
    docs = spark.createDataFrame([(1, "the red-fox runs"), (2, "infrared fox"), (3, None)], "id int, t string")
    topics = spark.createDataFrame([("t1", "Red Fox", None, ["runs"]), ("t2", "fox", [], None)], "topic_id string, topic_name string, aliases array<string>, keywords array<string>")
    assert rows(joins.phrase_join(docs, "id", F.col("t"), joins.topic_terms(topics))) == [(1, "t1"), (1, "t2"), (2, "t2")]


def test_exact_map(spark):
    df = spark.createDataFrame([(" Foo ",), ("bar",), (None,), ("",)], "v string")
    names = spark.createDataFrame([("foo", "b"), ("FOO", "a")], "n string, t string")
    assert sorted(r.mapped for r in exact_map(df, "v", names, "n", "t", "other").collect()) == ["a", "other", "other", "other"]


def test_counts_asof_and_pairs(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 2), (4, "b", 5), (5, None, 1)], "k int, g string, m int")
    assert [(r.k, r.earlier) for r in P.counts_asof(df, ["g"], "m", "k").orderBy("k").collect()] == [(1, 0), (2, 1), (3, 1), (4, 0), (5, 0)]
    pairs = P.label_pairs(spark.createDataFrame([(i, "g", f"i{i}", f"c{i}") for i in range(3)], "k int, g string, idea string, cand string"), "g", "k", "idea", "cand")
    assert sorted((r.k, r.label, r.cand) for r in pairs.collect()) == [(0, 0, "c1"), (0, 1, "c0"), (1, 0, "c2"), (1, 1, "c1"), (2, 0, "c0"), (2, 1, "c2")]


def test_all_empty(spark):
    e = spark.createDataFrame([], "g string, i int, v double, t string, y int")
    assert S.auc(e, "v", "y", ["g"]).count() == 0 and S.group_advantage(e, ["g"], "v").count() == 0
    assert A.midpoint_sample(e, ["g"], ["i"], 3).count() == 0 and folds.ema(e, ["g"], ["i"], "v").count() == 0
    assert folds.greedy_dedupe(e, ["g"], ["i"], "i", F.col("t")).count() == 0


def test_impact_and_thirds(spark):
    df = spark.createDataFrame([(4, 1.0), (5, 2.0), (50, 3.0), (None, 4.0)], "c int, v double")
    assert rows(S.impact_buckets(df, F.col("c"), F.col("v"))) == [("all", 1, 4.0), ("high", 1, 3.0), ("low", 1, 1.0), ("mid", 1, 2.0)]


def test_duplicate_penalty(spark):
    df = spark.createDataFrame([("g", 1, "alpha beta gamma"), ("g", 2, "alpha beta gamma"), ("g", 3, "delta epsilon"), ("h", 4, "alone here")], "g string, i int, t string")
    assert rows(folds.duplicate_penalty(df, ["g"], "i", F.col("t"), 0.85)) == [("g", 1, 1, 0.5), ("g", 2, 1, 0.5), ("g", 3, 0, 0.0), ("h", 4, 0, 0.0)]


def test_selection(spark):
    from skein.operators import selection as S2

    df = spark.createDataFrame([("g", 1, "2024-01-01"), ("g", 2, "2024-02-01"), ("g", 3, "2024-02-01"), (None, 4, "2023-01-01")], "g string, i int, d string")
    assert sorted(r.i for r in S2.latest(df, ["g"], "d").collect()) == [2, 3, 4]
    ctx = spark.createDataFrame([(1, ["b", "x", "a"]), (2, [])], "k int, ids array<string>")
    look = spark.createDataFrame([("a", "A"), ("b", None)], "id string, t string")
    assert {r.k: r.found for r in S2.materialized(ctx, "k", "ids", look, "id", "t").collect()} == {1: ["-", "A"], 2: []}
    s = spark.createDataFrame([(1, "t", 5, "p"), (2, "t", 5, None), (3, "t", 1, "p")], "sample_id int, topic_id string, m int, own string")
    e = spark.createDataFrame([("t", 1, "p", "x"), ("t", 2, "q", "x"), ("t", 3, None, "y"), ("t", 5, "q", "z")], "topic_id string, m int, source string, op string")
    assert {r.sample_id: r.memory for r in S2.memory_before(s, e, 2).collect()} == {1: "x:1|y:1", 2: "x:2", 3: ""}


def test_lexical_and_clusters(spark):
    from difflib import SequenceMatcher

    import numpy as np

    from skein.operators import lexical as L

    a, b = "a fast graph model " * 20, "A slow Graph model! " * 15
    df = spark.createDataFrame([(a, b), (None, ""), ("x", "x")], "a string, b string").select(L.sequence_ratio(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in df.collect()] == [SequenceMatcher(None, a.lower(), b.lower()).ratio(), 1.0, 1.0]
    x = np.concatenate([c + 0.01 * np.random.default_rng(1).standard_normal((5, 3)) for c in np.eye(3) * 9])
    labels = L.cluster_labels(x, 3)
    assert len(set(labels)) == 3 and all(len(set(labels[i : i + 5])) == 1 for i in (0, 5, 10))
    v = spark.createDataFrame([("w", i, [float(y) for y in row], i == 0) for i, row in enumerate(x)] + [("w", 99, None, True)], "g string, k int, v array<double>, m boolean")
    assert rows(L.cluster_coverage(v, ["g"], "k", "v", "m", 3)) == [("w", 3, 1, round(1 / 3, 4))]


def test_rewards(spark):
    from skein.operators import rewards as R

    closed, known = F.array(F.lit("scale")), F.array(F.lit("2301.00001"))
    text = "We scale the method of 2301.00001 to larger graphs and tokens."
    got = spark.range(1).select(
        R.gates(F.lit("short"), known, F.lit("scale"), closed), R.gates(F.lit(text + " [Other2020]"), known, F.lit("scale"), closed), R.gates(F.lit(text), known, F.lit(None).cast("string"), closed), R.gates(F.lit(text), known, F.lit("scale"), closed),
        R.adherence(F.lit(text), F.array(F.lit("scale"), F.lit("shrink")), F.lit("scale")), R.adherence(F.lit(text), F.lit(None).cast("array<string>"), F.lit("x9")), R.coherence(F.lit(" "), F.lit("a"), ["token"]), R.combined(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)),
    ).first()
    assert tuple(got) == ("format", "grounding", "operator", None, 0.5, 0.0, 0.0, 0.6)
