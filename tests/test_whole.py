"""Registered queries on small tables: nothing of the job is left out."""

import datetime
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest

from skein.operators.lexical import ratio
from skein.plans.registry import queries

IDEAS = "pred_id bigint, strategy_id string, topic_id string, cutoff_date string, rank int, title string, rationale string, approach string, score double, key_terms array<string>"
PAPERS = "paper_id string, title string, pub_month string, summary string, keywords array<string>, published_date string, topic_id string"


@pytest.fixture
def run(spark, tmp_path):
    """run(query, table=(rows, schema), ...): the rows of the query over these tables."""

    def of(query, **tables):
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return queries()[query](spark, str(tmp_path)).collect()

    return of


def idea(n, strategy="s", cutoff="2024-01-31", rank=1, title="t", rationale="", approach="", score=0.5, terms=()):
    return (n, strategy, "topic", cutoff, rank, title, rationale, approach, score, list(terms))


def paper(name, date, title="t", summary="", keywords=()):
    return (name, title, date[:7], summary, list(keywords), date, "topic")


def test_judged_match_judges_every_window(run):
    ideas = [idea(10 * s + r, f"s{s:02}", rank=6 - r) for s in range(12) for r in range(6)]
    papers = [paper(f"p{i}", "2024-03-10") for i in range(200)] + [paper(f"old{i}", "2023-12-10") for i in range(200)] + [paper(f"far{i}", "2024-05-10") for i in range(200)]
    got = run("judged_match", idea_predictions=(ideas, IDEAS), papers=(papers, PAPERS))
    assert {(r.strategy_id, r["rank"]) for r in got} == {(f"s{s:02}", k) for s in range(12) for k in range(1, 6)} and {r.cut for r in got} == {datetime.date(2024, 1, 31)}
    assert all(r.paper.startswith("p") for r in got)
    assert len({(r.strategy_id, r.paper) for r in got}) == len(got)


def test_strategy_leaderboard_holds_every_strategy(run):
    f = [(n, f"s{n:03}", "topic", "2024-01-31", 1, 0.5, n / 130, 0.5) for n in range(130)]
    got = run("strategy_leaderboard", scored_forecasts=(f, "forecast_id bigint, strategy_id string, topic_id string, cutoff_t string, rank int, prior_score double, realization_score double, joint_score double"))
    assert [r.strategy_id for r in got] == [x[1] for x in sorted(f, key=lambda x: (x[6] < 0.7, x[1]))]


def test_keyword_inverted_index_holds_every_paper(run):
    papers = [paper(f"p{i:02}", "2024-03-10", keywords=[" Graph", "graph", "few"][: 3 if i < 2 else 2]) for i in range(45)]
    assert [tuple(r) for r in run("keyword_inverted_index", papers=(papers, PAPERS))] == [("graph", f"p{i:02}", 45) for i in range(45)]


def test_flattened_ideas_holds_every_idea_in_order(run):
    ideas = [idea(n, f"s{n % 7}", f"2024-{n % 12 + 1:02}-28", n % 5) for n in range(260)]
    got = run("flattened_ideas", idea_predictions=(ideas, IDEAS))
    month = sorted(ideas, key=lambda x: (-int(x[3][5:7]), x[1], x[4], x[0]))
    assert [r.pred_id for r in got] == [x[0] for x in month]


def test_mmr_select_weighs_all_ideas_of_a_window(run):
    same = [idea(n, rank=n, title="same title", rationale="the same words", approach="again", score=0.9 - n / 1000) for n in range(30)]
    novel = idea(99, rank=99, title="same title", rationale="entirely other", approach="content here", score=0.8)
    other = [idea(200 + n, "s2", cutoff=f"2024-0{n + 1}-28") for n in range(3)]
    got = run("mmr_select", idea_predictions=([*same, novel, *other], IDEAS))
    assert sorted((r.strategy_id, str(r.cut), r.place, r.pred_id) for r in got) == [("s", "2024-01-31", 1, 0), ("s", "2024-01-31", 2, 99), ("s", "2024-01-31", 3, 1)] + [("s2", f"2024-0{n + 1}-28", 1, 200 + n) for n in range(3)]


def test_ratio_is_the_library_s():
    rng = random.Random(8)
    for n in (0, 1, 5, 60, 199, 200, 260, 500):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz  ", "".join(map(chr, range(97, 400)))):
            for _ in range(4):
                a, b = ("".join(rng.choice(letters) for _ in range(m)) for m in (rng.randrange(400), n))
                b = a[20:90] + b if rng.random() < 0.5 else b
                assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_two_stage_retrieval_finds_all_papers_up_to_the_cutoff(run):
    rng = random.Random(9)
    words = [f"w{x}" for x in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    papers = [paper(f"p{n:03}", f"2023-{n % 12 + 1:02}-15", text(3), text(30), [text(1)]) for n in range(150)]
    ideas = [idea(n, cutoff=f"2023-{n % 12 + 1:02}-20", title=text(4), rationale=text(20), approach=text(10), terms=[text(1), " "]) for n in range(30)]
    want = set()
    for i in ideas:
        a = f"{i[5]} {i[6]} {i[7]} {i[9][0]}"
        rated = []
        for p in papers:
            b = f"{p[1]}\n\nKeywords: {p[4][0]}\n\n{p[3]}"
            x, y = set(a.split()), set(re.findall(r"\w+", b.lower()))
            if p[5] <= i[3] and x & y:
                rated.append((-len(x & y) / min(len(x), len(y)), -len(x & y) / len(x | y), p[0], round(0.65 * len(x & y) / len(x | y) + 0.35 * SequenceMatcher(None, a, b.lower()).ratio(), 6)))
        best = sorted((-s, p) for _, _, p, s in sorted(rated)[:50])
        want |= {(i[0], p, -s, n) for n, (s, p) in enumerate(best[:3], 1) if -s >= 0.1}
    got = run("two_stage_retrieval", idea_predictions=(ideas, IDEAS), papers=(papers, PAPERS))
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 90


def test_vectors_of_all_labels_are_compared(run):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 6)).astype(np.float32)
    x[650] = x[0] + 0.001
    label = [9 if n == 650 else int(rng.integers(10)) for n in range(700)]
    vectors = [(n, [float(y) for y in x[n]], label[n]) for n in range(700)]
    got = {r.a: r.novelty for r in run("vector_novelty", embeddings=(vectors, "vec_id bigint, embedding array<float>, label int"))}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cos = unit @ unit.T - 9 * np.eye(700)
    assert got == {n: pytest.approx(1 - max(cos[n].max(), 0), abs=1e-5) for n in range(0, 700, 50)} and got[0] < 0.001
    d, odd = ((x.astype(float)[:, None] - x.astype(float)[None]) ** 2).sum(2), np.array(label) % 2 == 1
    h = np.median(d) / 2
    g, off = np.exp(-d / h / 2), ~np.eye(700, dtype=bool)
    want = g[np.ix_(~odd, ~odd)][off[np.ix_(~odd, ~odd)]].mean() + g[np.ix_(odd, odd)][off[np.ix_(odd, odd)]].mean() - 2 * g[np.ix_(odd, ~odd)].mean()
    assert tuple(run("mmd_rbf")[0]) == (pytest.approx(want, abs=2e-6), pytest.approx(h, abs=2e-6))


def test_whole_texts_are_compared(run):
    known = "graph encoders lose track of rare nodes when budgets shrink"
    ideas = [idea(1, rank=2, title="alpha", rationale=known, terms=["zeta"]), idea(2, rank=1, title="beta", rationale="nothing like it"), *(idea(n, rank=n, title=f"gamma{n}") for n in range(3, 7)), idea(0, rank=9, title="omega")]
    papers = [paper("old", "2024-01-10", "Another title", known, ["Budgets"]), paper("new", "2024-02-20", "Yet another", known)]
    text = {i[0]: " ".join([*i[5:8], *i[9]]).strip() for i in ideas}
    like = lambda a, b: 0.65 * len(set(re.findall(r"\w+", a)) & set(re.findall(r"\w+", b))) / len(set(re.findall(r"\w+", a)) | set(re.findall(r"\w+", b))) + 0.35 * SequenceMatcher(None, a, b).ratio()
    old = f"another title\n\nkeywords: budgets\n\n{known}"
    tables = {"idea_predictions": (ideas, IDEAS), "papers": (papers, PAPERS)}
    assert {r.pred_id: r.novelty for r in run("novelty_of_ideas", **tables)} == {n: pytest.approx(1 - like(t, old), abs=1e-5) for n, t in text.items()}
    assert [(r.q, r.p) for r in run("overlap_retrieval_topk") if r.place == 1 and r.q == 1] == [(1, "new")]
    assert [r.paper for r in run("greedy_match")] == ["new"]
    first = [text[n] for n in (2, 1, 3, 4, 5)]
    pairs = [1 - like(a, b) for n, a in enumerate(first) for b in first[n + 1 :]]
    assert run("lexical_diversity")[0].diversity == pytest.approx(sum(pairs) / len(pairs), abs=1e-4)
    assert {r.pred_id for r in run("base_scores") if r.base > 0.5} == {1}
