"""Retrieval over many pairs of texts: the registered queries against plain Python, and in time."""

import random
import re
import time
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from test_whole import IDEAS, PAPERS, idea, paper, run  # noqa: F401

WORDS = [f"{a}{b}{c}" for a in ("ab", "con", "tri", "ver") for b in ("ra", "lo", "mi", "qua") for c in ("tion", "x", "ing", "able", "7")] + ["the", "of", "and", "é", "😀"]


def _texts(seed, n, m):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    papers = [paper(f"p{x:04}", f"2023-{x % 12 + 1:02}-15", text(3), text(rng.choice((3, 12, 60))), [text(1)]) for x in range(m)]
    return [idea(x, cutoff=f"2023-{x % 12 + 1:02}-20", title=text(4), rationale=text(40), approach=text(20), terms=[text(1)]) for x in range(n)], papers


def _idea_text(i):
    return f"{i[5]} {i[6]} {i[7]} {i[9][0]}"


def _paper_text(p):
    return f"{p[1]}\n\nkeywords: {p[4][0]}\n\n{p[3]}"


def _likeness(a, b):
    x, y = set(re.findall("[a-z0-9]+", a)), set(re.findall("[a-z0-9]+", b))
    return 0.65 * len(x & y) / len(x | y) + 0.35 * SequenceMatcher(None, a, b).ratio()


def test_novelty_of_ideas_compares_many_pairs_in_time(run):  # noqa: F811
    ideas, papers = _texts(4, 900, 900)
    began = time.time()
    got = {r.pred_id: r.novelty for r in run("novelty_of_ideas", idea_predictions=(ideas, IDEAS), papers=(papers, PAPERS))}
    took = time.time() - began
    assert len(got) == 900 and took < 40
    for i in ideas[:900:180]:
        assert got[i[0]] == pytest.approx(1 - max(_likeness(_idea_text(i), _paper_text(p)) for p in papers if p[5] <= i[3]), abs=1.1e-5)


def test_java_s_ratio_is_the_library_s(spark):
    from skein.operators import lexical
    from skein.plans.jvm import java_class

    ratio = next(m for m in java_class(spark, Path(lexical.__file__).with_name("Lexical.java")).getMethods() if m.getName() == "ratio")
    args, rng = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 2), random.Random(8)
    for n in (0, 1, 2, 60, 199, 200, 310, 500):
        for letters in ("ab", "abc ", "abcdefghijklmnopqrstuvwxyz  ", "".join(map(chr, range(97, 400))), "aé😀bcd "):
            for _ in range(6):
                a, b = ("".join(rng.choice(letters) for _ in range(m)) for m in (rng.randrange(500), n))
                b = a[20:90] + b if rng.random() < 0.5 else b
                args[0], args[1] = a, b
                assert ratio.invoke(None, args) == SequenceMatcher(None, a, b).ratio()


def test_overlap_retrieval_writes_no_pairs(run):  # noqa: F811
    rng = random.Random(5)
    common = [f"w{x}" for x in range(40)]
    text = lambda: " ".join(rng.sample(common, 40))
    papers = [paper(f"p{x:04}", "2023-05-15", f"own{x}", f"{text()} {'a b c d e f g h' if x % 2 else ''}") for x in range(3000)]
    ideas = [idea(x, title=f"own{x % 3000}", rationale=text(), approach=f"un{x} known{x}") for x in range(3000)]
    began = time.time()
    got = run("overlap_retrieval_topk", idea_predictions=(ideas, IDEAS), papers=(papers, PAPERS))
    assert len(got) == 9000 and time.time() - began < 30
    # 43 words against 42 or 50 with "keywords"; 41 of them shared with the paper of the same name, else 40
    for r in got:
        own, even = r.q % 3000 if r.q % 2 == 0 else None, [f"p{x:04}" for x in (0, 2, 4)]
        want = [f"p{own:04}", *(x for x in even if x != f"p{own:04}")] if own is not None else None
        if want:
            assert r.p == want[r.place - 1] and r.common == (41 if r.place == 1 else 40) and r.overlap == round(r.common / 42, 6)
        elif r.place == 1:
            assert r.p == "p0000" or r.p == f"p{r.q:04}"


def test_overlap_s_halves_round_up(run):  # noqa: F811
    words = [f"x{n}" for n in range(128)]
    papers = [paper(f"p{n}", "2023-05-15", " ".join(words[:127]), "", []) for n in range(2)]
    ideas = [idea(1, title=" ".join([words[0], *(f"y{n}" for n in range(200))]))]
    got = run("overlap_retrieval_topk", idea_predictions=(ideas, IDEAS), papers=(papers, PAPERS))
    # 127 words and "keywords": 1 of 128 is 0.0078125
    assert [(r.p, r.common, r.overlap, r.place) for r in got] == [("p0", 1, 0.007813, 1), ("p1", 1, 0.007813, 2)]


def test_two_stage_retrieval_rescores_many_candidates_in_time(run):  # noqa: F811
    ideas, papers = _texts(6, 5000, 200)
    began = time.time()
    got = run("two_stage_retrieval", idea_predictions=(ideas, IDEAS), papers=(papers, PAPERS))
    assert time.time() - began < 30
    found = {(r.q, r.place): (r.p, r.score) for r in got}
    for i in ideas[:5000:500]:
        a, rated = _idea_text(i), []
        x = set(re.findall("[a-z0-9]+", a))
        for p in papers:
            y = set(re.findall("[a-z0-9]+", _paper_text(p)))
            if p[5] <= i[3] and x & y:
                rated.append((-len(x & y) / min(len(x), len(y)), -len(x & y) / len(x | y), p[0], _paper_text(p)))
        best = sorted((-round(_likeness(a, text), 6), p) for _, _, p, text in sorted(rated)[:50])[:3]
        assert [found[i[0], n] for n in (1, 2, 3)] == [(p, pytest.approx(-s, abs=1e-9)) for s, p in best]


def test_two_stage_retrieval_sends_documents_to_few_blocks(run, monkeypatch):  # noqa: F811
    from pyspark.sql import functions as F
    from pyspark.sql.classic.dataframe import DataFrame

    from skein.operators import lexical

    sent, repartition = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, *parts: sent.append(df) or repartition(df, *parts))
    monkeypatch.setattr(lexical, "tasks", lambda _: 3)
    monkeypatch.setattr(lexical, "LEAST_PAIRS", 1)
    # words that all documents share, more than a byte can count, and long and short documents
    rng = random.Random(7)
    common = " ".join(f"w{x}" for x in range(280))
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    papers = [paper(f"p{x:04}", "2023-05-15", text(3), f"{common if x % 3 else ''} {text(rng.choice((2, 12, 30)))}", [text(1)]) for x in range(300)]
    ideas = [idea(x, title=text(4), rationale=common if x % 2 else text(40), approach=text(20), terms=[text(1)]) for x in range(20)]
    got = {(r.q, r.place): (r.p, r.score) for r in run("two_stage_retrieval", idea_predictions=(ideas, IDEAS), papers=(papers, PAPERS))}
    both = next(df for df in sent if "doc" in df.columns)
    assert both.filter(F.col("query").isNotNull()).count() == 20 and both.filter(F.col("doc").isNotNull()).count() == 6 * 300
    for i in ideas[:20:3]:
        a, rated = _idea_text(i), []
        x = set(re.findall("[a-z0-9]+", a))
        for p in papers:
            y = set(re.findall("[a-z0-9]+", _paper_text(p)))
            rated.append((-len(x & y) / min(len(x), len(y)), -len(x & y) / len(x | y), p[0], _paper_text(p)))
        best = sorted((-round(_likeness(a, text), 6), p) for _, _, p, text in sorted(rated)[:50])[:3]
        assert [found for n in (1, 2, 3) if (found := got.get((i[0], n)))] == [(p, pytest.approx(-s, abs=1e-9)) for s, p in best if -s >= 0.1]
