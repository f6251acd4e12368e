"""Scalars against hand-computed values."""

import datetime

from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as T
from skein.functions import vectors as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_months(spark):
    lit = F.lit
    got = one(spark, *(D.normalize_month(lit(x)) for x in ("2024-03", " 2024-03-15 ", "2403", "2413", "x", "")), D.normalize_month(lit(None).cast("string")))
    assert got == ("2024-03", "2024-03", "2024-03", None, None, None, None)
    assert one(spark, D.shift_month(lit("2024-11"), 3), D.shift_month(lit("2024-01"), -1), D.shift_month(lit(None).cast("string"), 1)) == ("2025-02", "2023-12", None)


def test_month_only_dates(spark):
    last, first = one(spark, D.published_date(F.lit("2024-02")), D.cutoff_date(F.lit("2024-02")))
    assert (last, first) == (datetime.date(2024, 2, 29), datetime.date(2024, 2, 1))
    assert one(spark, D.published_date(F.lit("2024-02-30")), D.published_of_paper(F.lit(""), F.lit("2301.00000001"), F.lit(None).cast("string"))) == (None, datetime.date(2023, 1, 31))


def test_lead_time_bounds(spark):
    day = lambda s: F.lit(s).cast("date")
    got = one(spark, *(D.lead_time_fraction(day(p), day("2024-01-01"), day("2024-01-11")) for p in ("2024-01-01", "2024-01-06", "2024-02-01", "2023-01-01")), D.lead_time_fraction(day(None), day("2024-01-01"), day("2024-01-11")))
    assert got == (0.0, 0.5, 1.0, 0.0, 0.0)


def test_set_similarity_empty_rules(spark):
    a, b, none = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y")), F.array().cast("array<string>")
    assert one(spark, T.jaccard(a, b), T.jaccard(a, none), T.jaccard(none, none), T.jaccard(none, none, 1.0), T.overlap(a, b), T.overlap(a, none)) == (0.5, 0.0, 0.0, 1.0, 1.0, 0.0)


def test_tokens_split_at_accents(spark):
    assert one(spark, T.tokens(F.lit("Réseau-42 Ünit"))) == (["r", "seau", "42", "nit"],)


def test_scores(spark):
    got = one(spark, *(T.coerced_score(F.lit(x)) for x in ("7", "0.5", "-1", "99", "abc")), T.coerced_score(F.lit(None).cast("double")))
    assert got == (0.7, 0.5, 0.0, 1.0, None, None)


def test_judge_replies(spark):
    good, part, none = "<think>\nPROBLEM_MATCH: 1</think>\nPROBLEM_MATCH: 3\nMETHOD_MATCH: 2/3\nSPECIFICITY:2", "SPECIFICITY: 9", ""
    assert one(spark, T.judged(F.lit(good), "PROBLEM_MATCH"), T.judged(F.lit(good), "METHOD_MATCH"), T.judged(F.lit(good), "SPECIFICITY")) == (3, None, 2)
    assert one(spark, T.judged(F.lit(part), "SPECIFICITY"), T.judged(F.lit(part), "SPECIFICITY", True), T.judged(F.lit(none), "SPECIFICITY", True)) == (None, 3, 0)
    assert one(spark, T.free_score(F.lit("Score: 1.7")), T.free_score(F.lit("none"))) == (1.0, 0.0)


def test_prediction_shapes(spark):
    item = '{"rank": 1, "title": "A", "score": 0.5}'
    for reply, n in ((f"[{item}, {item}]", 2), (f'ok {{"ideas": [{item}]}} end', 1), (f'{{"predictions": [{item}]}}', 1), (item, 1), ("nothing", 0), ("{broken", 0), ('[{"rank": 1, "title": " "}]', 0)):
        assert one(spark, F.size(T.predictions(F.lit(reply)))) == (n,), reply


def test_markdown_parts(spark):
    md = "# A title\n\nPaper ID: 2301.1\nDate: 2023-01-05\nKeywords: b, a\n\n# Abstract\nFirst  line\nsecond.\n\n# References\n[1] One\ngoes on\n[2] Two\n"
    title, meta, summary, refs = one(spark, T.h1_title(F.lit(md)), T.preamble(F.lit(md)), T.summary(F.lit(md)), T.bibliography(F.lit(md)))
    assert title == "A title" and meta == {"paper_id": "2301.1", "date": "2023-01-05", "keywords": "b, a"}
    assert summary == "First line\nsecond." and refs == ["One goes on", "Two"]


def test_summary_cascade(spark):
    head = "# A title\n\nPaper ID: 2301.1\nDate: 2023-01-05\n\n"
    cases = {
        head + "Some text  here.\n\nMore of it.\n\n## Intro\nno": "Some text here.\n\nMore of it.",
        head + "By nobody\n\nAbstract - We show\nthings.\n\nAnd more.\n\n# Intro\nno": "We show\nthings.\n\nAnd more.",
        head + "## Intro\nbody\n\n## References\n[1] x": "## Intro\nbody",
        head + "x" * 2000: "x" * 1500,
        head + "## Abstract\na\n## Summary\ns": "s",
        "# only a title": None,
    }
    for md, want in cases.items():
        assert one(spark, T.summary(F.lit(md))) == (want,), md


def test_keywords_fall_back_to_title(spark):
    none = F.array().cast("array<string>")
    assert one(spark, T.keyword_list(F.array(F.lit(" B "), F.lit("a"), F.lit("b")), F.lit("x")), T.keyword_list(none, F.lit("The red of Red fox 3dview over")), T.keyword_list(F.lit(None).cast("array<string>"), F.lit(None).cast("string"))) == (["a", "b"], ["red", "fox", "dview"], [])


def test_citations(spark):
    assert one(spark, T.citations(F.lit("2301.00000001")), T.citations(F.lit("2301.00000001"), 8)) == ([], ["2301.00000001"])
    assert one(spark, T.citations(F.lit("see arXiv:2301.00001, [Smith2020] and 10.1000/x.y or 2301.00001"))) == (["2301.00001", "Smith2020", "10.1000/x.y"],)


def test_cosine(spark):
    vec = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    assert one(spark, V.cosine(vec(1.0, 0.0), vec(-2.0, 0.0)), V.clamped_cosine(vec(1.0, 0.0), vec(-2.0, 0.0)), V.cosine(vec(0.0, 0.0), vec(1.0, 1.0)), V.squared_distance(vec(1.0, 2.0), vec(3.0, 2.0))) == (-1.0, 0.0, 0.0, 4.0)


def test_match_rules(spark):
    lit = F.lit
    assert one(spark, V.judged_match(lit(3), lit(2), lit(2)), V.strict_match(lit(3), lit(2), lit(2)), V.judged_match(lit(3), lit(1), lit(3)), V.joint_score([(lit(None).cast("double"), 1.0), (lit(0.8), 1.0)]), V.clamp(lit(None).cast("double"))) == (True, False, False, 0.4, None)
