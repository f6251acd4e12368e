"""Readers, writers and incremental runs on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from skein.sources import readers, sinks
from skein.streaming import incremental as R

MD = "# Title of {0}\n\nPaper ID: {0}\nDate: {1}\nKeywords: b, a\n\n# Abstract\nSome text.\n\n# References\n[1] One\n[2] Two\n"


def test_markdown_tree(spark, tmp_path):
    for month, name, date in (("2023-01", "2301.00001", "2023-01-05"), ("2023-02", "2302.00002", "")):
        (tmp_path / month).mkdir()
        (tmp_path / month / f"{name}.md").write_text(MD.format(name, date))
    (tmp_path / "2023-01" / "README.md").write_text("# skip me")
    (tmp_path / "2023-01" / "blank.md").write_text("  \n")
    (tmp_path / "nodate.md").write_text("no month at all")
    papers = readers.parse_papers(readers.markdown_files(spark, str(tmp_path)))
    got = {r.paper_id: r for r in papers.collect()}
    assert set(got) == {"2301.00001", "2302.00002"}
    assert str(got["2302.00002"].published) == "2023-02-28" and got["2301.00001"].keywords == ["a", "b"] and got["2301.00001"].refs == ["One", "Two"]
    sinks.write_corpus(papers, str(tmp_path / "corpus"))
    assert [r.paper_id for r in readers.corpus(spark, str(tmp_path / "corpus"), "2023-02", "2023-12").collect()] == ["2302.00002"]


def test_atom(spark, tmp_path):
    feed = '<?xml version="1.0"?><feed><entry><id>http://x/abs/1v2</id><title>A\n b</title><published>2024-01-01</published><category term="z"/><category term="a"/></entry><entry><id>2</id><title/></entry></feed>'
    (tmp_path / "f.xml").write_text(feed)
    assert [r.keywords for r in readers.atom_table(spark, str(tmp_path / "f.xml")).collect()] == [["a", "z"]]
    e = spark.createDataFrame([(feed,)], "x string").select(F.explode(readers.atom_entries(F.col("x"))).alias("e")).collect()
    assert [(r.e.id, r.e.title, r.e.keywords) for r in e] == [("1", "A b", ["a", "z"])]


def test_json_lines(spark, tmp_path):
    rows = [{"topic_id": "t", "cutoff_date": c, "future_paper_id": p} for c, p in (("2024-03-31", "b"), ("2024-03", "a"), ("2024-04-01", "c"))]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n{broken\n")
    assert [r.future_paper_id for r in readers.hindsight_samples(spark, str(tmp_path / "s.jsonl")).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="MALFORMED"):
        readers.json_lines(spark, str(tmp_path / "s.jsonl"), readers.SAMPLE, strict=True).collect()


def test_artifacts_and_records(spark, tmp_path):
    art = {"strategy": "s", "model_name": "m", "topic_results": {"t1": {"topic_name": "T", "windows": [{"cutoff_date": "2024-01-01", "train_count": 3, "future_count": 1, "evaluation": {"hit": 1.0}}]}}}
    (tmp_path / "a.json").write_text(json.dumps(art))
    (tmp_path / "b.json").write_text("{")
    got = readers.artifact_windows(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).collect()
    assert [(r.strategy, r.topic_id, r.train_count, r.evaluation) for r in got] == [("s", "t1", 3, {"hit": 1.0})]


def test_batch_results(spark):
    ok = {"custom_id": "t|e|p", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "x"}}]}}}
    lines = [json.dumps(ok), json.dumps({"custom_id": "u", "response": {"status_code": 500}}), "{"]
    good, bad = readers.batch_results(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.topic_id, r.episode_id, r.paper_id, r.content) for r in good.collect()] == [("t", "e", "p", "x")]
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "status 500"]


def test_csv_preview(spark, tmp_path):
    sinks.write_scored_pairs(spark.createDataFrame([("a\nb" * 100, 0.5)], "idea string, s double"), str(tmp_path / "c"))
    row = spark.read.csv(str(tmp_path / "c"), header=True).first()
    assert len(row.idea) <= 160 and "\n" not in row.idea


def test_ingest(spark):
    e = spark.createDataFrame([("a", "2024-01-10"), ("a", "2024-01-11"), ("b", "2023-01-01"), ("c", "2024-01-10")], "id string, u string").withColumn("u", F.to_timestamp("u"))
    known = spark.createDataFrame([("c",)], "id string")
    got = R.ingest(e, known, "id", "u", F.lit("2024-01-12").cast("timestamp"), 7).collect()
    assert [(r.id, str(r.u)[:10]) for r in got] == [("a", "2024-01-11")]


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    data, place = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double").coalesce(1).write.parquet(data)

    def run():
        stream = spark.readStream.schema("k string, v double").parquet(data)
        return sorted(tuple(r) for r in R.partial_counts(stream, [F.col("k")], {"s": F.col("v")}, place).collect())

    assert run() == [("x", 1, 1.0), ("y", 1, 2.0)]
    spark.createDataFrame([("x", 5.0)], "k string, v double").coalesce(1).write.mode("append").parquet(data)
    assert run() == [("x", 2, 6.0), ("y", 1, 2.0)]


def test_pending_refuses_other_configuration(spark):
    w = spark.createDataFrame([(1,), (2,)], "k int")
    done = spark.createDataFrame([(1, "f")], "k int, fingerprint string")
    assert [r.k for r in R.pending(w, done, ["k"], "f").collect()] == [2]
    with pytest.raises(Exception, match="another configuration"):
        R.pending(w, done, ["k"], "g").collect()
