"""Queries that write a table through a sink into the shared folder and read it back through a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as T
from skein.plans.cut import new_place
from skein.plans.scalar_queries import PAPERS, papers
from skein.sources import readers, sinks
from skein.sources.tables import table
from skein.streaming import incremental as R


def _samples(spark, d):
    return table(spark, d, "hindsight_samples").dropDuplicates(["sample_id"])


def _rows(spark, d):
    return table(spark, d, "dz_rows").dropDuplicates(["dz_id"])


def _ideas(spark, d):
    return table(spark, d, "idea_predictions").dropDuplicates(["pred_id"])


def _rendered(spark, d):
    none = F.array().cast("array<string>")
    p = papers(spark, d).filter("trim(title) <> '' and published is not null")
    text = sinks.markdown(F.col("paper_id"), F.trim(F.regexp_replace("title", r"\s+", " ")), F.col("published"), F.coalesce("keywords", none), F.concat(F.lit("https://papers.example.invalid/"), "paper_id"), F.trim(F.regexp_replace("summary", r"\s+", " ")), F.coalesce("refs", none))
    return p.select("paper_id", F.date_format("published", "yyyy-MM").alias("month"), text.alias("text"))


def markdown_store(spark, d):
    """Papers as Markdown in folders by month, parsed again."""
    place = new_place(spark)
    sinks.write_markdown(_rendered(spark, d), place)
    back = readers.parse_papers(readers.markdown_pages(spark, place))
    return back.select("paper_id", "title", "month", F.size("refs").alias("n_refs"))


def snapshot_store(spark, d):
    """A snapshot of ids and texts by month, parsed as papers."""
    place = new_place(spark)
    _rendered(spark, d).select(F.col("paper_id").alias("arxiv_id"), "text", "month").write.partitionBy("month").parquet(place)
    return readers.parse_papers(readers.monthly_snapshot(spark, place)).groupBy("month").agg(F.count("*").alias("n"))


def corpus_store(spark, d):
    """The corpus by month; only the months asked for are read, in the order of publication."""
    place = new_place(spark)
    sinks.write_corpus(papers(spark, d).filter("published is not null").select("paper_id", "published", "topic_id", F.date_format("published", "yyyy-MM").alias("month")), place)
    return readers.corpus(spark, place, "2024-03", "2024-08").select("paper_id", "published", "month")


def json_store(spark, d):
    """Training rows as lines of JSON with a spoilt line for every tenth, read back."""
    place = new_place(spark)
    fields = [f.name for f in readers.DZ_ROW.fields]
    _rows(spark, d).select(F.concat(F.when(F.col("dz_id") % 10 == 0, "{broken ").otherwise(""), F.to_json(F.struct(*fields))).alias("value")).write.text(place)
    back = readers.json_lines(spark, place, readers.DZ_ROW)
    return back.groupBy("topic_id").agg(F.count("*").alias("n"), F.count("target_z.gap").alias("gaps"), F.sum(F.size(F.coalesce("context_paper_ids", F.array().cast("array<string>")))).alias("context"))


def hindsight_store(spark, d):
    """Samples as lines of JSON, read back up to the last training cutoff."""
    place = new_place(spark)
    sinks.write_json_lines(_samples(spark, d).select(*(f.name for f in readers.SAMPLE.fields)), place)
    return readers.hindsight_samples(spark, place).groupBy("topic_id", "cutoff_date").agg(F.count("*").alias("n"))


def record_store(spark, d):
    """Strategy records as JSON with nested runs, read back."""
    place = new_place(spark)
    runs = _ideas(spark, d).filter("topic_id is not null").groupBy("strategy_id", "topic_id").agg(F.max("created_at").alias("at"))
    r = runs.groupBy(F.col("strategy_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("topic_id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error")))).alias("topic_runs"))
    sinks.write_json_lines(r.select("id", F.col("id").alias("name"), "topic_runs"), place)
    back = readers.records(spark, place, one_per_file=False)
    return back.select("id", F.size("topic_runs").alias("runs"), F.get("topic_runs", F.lit(0))["topic_id"].alias("first"))


def artifact_store(spark, d):
    """Result artifacts with nested topics and windows, written and flattened again."""
    place = new_place(spark)
    i = _ideas(spark, d).filter("topic_id is not null and cutoff_date is not null")
    w = i.groupBy("strategy_id", "topic_id", "cutoff_date").agg(F.count("*").alias("n"))
    t = w.groupBy("strategy_id", "topic_id").agg(F.collect_list(F.struct("cutoff_date", F.lit(0).cast("bigint").alias("train_count"), F.col("n").alias("future_count"), F.create_map(F.lit("n"), F.col("n").cast("double")).alias("evaluation"))).alias("windows"))
    a = t.groupBy(F.col("strategy_id").alias("strategy")).agg(F.lit("m").alias("model_name"), F.lit("test").alias("mode"), F.map_from_entries(F.collect_list(F.struct("topic_id", F.struct(F.col("topic_id").alias("topic_name"), "windows")))).alias("topic_results"))
    sinks.write_json_lines(a, place)
    back = readers.artifact_windows(spark, [place], one_per_file=False)
    return back.select("strategy", "topic_id", "cutoff_date", "future_count", F.col("evaluation")["n"].alias("n"))


def index_store(spark, d):
    """Vectors by kind and cutoff; one index is read."""
    place = new_place(spark)
    e = table(spark, d, "index_entries").dropDuplicates(["vec_id"]).withColumn("cutoff", F.coalesce(D.cutoff_date(F.col("cutoff_date")).cast("string"), F.lit("none")))
    sinks.write_index(e.select("vec_id", "kind", "cutoff", "paper_id", "embedding"), place)
    return readers.index(spark, place, "history", "2024-06-30").select("vec_id", "paper_id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("n"))


def memory_store(spark, d):
    """Memory snapshots of all cutoffs in one table; those of a year are read."""
    place = new_place(spark)
    m = _rows(spark, d).withColumn("cutoff", D.cutoff_date(F.col("cutoff_t"))).filter("cutoff is not null").groupBy("cutoff", "topic_id").agg(F.count("memory_text").alias("entries"))
    sinks.write_memory(m.withColumn("cutoff", F.col("cutoff").cast("string")), place)
    return spark.read.schema("topic_id string, entries bigint, cutoff string").parquet(place).filter("cutoff between '2024-01-01' and '2024-12-31'").select("cutoff", "topic_id", "entries")


def scored_pairs_store(spark, d):
    """Scored pairs as CSV with previews of 160 characters on one line."""
    place = new_place(spark)
    sinks.write_scored_pairs(_ideas(spark, d).select("pred_id", F.translate("rationale", '"\\\\', "").alias("idea"), "rank"), place)
    back = spark.read.schema("pred_id bigint, idea string, rank int").option("header", True).csv(place)
    return back.select("pred_id", "rank", F.length(F.trim(F.coalesce("idea", F.lit("")))).alias("n"))


def batch_store(spark, d):
    """Requests, the results of a first round in which some fail, and of a second for the failed only."""
    s = _samples(spark, d).filter("topic_id is not null and episode_id is not null and future_paper_id is not null").select("sample_id", "topic_id", "episode_id", F.col("future_paper_id").alias("paper_id"))
    none = spark.createDataFrame([], "custom_id string")
    asked = sinks.batch_requests(s, none, F.col("paper_id")).select("custom_id").distinct()
    n = F.conv(F.substring(F.md5("custom_id"), 1, 6), 16, 10).cast("bigint")

    def answered(ids, status):
        body = F.struct(F.array(F.struct(F.struct(F.lit("x").alias("content")).alias("message"))).alias("choices"))
        line = F.to_json(F.struct("custom_id", F.struct(status.alias("status_code"), body.alias("body")).alias("response")))
        return ids.select(line.alias("value"))

    place = new_place(spark)
    answered(asked, F.when(n % 5 == 0, 500).otherwise(200)).write.text(f"{place}/1")
    good, bad = readers.batch_results(spark.read.text(f"{place}/1"))
    answered(bad.select("custom_id"), F.when(n % 25 == 0, 500).otherwise(200)).write.text(f"{place}/2")
    again, _ = readers.batch_results(spark.read.text(f"{place}/2"))
    return R.retried(good, again, "custom_id").groupBy("topic_id").agg(F.count("*").alias("n"))


def training_store(spark, d):
    """Training rows and rubrics as files, read back under their schemas."""
    place = new_place(spark)
    z = _rows(spark, d).filter("target_z.gap is not null and topic_id is not null").select("dz_id", F.col("target_z.gap").alias("gap"), "topic_id")
    rows = sinks.training_rows(z, "dz", F.concat(F.lit("Topic: "), "topic_id"), F.col("gap"), ["dz_id"])
    sinks.write_training_rows(rows, f"{place}/rows", f"{place}/preview")
    rubrics = table(spark, d, "topics").select("topic_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), F.col("aliases").alias("operator_focus"), F.col("keywords").alias("criteria"))
    sinks.write_json_lines(rubrics, f"{place}/rubrics")
    back = spark.read.schema(readers.TRAINING_ROW).parquet(f"{place}/rows").select(F.substring("prompt", 8, 99).alias("topic_id"), T.short_hash(F.col("ground_truth")).alias("h"))
    last = readers.latest_rubrics(spark.read.schema(readers.RUBRIC).json(f"{place}/rubrics")).select("topic_id", "version")
    return back.join(last, "topic_id").groupBy("topic_id", "version").agg(F.count("*").alias("n"), F.min("h").alias("least"))


def cache_store(spark, d):
    """A cache of answers to which a second run appends only what it lacks."""
    place = new_place(spark)
    asked = _ideas(spark, d).select("pred_id")
    answer = lambda ids: ids.withColumn("answer", F.col("pred_id") % 4)
    R.remember(answer(asked.filter("pred_id % 3 = 0")), place)
    _, missing = R.cached(asked, spark.read.parquet(place), ["pred_id"])
    R.remember(answer(missing), place)
    hit, left = R.cached(asked, spark.read.parquet(place), ["pred_id"])
    return hit.groupBy("answer").agg(F.count("*").alias("n")).join(left.agg(F.count("*").alias("missing")))


_S = "s as (select distinct on (sample_id) * from hindsight_samples)"
_Z = "z as (select distinct on (dz_id) * from dz_rows)"
_I = "i as (select distinct on (pred_id) * from idea_predictions)"
_CUT = "try_cast(case when length(trim({0})) = 7 then trim({0}) || '-01' else trim({0}) end as date)"
SQL = {
    "markdown_store": f"with {PAPERS} select paper_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) title, strftime(published, '%Y-%m') as month, coalesce(len(refs), 0)::int n_refs from p where trim(title) <> '' and published is not null",
    "snapshot_store": f"with {PAPERS} select strftime(published, '%Y-%m') as month, count(*) n from p where trim(title) <> '' and published is not null group by 1",
    "corpus_store": f"with {PAPERS} select paper_id, published, strftime(published, '%Y-%m') as month from p where strftime(published, '%Y-%m') between '2024-03' and '2024-08'",
    "json_store": f"with {_Z} select topic_id, count(*) n, count(target_z.gap) gaps, sum(coalesce(len(context_paper_ids), 0))::bigint context from z where dz_id % 10 <> 0 group by 1",
    "hindsight_store": f"with {_S} select topic_id, cutoff_date, count(*) n from s where {_CUT.format('cutoff_date')} <= date '2024-03-31' group by 1, 2",
    "record_store": f"with {_I} select strategy_id id, count(distinct topic_id)::int runs, min(topic_id) as first from i where topic_id is not null group by 1",
    "artifact_store": f"with {_I} select strategy_id strategy, topic_id, cutoff_date, count(*) future_count, count(*)::double n from i where topic_id is not null and cutoff_date is not null group by all",
    "index_store": f"with e as (select distinct on (vec_id) * from index_entries) select vec_id, paper_id, coalesce(len(embedding), -1)::int n from e where kind = 'history' and {_CUT.format('cutoff_date')} = date '2024-06-30'",
    "memory_store": f"with {_Z}, c as (select *, {_CUT.format('cutoff_t')} c from z) select c::varchar cutoff, topic_id, count(memory_text) entries from c where year(c) = 2024 group by all",
    "scored_pairs_store": f"""with {_I}, c as (select pred_id, rank, trim(regexp_replace(translate(coalesce(rationale, ''), '"\\', ''), '\\s+', ' ', 'g')) t from i) select pred_id, rank, case when length(t) > 160 then length(rtrim(substr(t, 1, 157))) + 3 else length(t) end::int n from c""",
    "batch_store": f"with {_S}, a as (select distinct substr(topic_id || '|' || episode_id || '|' || future_paper_id, 1, 64) c from s where topic_id is not null and episode_id is not null and future_paper_id is not null) select split_part(c, '|', 1) topic_id, count(*) n from a where ('0x' || substr(md5(c), 1, 6))::bigint % 25 <> 0 group by 1",
    "training_store": f"with {_Z} select z.topic_id, 2 as version, count(*) n, min(substr(sha256(target_z.gap), 1, 16)) least from z join topics using (topic_id) where target_z.gap is not null and z.topic_id is not null group by 1",
    "cache_store": f"with {_I} select pred_id % 4 answer, count(*) n, 0::bigint missing from i group by 1",
}
QUERIES = {f.__name__: f for f in (markdown_store, snapshot_store, corpus_store, json_store, hindsight_store, record_store, artifact_store, index_store, memory_store, scored_pairs_store, batch_store, training_store, cache_store)}
