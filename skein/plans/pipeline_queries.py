"""Queries over readers, writers, incremental runs and pipeline steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import aggregates as A
from skein.operators import episodes as P
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


def markdown_round_trip(spark, d):
    """Papers rendered as Markdown and parsed again."""
    p = papers(spark, d).filter("title is not null and trim(title) <> ''")
    none = F.array().cast("array<string>")
    clean = F.trim(F.regexp_replace("title", r"\s+", " "))
    text = sinks.markdown(F.col("paper_id"), clean, F.col("published"), F.coalesce("keywords", none), F.concat(F.lit("https://papers.example.invalid/"), "paper_id"), F.trim(F.regexp_replace("summary", r"\s+", " ")), F.coalesce("refs", none))
    files = p.select(F.concat(F.date_format("published", "yyyy-MM"), F.lit("/"), "paper_id", F.lit(".md")).alias("path"), text.alias("text"))
    back = readers.parse_papers(files)
    return back.select("paper_id", "title", "month", "published", F.length("summary").alias("summary_n"), F.array_join("keywords", "|").alias("keywords"), F.size("refs").alias("n_refs"))


def atom_entries(spark, d):
    """Papers as entries of an Atom feed, parsed again; those without title or date are dropped."""
    p = papers(spark, d)
    esc = lambda c: F.coalesce(F.translate(c, "<>&", "   "), F.lit(""))
    cats = F.array_join(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.concat(F.lit('<category term="'), F.translate(k, '<>&"', "    "), F.lit('"/>'))), "")
    feed = F.concat(F.lit("<feed><entry><id>http://papers.example.invalid/abs/"), "paper_id", F.lit("v2</id><title>"), esc(F.col("title")), F.lit("</title><summary>"), esc(F.col("summary")), F.lit("</summary><published>"), F.coalesce("published_date", F.lit("")), F.lit("</published>"), cats, F.lit("</entry></feed>"))
    e = p.select(F.explode(readers.atom_entries(feed)).alias("e"))
    return e.select(F.col("e.id").alias("id"), F.col("e.title").alias("title"), F.size("e.keywords").alias("n_keywords"))


def json_lines_rows(spark, d):
    """Training rows as lines of JSON read with a fixed schema; rows whose line is spoilt are counted and left out."""
    z = _rows(spark, d)
    line = F.to_json(F.struct("cutoff_t", "topic_id", "target_z", "operator_closed"))
    spoilt = F.when(F.col("dz_id") % 10 == 0, F.expr("substring(line, 1, length(line) - 1)")).otherwise(line)
    parsed = z.withColumn("line", line).select(F.try_parse_json(spoilt).isNotNull().alias("ok"), F.from_json(line, readers.DZ_ROW).alias("r"))
    return parsed.groupBy(F.col("r.topic_id").alias("topic_id")).agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("spoilt"))


def batch_requests(spark, d):
    """Requests for samples not yet extracted, under their joined ids."""
    s = _samples(spark, d).select("topic_id", "episode_id", F.col("future_paper_id").alias("paper_id")).filter("topic_id is not null and episode_id is not null and paper_id is not null").distinct()
    done = s.filter(F.substring("paper_id", -1, 1).isin("0", "2", "4", "6", "8")).select(F.substring(F.concat_ws("|", "topic_id", "episode_id", "paper_id"), 1, 64).alias("custom_id"))
    return sinks.batch_requests(s, done, F.col("paper_id")).select("custom_id", F.get_json_object("value", "$.body.prompt").alias("prompt"))


def training_rows(spark, d):
    z = _rows(spark, d)
    rows = sinks.training_rows(z, "forecast", F.col("target_z.gap"), F.col("operator_closed"), ["dz_id", "topic_id", "cutoff_t"])
    return rows.select("data_source", "prompt", "ground_truth", F.get_json_object("extra_info", "$.dz_id").cast("bigint").alias("dz_id"))


def artifact_rollup(spark, d):
    """Windows nested per topic as an artifact holds them, taken apart again and rolled up."""
    f = table(spark, d, "scored_forecasts").select("forecast_id", "topic_id", "cutoff_t", "prior_score").dropDuplicates(["forecast_id"]).filter("topic_id is not null and cutoff_t is not null")
    w = f.groupBy("topic_id", F.col("cutoff_t").alias("cutoff_date")).agg(F.create_map(F.lit("prior"), F.avg("prior_score")).alias("evaluation"), F.count("*").alias("n"))
    a = sinks.artifact(w, {"strategy": "all"})
    flat = a.select("topic_id", F.explode("windows").alias("w")).select("topic_id", F.col("w.cutoff_date").alias("cutoff_date"), F.col("w.evaluation")["prior"].alias("prior"))
    return flat.groupBy("topic_id").agg(F.count("*").alias("windows"), F.round(F.avg("prior"), 4).alias("prior"))


def strategy_names(spark, d):
    """A strategy's family by name, else by prefix."""
    s = table(spark, d, "scored_forecasts").select("strategy_id").distinct()
    family = F.when(F.col("strategy_id").contains("shared"), "shared").when(F.col("strategy_id").rlike("^strat-"), "strat").otherwise(F.split_part("strategy_id", F.lit("-"), F.lit(1)))
    return s.groupBy(family.alias("family")).agg(F.count("*").alias("n"))


def calendar_windows(spark, d):
    bounds = papers(spark, d).agg(F.min(D.month_index(F.col("published"))).alias("first"), F.max(D.month_index(F.col("published"))).alias("last"))
    return P.calendar_windows(bounds, 4, 3)


def rl_episodes(spark, d):
    return P.episodes(papers(spark, d), "published", 6, 3, 2)


def topic_episode_grid(spark, d):
    cuts = spark.createDataFrame([("ep-1", "2023-12-31"), ("ep-2", "2024-03-31"), ("ep-3", "2024-06-30")], "episode string, cutoff string").withColumn("cutoff", F.col("cutoff").cast("date"))
    return P.grid(table(spark, d, "topics").select("topic_id"), cuts, papers(spark, d), 3)


def preview_round_robin(spark, d):
    s = _samples(spark, d).filter("topic_id is not null and episode_id is not null")
    return P.round_robin(s, ["episode_id", "topic_id"], "sample_id", 40).select("episode_id", "topic_id", "sample_id", "position")


def pair_construction(spark, d):
    s = _samples(spark, d).filter("innovation.gap is not null and future_paper_title is not null and topic_id is not null").select("sample_id", "topic_id", F.col("innovation.gap").alias("idea"), F.col("future_paper_title").alias("candidate"))
    return P.label_pairs(s, "topic_id", "sample_id", "idea", "candidate").select("topic_id", "sample_id", "label", T.short_hash(F.concat_ws("#", "idea", "candidate")).alias("h"))


def sampling_plan(spark, d):
    return P.sampling_plan(spark, [0.2, 0.7, 1.0], [0.9, 0.95], 16)


def last_context(spark, d):
    return P.last_rows(papers(spark, d).filter("topic_id is not null"), ["topic_id"], ["published", "paper_id"], 5).select("topic_id", "paper_id", "position")


def aligned_columns(spark, d):
    """The i-th value of a shorter list for each place of a longer one."""
    p = papers(spark, d).filter("size(keywords) > 0")
    pos = p.select("paper_id", F.posexplode(F.sequence(F.lit(1), F.size("keywords") * 2)).alias("i", "x"), "keywords")
    return pos.select("paper_id", "i", P.aligned(F.col("keywords"), F.col("i"), F.size("keywords") * 2).alias("v"))


def memory_asof(spark, d):
    s = _samples(spark, d).withColumn("m", D.month_index(D.cutoff_date(F.col("cutoff_date")))).filter("m is not null and topic_id is not null")
    return P.counts_asof(s, ["topic_id", "source"], "m", "sample_id").select("sample_id", "earlier")


def leakage_violations(spark, d):
    s = _samples(spark, d)
    cut, pub = D.cutoff_date(F.col("cutoff_date")), D.published_date(F.col("future_paper_published_date"))
    named = [("published_by_cutoff", pub <= cut), ("after_limit", pub > F.lit("2025-06-30").cast("date")), ("no_date", pub.isNull())]
    return P.violations(s, named)


def split_overlap(spark, d):
    s = _samples(spark, d).filter("future_paper_id is not null and split is not null")
    per = s.groupBy("future_paper_id").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    return per.groupBy(F.array_join("splits", "+").alias("splits")).agg(F.count("*").alias("papers"))


def group_invariant(spark, d):
    s = _ideas(spark, d).filter("topic_id is not null")
    return P.group_invariant(s, ["topic_id"], "pred_id", 4, ["strategy_id"])


def flattened_ideas(spark, d):
    i = _ideas(spark, d)
    return i.select(F.trim("cutoff_date").alias("cutoff"), "topic_id", "strategy_id", "rank", "pred_id").orderBy(F.desc("cutoff"), "topic_id", "strategy_id", "rank", "pred_id")


def retry_fill(spark, d):
    """Ideas of a topic, then those of a retry, once per title, until five."""
    i = _ideas(spark, d).filter("topic_id is not null and title is not null")
    first, retry = i.filter("pred_id % 2 = 0"), i.filter("pred_id % 2 = 1")
    return P.fill_up(first, retry, ["topic_id"], "title", ["pred_id"], 5).select("topic_id", "pred_id", "place")


def incremental_ingest(spark, d):
    p = table(spark, d, "papers").select("paper_id", "title", "topic_id", F.col("ingested_at").cast("timestamp").alias("updated"))
    known = _samples(spark, d).select(F.col("future_paper_id").alias("paper_id"))
    now = F.lit("2025-12-31 00:00:00").cast("timestamp")
    return R.ingest(p, known, "paper_id", "updated", now, 200).groupBy("topic_id").agg(F.count("*").alias("n"))


def stream_daily_counts(spark, d):
    """Events per day and type, counted by an incremental stream."""
    e = R.table_stream(spark, d, "events")
    return R.partial_counts(e, [F.to_date("ts").alias("day"), F.col("event_type")], {"value": F.col("value")}).select("day", "event_type", "n", F.round("value", 4).alias("value"))


def stream_new_papers(spark, d):
    """Papers once each, however often they are delivered, by an incremental stream; per topic."""
    p = R.table_stream(spark, d, "papers").select("paper_id", "topic_id", F.col("ingested_at").cast("timestamp").alias("t")).filter("t is not null")
    return R.new_rows(p, ["paper_id"], "t", "3650 days").groupBy("topic_id").agg(F.count("*").alias("n"))


def stream_ema(spark, d):
    e = R.table_stream(spark, d, "events").select("user_id", "event_id", "value")
    return R.stream_ema(e, "user_id", ["event_id"], "value")


def pending_windows(spark, d):
    w = _samples(spark, d).select("topic_id", "episode_id").filter("topic_id is not null and episode_id is not null").distinct()
    done = _rows(spark, d).filter("dz_id % 4 = 0").select("topic_id", "episode_id", F.lit("a1").alias("fingerprint"))
    return R.pending(w, done, ["topic_id", "episode_id"], "a1")


def cached_decisions(spark, d):
    i = _ideas(spark, d).filter("title is not null").select("pred_id", T.short_hash(F.col("title")).alias("key"))
    cache = papers(spark, d).filter("title is not null").select(T.short_hash(F.col("title")).alias("key"), F.lit(1).alias("hit")).distinct()
    hit, miss = R.cached(i, cache, ["key"])
    return hit.agg(F.lit("hit").alias("what"), F.count("*").alias("n")).unionByName(miss.agg(F.lit("miss").alias("what"), F.count("*").alias("n")))


def runs_by_status(spark, d):
    """Service counters: forecasts by their state, an unscored one being NaN and a failed one null."""
    s = table(spark, d, "scored_forecasts").select("forecast_id", "joint_score").dropDuplicates(["forecast_id"])
    state = F.when(F.isnan("joint_score"), "unscored").when(F.col("joint_score").isNull(), "failed").otherwise("done")
    return s.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def config_fingerprints(spark, d):
    t = table(spark, d, "topics")
    text = F.concat_ws("|", "topic_id", "topic_name", F.array_join(F.sort_array("keywords"), ","))
    return t.select("topic_id", T.short_hash(text, 12).alias("fingerprint"))


def best_candidates(spark, d):
    """Per topic the best idea, and the shares of ideas without score and of zero scores."""
    i = _ideas(spark, d).withColumn("s", T.coerced_score(F.col("score")))
    return i.groupBy("topic_id").agg(
        F.max_by("pred_id", F.struct(F.coalesce("s", F.lit(-1.0)), -F.col("pred_id"))).alias("best"), V.exact_mean(F.col("s")).alias("mean"), F.round(F.avg(F.col("s").isNull().cast("double")), 6).alias("invalid"), F.round(F.avg((F.coalesce("s", F.lit(1.0)) == 0).cast("double")), 6).alias("zero")
    )


def keyword_inverted_index(spark, d):
    """Every paper of each keyword that three or more papers have, a row each, with the number of the keyword's papers."""
    kw = A.document_keywords(papers(spark, d), "paper_id", "keywords")
    sizes = kw.groupBy("kw").agg(F.count("*").alias("n")).filter("n >= 3")
    return kw.join(sizes, "kw").select("kw", "paper_id", "n").orderBy("kw", "paper_id")


_S = "s as (select distinct on (sample_id) * from hindsight_samples)"
_Z = "z as (select distinct on (dz_id) * from dz_rows)"
_I = "i as (select distinct on (pred_id) * from idea_predictions)"
_CUT = "try_cast(case when length(trim(cutoff_date)) = 7 then trim(cutoff_date) || '-01' else trim(cutoff_date) end as date)"
_PUB = "case when length(trim(future_paper_published_date)) = 7 then last_day(try_cast(trim(future_paper_published_date) || '-01' as date)) else try_cast(trim(future_paper_published_date) as date) end"
_SD = f"sd as (select *, {_CUT} cut, {_PUB} pub from s)"
SQL = {
    "batch_requests": f"with {_S}, k as (select distinct topic_id, episode_id, future_paper_id p from s where topic_id is not null and episode_id is not null and future_paper_id is not null) select substr(topic_id || '|' || episode_id || '|' || p, 1, 64) custom_id, p prompt from k where right(p, 1) not in ('0', '2', '4', '6', '8')",
    "markdown_round_trip": f"""with {PAPERS}, k as (select *, trim(regexp_replace(title, '\\s+', ' ', 'g')) t, list_sort(list_distinct(list_filter(list_transform(keywords, lambda x: trim(lower(x))), lambda x: x <> ''))) k,
      list_filter(list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 3 and x not in {T.STOP_WORDS}) w from p where trim(coalesce(title, '')) <> '')
      select paper_id, t title, strftime(published, '%Y-%m') as month, published, length(substr(trim(regexp_replace(summary, '\\s+', ' ', 'g')), 1, 1500))::int summary_n,
      case when len(k) > 0 then array_to_string(k, '|') else coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda y: list_position(w, y[1]) = y[2]), lambda y: y[1]), '|'), '') end keywords, coalesce(len(refs), 0)::int n_refs from k""",
    "atom_entries": f"with {PAPERS} select paper_id id, trim(regexp_replace(translate(title, '<>&', '   '), '\\s+', ' ', 'g')) title, coalesce(len(list_distinct(keywords)), 0)::int n_keywords from p where trim(coalesce(title, '')) <> '' and coalesce(published_date, '') <> ''",
    "json_lines_rows": f"with {_Z} select topic_id, count(*) filter (where dz_id % 10 <> 0) good, count(*) filter (where dz_id % 10 = 0) spoilt from z group by 1",
    "training_rows": f"with {_Z} select 'forecast' data_source, target_z.gap prompt, operator_closed ground_truth, dz_id from z",
    "artifact_rollup": "with f as (select distinct on (forecast_id) * from scored_forecasts), w as (select topic_id, cutoff_t, avg(prior_score) p from f where topic_id is not null and cutoff_t is not null group by 1, 2) select topic_id, count(*) windows, round(avg(p), 4) prior from w group by 1",
    "strategy_names": "select case when contains(strategy_id, 'shared') then 'shared' when strategy_id like 'strat-%' then 'strat' else split_part(strategy_id, '-', 1) end family, count(distinct strategy_id) n from scored_forecasts group by 1",
    "calendar_windows": f"""with {PAPERS}, b as (select min(year(published)*12+month(published)-1) f, max(year(published)*12+month(published)-1) l from p), w as (select unnest(range(f::bigint, (l + 1)::bigint, 3)) s, l from b), x as (select row_number() over (order by s) - 1 i, s, least(s + 3, l) e from w)
      select i::int as index, format('{{:04d}}-{{:02d}}', s // 12, s % 12 + 1) start_month, format('{{:04d}}-{{:02d}}', e::bigint // 12, e::bigint % 12 + 1) end_month from x""",
    "rl_episodes": f"""with {PAPERS}, m as (select year(published)*12+month(published)-1 m, count(*) n from p where published is not null group by 1), b as (select min(m) f, max(m) l from m), e as (select unnest(range((f + 6)::bigint, (l - 3 + 1)::bigint, 2)) c from b)
      select c::int cutoff, coalesce((select sum(n) from m where m.m between c - 6 and c - 1), 0)::bigint train_n, coalesce((select sum(n) from m where m.m between c and c + 2), 0)::bigint future_n from e""",
    "topic_episode_grid": f"""with {PAPERS}, e as (select * from (values ('ep-1', date '2023-12-31'), ('ep-2', date '2024-03-31'), ('ep-3', date '2024-06-30')) t(episode, cutoff)) select t.topic_id, e.episode, count(*) filter (where published <= cutoff) train_n, count(*) filter (where published > cutoff and published <= last_day((cutoff + interval 3 month)::date)) future_n
      from topics t cross join e left join p on p.topic_id = t.topic_id group by 1, 2""",
    "preview_round_robin": f"with {_S}, r as (select episode_id, topic_id, sample_id, (row_number() over (partition by episode_id, topic_id order by sample_id) - 1)::int as position from s where topic_id is not null and episode_id is not null) select * from r order by position, episode_id, topic_id limit 40",
    "pair_construction": f"""with {_S}, k as (select sample_id, topic_id, innovation.gap idea, future_paper_title candidate, row_number() over (partition by topic_id order by sample_id) r, count(*) over (partition by topic_id) n from s where innovation.gap is not null and future_paper_title is not null and topic_id is not null),
      x as (select a.topic_id, a.sample_id, 1 as label, a.idea, a.candidate from k a union all select a.topic_id, a.sample_id, 0, a.idea, b.candidate from k a join k b on a.topic_id = b.topic_id and b.r = a.r % a.n + 1 where a.n > 1) select topic_id, sample_id, label::int as label, substr(sha256(idea || '#' || candidate), 1, 16) h from x""",
    "sampling_plan": "select i::int i, ([0.2, 0.7, 1.0])[i % 3 + 1]::double temperature, ([0.9, 0.95])[i // 3 % 2 + 1]::double top_p from range(16) t(i)",
    "last_context": f"with {PAPERS}, r as (select topic_id, paper_id, row_number() over (partition by topic_id order by published desc, paper_id desc) r from p where topic_id is not null), k as (select * from r where r <= 5) select topic_id, paper_id, row_number() over (partition by topic_id order by r desc)::int as position from k",
    "aligned_columns": f"with {PAPERS}, k as (select paper_id, keywords, unnest(range(len(keywords) * 2)) i from p where len(keywords) > 0) select paper_id, i::int i, keywords[i // 2 + 1] v from k",
    "memory_asof": f"with {_S}, {_SD}, k as (select sample_id, topic_id, source, year(cut)*12+month(cut)-1 m from sd where cut is not null and topic_id is not null) select a.sample_id, count(b.sample_id) earlier from k a left join k b on a.topic_id = b.topic_id and a.source is not distinct from b.source and b.m < a.m group by 1",
    "leakage_violations": f"with {_S}, {_SD} select 'published_by_cutoff' as rule, count(*) filter (where pub <= cut) n, count(*) total from sd union all select 'after_limit', count(*) filter (where pub > date '2025-06-30'), count(*) from sd union all select 'no_date', count(*) filter (where pub is null), count(*) from sd",
    "split_overlap": f"with {_S}, x as (select future_paper_id, array_to_string(list_sort(list(distinct split)), '+') splits from s where future_paper_id is not null and split is not null group by 1) select splits, count(*) papers from x group by 1",
    "group_invariant": f"with {_I}, r as (select topic_id, strategy_id, ((row_number() over (partition by topic_id order by pred_id) - 1) // 4)::int g from i where topic_id is not null), k as (select topic_id, g, count(*) n, count(distinct strategy_id) d from r group by all) select topic_id, count(*) groups, count(*) filter (where d = 1) uniform, count(*) filter (where n < 4) short from k group by 1",
    "flattened_ideas": f"with {_I} select trim(cutoff_date) cutoff, topic_id, strategy_id, rank, pred_id from i order by cutoff desc nulls last, topic_id nulls first, strategy_id nulls first, rank nulls first, pred_id",
    "retry_fill": f"with {_I}, u as (select *, (pred_id % 2)::int part, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) k from i where topic_id is not null and title is not null), d as (select *, row_number() over (partition by topic_id, k order by part, pred_id) dup from u), r as (select topic_id, pred_id, row_number() over (partition by topic_id order by part, pred_id)::int place from d where dup = 1) select * from r where place <= 5",
    "incremental_ingest": "with k as (select paper_id, arg_max(topic_id, ingested_at) topic_id from papers where ingested_at >= timestamp '2025-12-31' - interval 200 day and paper_id not in (select future_paper_id from hindsight_samples where future_paper_id is not null) group by 1) select topic_id, count(*) n from k group by 1",
    "stream_daily_counts": "select ts::date as day, event_type, count(*) n, round(sum(value), 4) as value from events group by all",
    "stream_new_papers": "with p as (select distinct on (paper_id) paper_id, topic_id from papers where ingested_at is not null) select topic_id, count(*) n from p group by 1",
    "stream_ema": "with l as (select user_id, list(value order by event_id) v from events group by 1) select user_id, len(v)::bigint n, round(list_reduce(list_prepend(0.0::double, v), lambda u, e: u + 0.3::double * (e - u)), 6) ema from l",
    "pending_windows": f"with {_S}, {_Z} select distinct topic_id, episode_id from s where topic_id is not null and episode_id is not null and (topic_id, episode_id) not in (select (topic_id, episode_id) from z where dz_id % 4 = 0 and topic_id is not null and episode_id is not null)",
    "cached_decisions": f"with {_I}, {PAPERS} select 'hit' what, count(*) n from i where title in (select title from p where title is not null) union all select 'miss', count(*) from i where title is not null and title not in (select title from p where title is not null)",
    "runs_by_status": "with f as (select distinct on (forecast_id) * from scored_forecasts) select case when isnan(joint_score) then 'unscored' when joint_score is null then 'failed' else 'done' end state, count(*) n from f group by 1",
    "config_fingerprints": "select topic_id, substr(sha256(topic_id || '|' || topic_name || '|' || array_to_string(list_sort(keywords), ',')), 1, 12) fingerprint from topics",
    "best_candidates": f"with {_I}, k as (select topic_id, pred_id, case when score is not null then round(least(greatest(case when score > 1 then score / 10 else score end, 0), 1), 4) end s from i) select topic_id, (list(pred_id order by coalesce(s, -1) desc, pred_id))[1] best, floor((2 * sum(round(s * 10000)::bigint) + count(s)) / nullif(2 * count(s), 0)) / 10000 mean, round(avg((s is null)::int), 6) invalid, round(avg((coalesce(s, 1) = 0)::int), 6) as zero from k group by 1",
    "keyword_inverted_index": f"with {PAPERS}, kw as (select distinct paper_id, trim(lower(k)) kw from (select paper_id, unnest(keywords) k from p) where length(trim(lower(k))) > 2), g as (select kw, count(*) n from kw group by 1 having count(*) >= 3) select kw, paper_id, n from kw join g using (kw)",
}
QUERIES = {
    f.__name__: f
    for f in (
        markdown_round_trip, atom_entries, json_lines_rows, batch_requests, training_rows, artifact_rollup, strategy_names, calendar_windows, rl_episodes, topic_episode_grid, preview_round_robin, pair_construction, sampling_plan, last_context, aligned_columns,
        memory_asof, leakage_violations, split_overlap, group_invariant, flattened_ideas, retry_fill, incremental_ingest, stream_daily_counts, stream_new_papers, stream_ema, pending_windows, cached_decisions, runs_by_status, config_fingerprints, best_candidates,
        keyword_inverted_index,
    )
}
