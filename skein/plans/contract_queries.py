"""Queries over records, payloads, rewards, strategies and daily runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import backtest as B
from skein.operators import contracts as C
from skein.operators import folds
from skein.operators import statistics as S
from skein.operators.mapping import exact_map
from skein.plans import strategies as X
from skein.plans.scalar_queries import PAPERS, TOK, papers
from skein.sources import readers
from skein.sources.tables import table


def _ideas(spark, d):
    return table(spark, d, "idea_predictions").dropDuplicates(["pred_id"])


def _samples(spark, d):
    return table(spark, d, "hindsight_samples").dropDuplicates(["sample_id"])


def _rows(spark, d):
    return table(spark, d, "dz_rows").dropDuplicates(["dz_id"])


def _forecasts(spark, d):
    return table(spark, d, "scored_forecasts").select("forecast_id", "strategy_id", "topic_id", "rank", "prior_score", "realization_score", "joint_score", "innovation", "proposal_text").dropDuplicates(["forecast_id"])


def topic_selection(spark, d):
    """Topics that documents ask for, and whether the dimension knows them."""
    return C.selected(table(spark, d, "documents").select("topic_id"), table(spark, d, "topics"), "topic_id")


def cutoff_training(spark, d):
    c = _samples(spark, d).select(F.date_format(D.cutoff_date(F.col("cutoff_date")), "yyyy-MM").alias("month")).filter("month is not null").distinct()
    return C.train_cutoffs(c, "month")


def active_runs(spark, d):
    """Per strategy its topics, and those with anything done, by nested topic runs."""
    f = _forecasts(spark, d).filter("topic_id is not null").groupBy("strategy_id", "topic_id").agg(
        F.count_if(F.col("realization_score") >= 0.9).cast("int").alias("matched_paper_count"), F.when(F.count("prior_score") > 1, "completed").otherwise("pending").alias("generation_status"), F.when(F.count("realization_score") > 2, "completed").otherwise("pending").alias("backtest_status")
    )
    records = f.groupBy("strategy_id").agg(F.collect_list(F.struct("topic_id", "matched_paper_count", "generation_status", "backtest_status")).alias("topic_runs"))
    return records.select("strategy_id", F.size("topic_runs").alias("runs"), F.size(C.active(F.col("topic_runs"))).alias("active"))


def nested_ideas(spark, d):
    """Ideas nested into records with topic runs, those without a topic as the record's own generation, and flattened again."""
    i = _ideas(spark, d).select(F.col("strategy_id").alias("id"), "topic_id", F.coalesce(F.trim("cutoff_date"), F.lit("")).alias("cutoff"), F.struct("rank", "pred_id").alias("p"))
    runs = i.filter("topic_id is not null").groupBy("id", "topic_id", "cutoff").agg(F.collect_list("p").alias("predictions"))
    nested = runs.groupBy("id").agg(F.collect_list(F.struct("topic_id", F.initcap(F.translate("topic_id", "_", " ")).alias("topic_name"), "cutoff", "predictions")).alias("topic_runs"))
    own = i.filter("topic_id is null").groupBy("id").agg(F.struct(F.max("cutoff").alias("cutoff"), F.collect_list("p").alias("predictions")).alias("generation"))
    records = nested.join(own, "id", "full_outer").withColumn("name", F.col("id"))
    return C.flattened(records).select("id", "topic_id", "cutoff", "rank", "pred_id")


def normalized_records(spark, d):
    s = _samples(spark, d).select("sample_id", "split", "source", "context_paper_count")
    return C.defaults(s, {"split": F.lit("unknown"), "source": F.lit("-"), "context_paper_count": F.lit(0)})


def contract_round_trip(spark, d):
    """Training rows as JSON and back under the contract's schema: rows that come back unchanged, and rows."""
    fields = [f.name for f in readers.DZ_ROW.fields]
    z = _rows(spark, d).select("dz_id", F.struct(*fields).alias("row"))
    back = z.select("dz_id", "row", F.from_json(F.to_json("row"), readers.DZ_ROW).alias("back"))
    same = [F.col(f"row.{f}").eqNullSafe(F.col(f"back.{f}")) for f in fields if f != "extra"]
    kept = F.coalesce(F.size("row.extra"), F.lit(-1)) == F.coalesce(F.size("back.extra"), F.lit(-1))
    both = kept
    for s in same:
        both = both & s
    return back.agg(F.count("*").alias("rows"), F.count_if(both).alias("unchanged"))


def target_papers(spark, d):
    """The earliest future paper of each episode; a paper without a date counts by the first day of its month."""
    s = _samples(spark, d).filter("episode_id is not null and future_paper_id is not null")
    day = F.coalesce(D.published_date(F.col("future_paper_published_date")), D.month_start(F.date_format(D.cutoff_date(F.col("cutoff_date")), "yyyy-MM")))
    return s.withColumn("day", day).filter("day is not null").groupBy("topic_id", "episode_id").agg(F.min_by("future_paper_id", F.struct("day", "future_paper_id")).alias("target"))


def run_errors(spark, d):
    """Per strategy the topics whose forecasts have no usable score, as one line of errors."""
    f = _forecasts(spark, d).filter("topic_id is not null").groupBy("strategy_id", "topic_id").agg(F.count_if(F.col("joint_score").isNotNull() & ~F.isnan("joint_score")).alias("ok"))
    return C.joined_errors(f, ["strategy_id"], "topic_id", F.when(F.col("ok") == 0, "no score"))


def calendar_splits(spark, d):
    month = F.date_format(D.cutoff_date(F.col("cutoff_date")), "yyyy-MM")
    s = _samples(spark, d).select(month.alias("month")).filter("month is not null")
    return s.groupBy(C.calendar_label(F.col("month"), "2024-04", "2025-01").alias("label")).agg(F.count("*").alias("n"))


def hindsight_dataset(spark, d):
    """The first two future papers of each topic and cutoff of the samples, with their extracted triple; papers without one are dropped."""
    s = _samples(spark, d).withColumn("cut", D.cutoff_date(F.col("cutoff_date"))).filter("topic_id is not null and cut is not null")
    p = papers(spark, d).select("topic_id", "paper_id", "published")
    first = C.first_future(p, s.select("topic_id", "cut").distinct(), 3, 2, B.future_end(F.col("cut"), 3))
    labels = _samples(spark, d).filter("future_paper_id is not null and innovation.gap is not null").groupBy(F.col("future_paper_id").alias("paper_id")).agg(F.min_by("innovation.gap", "sample_id").alias("gap"))
    return first.join(labels, "paper_id")


def rendered_memory(spark, d):
    """Per topic the memory lines of its training rows, as digest and number of entries."""
    z = _rows(spark, d).filter("topic_id is not null and target_z.gap is not null")
    m = C.memory_lines(z, ["topic_id"], F.struct(F.col("dz_id").alias("id"), F.col("target_z.gap").alias("gap")), ["dz_id"])
    return m.select("topic_id", "entries", T.short_hash(F.col("memory_text")).alias("h"))


def index_build(spark, d):
    """Per kind and cutoff the entries, those usable, and, on the future side, those not published after the cutoff."""
    e = table(spark, d, "index_entries").dropDuplicates(["vec_id"])
    usable = F.coalesce((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    late = (F.col("kind") == "future") & (D.published_date(F.col("published_date")) <= D.cutoff_date(F.col("cutoff_date")))
    return e.groupBy("kind", "cutoff_date").agg(F.count("*").alias("entries"), F.count_if(usable).alias("usable"), F.count_if(late).alias("leaks"))


def reward_payloads(spark, d):
    """Topic, operator and candidate text of each forecast's payload, resolved."""
    s = _samples(spark, d).select("sample_id", "topic_id", "episode_id", "future_paper_id", "innovation")
    of_paper = papers(spark, d).select(F.col("paper_id").alias("future_paper_id"), F.col("topic_id").alias("paper_topic"), F.col("title").alias("candidate"))
    names = table(spark, d, "operator_inventory").select("op_id", F.explode(F.concat(F.array("op_id", "op_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    j = exact_map(s.withColumn("typed", F.col("innovation.operator")), "typed", names, "name", "op_id", "other").join(of_paper, "future_paper_id", "left")
    return j.select("sample_id", C.payload_topic(F.when(F.col("sample_id") % 3 > 0, F.col("topic_id")), F.when(F.col("sample_id") % 3 == 1, F.col("topic_id")), F.col("paper_topic")).alias("topic"), F.col("mapped").alias("operator"), T.short_hash(F.coalesce("candidate", F.lit(""))).alias("candidate"))


def metric_rewards(spark, d):
    f = _forecasts(spark, d)
    parts = {"soft": F.col("joint_score"), "coverage": F.col("realization_score"), "novelty": F.col("prior_score")}
    return f.select("forecast_id", *(C.metric_reward(m, parts).alias(m) for m in parts))


def strict_reasons(spark, d):
    """Why the training rows' recorded rollouts are invalid, if they are: context papers stand for the steps."""
    z = _rows(spark, d)
    claimed = F.when(F.col("dz_id") % 7 > 0, F.col("target_z"))
    reason = C.strict_reason(F.when(F.col("dz_id") % 11 > 0, F.col("target_z")), F.col("context_paper_ids"), claimed, F.size("context_paper_ids") > 1, F.when(F.col("memory_text").isNull(), "no_memory"))
    return z.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def static_predictions(spark, d):
    i = _ideas(spark, d).filter("topic_id is not null").withColumn("cut", D.cutoff_date(F.col("cutoff_date")))
    return B.reranked(i, ["strategy_id", "topic_id", "cut"], [F.col("rank").asc_nulls_last(), F.col("pred_id")], 3).select("pred_id", "rank")


def strict_rollouts(spark, d):
    """States of rollouts cut at the steps allowed: searches, selections and one more."""
    z = _rows(spark, d).filter("context_paper_ids is not null").select("dz_id", F.posexplode("context_paper_ids").alias("step", "paper")).filter(F.col("step") < 3 + 2 + 1)
    kind = F.when(F.col("step") % 2 == 0, "search").otherwise("select")
    ids = F.when(F.col("step") % 2 == 1, F.array(F.lag("paper").over(Window.partitionBy("dz_id").orderBy("step")))).otherwise(F.array("paper"))
    return folds.search_states(z.select("dz_id", "step", kind.alias("type"), ids.alias("ids")), "dz_id", 3, 2).select("dz_id", "searches", "selected", "invalid")


def baseline_check(spark, d):
    """Whether any strategy has a usable score, and the strategies to bootstrap."""
    f = _forecasts(spark, d).groupBy("strategy_id").agg(F.bool_or(F.coalesce(~F.isnan("joint_score"), F.lit(False))).alias("has"))
    return f.agg(F.coalesce(F.bool_or("has"), F.lit(False)).alias("any_baseline"), F.count_if(~F.col("has")).alias("to_bootstrap"))


def month_advance(spark, d):
    """Each strategy's last month, moved on to the corpus's latest."""
    latest = papers(spark, d).agg(F.date_format(F.max("published"), "yyyy-MM").alias("latest"))
    own = _ideas(spark, d).groupBy("strategy_id").agg(F.max(F.date_format(D.cutoff_date(F.col("cutoff_date")), "yyyy-MM")).alias("own"))
    return own.join(F.broadcast(latest)).select("strategy_id", "own", F.greatest("own", "latest").alias("end_month"))  # one row


def rubric_blocks(spark, d):
    """A rubric per topic as text: its aliases are the focus, its keywords the criteria."""
    t = table(spark, d, "topics")
    return t.select("topic_id", C.rubric_block(F.col("topic_name"), F.col("aliases"), F.col("keywords"), F.array().cast("array<string>")).alias("block"))


def rubric_refresh(spark, d):
    """Topics whose buffered rollouts let a new version pass: score quality is the AUC of the prior score for high realization."""
    f = _forecasts(spark, d).filter("topic_id is not null and prior_score is not null and realization_score is not null").withColumn("label", (F.col("realization_score") >= 0.5).cast("int"))
    auc = S.auc(f, "prior_score", "label", ["topic_id"]).select("topic_id", "auc")
    return C.validated(f.withColumn("version", F.lit(1)), ["topic_id"], F.col("label") == 1, auc, "version", 0.5)


def daily_job(spark, d):
    """The last day's run: each strategy's latest predictions against only the papers that are new (received in the last 60 days), with its score."""
    p = papers(spark, d).filter("topic_id is not null and published is not null")
    new = p.filter(F.col("ingested_at") >= F.lit("2025-12-31").cast("timestamp") - F.expr("interval 60 day"))
    i = _ideas(spark, d).withColumn("cut", D.cutoff_date(F.col("cutoff_date"))).filter("topic_id is not null and cut is not null")
    last = i.groupBy("strategy_id").agg(F.max("cut").alias("cut"))
    i = B.reranked(i.join(last, ["strategy_id", "cut"]), ["strategy_id", "topic_id", "cut"], [F.desc("score"), F.col("pred_id")], 5)
    left = i.select("strategy_id", "topic_id", "cut", "rank", T.hashed_set(T.token_set(T.idea_text(F.col("title"), F.col("rationale"), F.col("approach"), F.col("key_terms")))).alias("a"))
    right = new.select("topic_id", F.col("paper_id").alias("paper"), "published", T.hashed_set(T.token_set(T.paper_text(F.col("title"), F.col("keywords"), F.col("summary")))).alias("b"))
    near = left.join(right, "topic_id").filter("published > cut").filter(T.may_exceed(F.col("a"), F.col("b"), 0.1)).withColumn("score", F.round(T.jaccard(F.col("a"), F.col("b")), 6)).filter("score > 0.1")
    taken = folds.greedy_match(near.select("strategy_id", "topic_id", "cut", "rank", "paper", "score"), ["strategy_id", "topic_id", "cut"], 5)
    hits = taken.groupBy("strategy_id").agg(F.count("*").alias("matched"), F.min("rank").alias("first"))
    n = i.groupBy("strategy_id").agg(F.count("*").alias("predictions"))
    j = n.join(hits, "strategy_id", "left").fillna(0, ["matched"])
    mrr = F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4)
    return j.select("strategy_id", "predictions", "matched", V.leaderboard_score((F.col("matched") > 0).cast("double"), mrr).alias("score"))


def generated_predictions(spark, d):
    """Both rule-based strategies over the windows of the ideas, by name."""
    p = papers(spark, d).filter("topic_id is not null").select("topic_id", "paper_id", "published", F.coalesce("title", F.lit("")).alias("title"))
    w = _ideas(spark, d).select("topic_id", D.cutoff_date(F.col("cutoff_date")).alias("cut")).filter("topic_id is not null and cut is not null").distinct()
    both = X.generate("term_pairs", p, w, 3).unionByName(X.generate("latest_titles", p, w, 3))
    return both.select("strategy", "topic_id", "cut", "rank", "title")


def stub_judge(spark, d):
    """Each idea's title judged against its rationale by rule, through a reply and its parser."""
    i = _ideas(spark, d)
    reply = X.judge_reply("overlap", F.coalesce("title", F.lit("")), F.coalesce("rationale", F.lit("")))
    return i.select("pred_id", T.free_score(reply).alias("score"))


def joint_inference(spark, d):
    """Score, weigh and rank the forecasts of each strategy and topic in one chain; the three best."""
    reward = X.make_reward({"prior_score": 0.4, "realization_score": 0.6}, F.col("proposal_text").isNull())
    place = F.row_number().over(Window.partitionBy("strategy_id", "topic_id").orderBy(F.desc("reward"), "forecast_id"))
    run = X.chained(lambda f: f.filter("topic_id is not null"), reward, lambda f: f.withColumn("place", place).filter("place <= 3"), lambda f: f.select("strategy_id", "topic_id", "forecast_id", "reward", "place"))
    return run(_forecasts(spark, d))


def upserted_records(spark, d):
    """Ideas after an update of every tenth and the deletion of every twentieth, by key."""
    old = _ideas(spark, d).select("pred_id", "topic_id", "rank")
    new = old.filter("pred_id % 10 = 0").withColumn("rank", F.lit(99))
    return C.deleted(C.upsert(old, new, ["pred_id"]), old.filter("pred_id % 20 = 0"), ["pred_id"]).groupBy("rank").agg(F.count("*").alias("n"))


def paper_lookup(spark, d):
    """Fields of the papers that samples name; null where there is no data."""
    s = _samples(spark, d).filter("future_paper_id is not null").select("sample_id", F.col("future_paper_id").alias("paper_id"))
    return s.join(papers(spark, d).select("paper_id", "popularity_score", F.size(F.coalesce("refs", F.array().cast("array<string>"))).alias("n_refs")), "paper_id", "left")


def community_overlap(spark, d):
    """Per paper the share of its references that other papers of the corpus have too."""
    p = papers(spark, d).select("paper_id", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    return C.community_overlap(p, "paper_id", "refs", p)


def corpus_search(spark, d):
    """The gap of every sample whose id is divisible by 50, searched in the papers of its topic."""
    q = _samples(spark, d).filter("sample_id % 50 = 0 and topic_id is not null and innovation.gap is not null").select("topic_id", F.col("sample_id").alias("q"), T.token_set(F.col("innovation.gap")).alias("words"))
    p = papers(spark, d).filter("topic_id is not null").select("topic_id", F.col("paper_id").alias("p"), F.date_format("published", "yyyy-MM").alias("month"), T.token_set(T.paper_text(F.col("title"), F.col("keywords"), F.col("summary"))).alias("words"))
    return C.corpus_search(q, p, 3)


def heuristic_triples(spark, d):
    p = papers(spark, d).filter("title is not null").select("paper_id", C.memory_of(F.col("keywords"), F.col("title"), F.col("summary")).alias("z"))
    return p.select("paper_id", "z.base_direction", "z.operator", T.short_hash(F.col("z.gap")).alias("gap"))


_S = "s as (select distinct on (sample_id) * from hindsight_samples)"
_Z = "z as (select distinct on (dz_id) * from dz_rows)"
_I = "i as (select distinct on (pred_id) * from idea_predictions)"
_F = "f as (select distinct on (forecast_id) * from scored_forecasts)"
_CUT = "try_cast(case when length(trim({0})) = 7 then trim({0}) || '-01' else trim({0}) end as date)"
_PUB = "case when length(trim({0})) = 7 then last_day(try_cast(trim({0}) || '-01' as date)) else try_cast(trim({0}) as date) end"
_SC = f"sc as (select *, {_CUT.format('cutoff_date')} cut, {_PUB.format('future_paper_published_date')} pub from s)"
_IC = f"ic as (select *, {_CUT.format('cutoff_date')} cut from i)"
_IDEA = "concat_ws(' ', title, rationale, approach, nullif(array_to_string(list_filter(list_transform(coalesce(key_terms, []), lambda x: trim(x, ' ')), lambda x: x <> ''), ' '), ''))"
_PAPER = "concat(coalesce(title, ''), ' Keywords: ', coalesce(array_to_string(keywords, ', '), ''), ' ', coalesce(summary, ''))"
_OV = "(len(list_intersect({0}, {1})) / least(len({0}), len({1})))"
_JAC = "(len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))))"
SQL = {
    "topic_selection": "select distinct d.topic_id, t.topic_id is not null known from documents d left join topics t using (topic_id) where d.topic_id is not null",
    "cutoff_training": f"with {_S}, {_SC}, m as (select distinct strftime(cut, '%Y-%m') as month from sc where cut is not null) select month, (select max(month) from m) evaluated, month < (select max(month) from m) trained from m",
    "active_runs": f"with {_F}, r as (select strategy_id, topic_id, count(*) filter (where realization_score >= 0.9) m, count(prior_score) > 1 g, count(realization_score) > 2 b from f where topic_id is not null group by 1, 2) select strategy_id, count(*)::int runs, (count(*) filter (where m > 0 or g or b))::int active from r group by 1",
    "nested_ideas": f"""with {_I}, k as (select strategy_id id, topic_id, coalesce(trim(cutoff_date, ' '), '') cutoff, rank, pred_id from i), h as (select distinct id from k where topic_id is not null)
      select id, topic_id, cutoff, rank, pred_id from k where topic_id is not null union all select id, 'legacy', max(cutoff) over (partition by id), rank, pred_id from k where topic_id is null and id not in (select id from h)""",
    "normalized_records": f"with {_S} select sample_id, coalesce(nullif(trim(split, ' '), ''), 'unknown') split, coalesce(nullif(trim(source, ' '), ''), '-') source, coalesce(context_paper_count, 0) context_paper_count from s",
    "contract_round_trip": f"with {_Z} select count(*) as rows, count(*) unchanged from z",
    "target_papers": f"with {_S}, {_SC}, k as (select *, coalesce(pub, date_trunc('month', cut)::date) d from sc where episode_id is not null and future_paper_id is not null) select topic_id, episode_id, (list(future_paper_id order by d, future_paper_id))[1] target from k where d is not null group by all",
    "run_errors": f"with {_F}, g as (select strategy_id, topic_id, count(*) filter (where joint_score is not null and not isnan(joint_score)) ok from f where topic_id is not null group by 1, 2) select strategy_id, string_agg(topic_id || ': no score', '; ' order by topic_id) filter (where ok = 0) errors from g group by 1",
    "calendar_splits": f"with {_S}, {_SC} select case when cut >= date '2025-01-01' then 'test' when cut >= date '2024-04-01' then 'validation' else 'train' end as label, count(*) n from sc where cut is not null group by 1",
    "hindsight_dataset": f"""with {PAPERS}, {_S}, {_SC}, w as (select distinct topic_id, cut from sc where topic_id is not null and cut is not null), r as (select w.topic_id, w.cut, p.paper_id, row_number() over (partition by w.topic_id, w.cut order by published, p.paper_id)::int place from w join p on p.topic_id = w.topic_id
      and published > cut and published <= last_day((date_trunc('month', cut) + interval 3 month)::date)), l as (select future_paper_id paper_id, (list(innovation.gap order by sample_id))[1] gap from s where future_paper_id is not null and innovation.gap is not null group by 1) select paper_id, topic_id, cut, place, gap from r join l using (paper_id) where place <= 2""",
    "rendered_memory": f"""with {_Z} select topic_id, count(*)::int entries, substr(sha256(string_agg('{{"id":' || dz_id || ',"gap":' || to_json(target_z.gap)::varchar || '}}', chr(10) order by dz_id)), 1, 16) h from z where topic_id is not null and target_z.gap is not null group by 1""",
    "index_build": f"""with e as (select distinct on (vec_id) * from index_entries) select kind, cutoff_date, count(*) entries, count(*) filter (where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0) usable,
      count(*) filter (where kind = 'future' and {_PUB.format('published_date')} <= {_CUT.format('cutoff_date')}) leaks from e group by 1, 2""",
    "reward_payloads": f"""with {PAPERS}, {_S}, n as (select lower(trim(name, ' ')) name, min(op_id) op from (select op_id, unnest(list_concat([op_id, op_name], coalesce(aliases, []))) name from operator_inventory) group by 1)
      select sample_id, coalesce(case when sample_id % 3 > 0 then nullif(s.topic_id, '') end, nullif(p.topic_id, ''), '') topic, coalesce(n.op, 'other') operator, substr(sha256(coalesce(title, '')), 1, 16) candidate from s left join n on n.name = lower(trim(innovation.operator, ' ')) left join p on p.paper_id = future_paper_id""",
    "metric_rewards": f"with {_F} select forecast_id, " + ", ".join(f"round(least(greatest(coalesce(case when not isnan({c}) then {c} end, 0), 0), 1), 4) {m}" for m, c in (("soft", "joint_score"), ("coverage", "realization_score"), ("novelty", "prior_score"))) + " from f",
    "strict_reasons": f"""with {_Z} select case when dz_id % 11 = 0 or target_z is null then 'missing_innovation' when coalesce(len(context_paper_ids), 0) = 0 then 'stepwise_rollout_required' when dz_id % 7 = 0 then 'innovation_mismatch' when len(context_paper_ids) < 2 then 'unfinished_rollout' when memory_text is null then 'no_memory' else 'valid' end reason, count(*) n from z group by 1""",
    "static_predictions": f"with {_I}, {_IC} select pred_id, row_number() over (partition by strategy_id, topic_id, cut order by rank nulls last, pred_id)::int rank from ic where topic_id is not null qualify row_number() over (partition by strategy_id, topic_id, cut order by rank nulls last, pred_id) <= 3",
    "strict_rollouts": f"""with recursive {_Z}, a as (select dz_id, unnest(context_paper_ids) paper, generate_subscripts(context_paper_ids, 1) n from z where context_paper_ids is not null), b as (select *, n - 1 k, lag(paper) over (partition by dz_id order by n) before from a where n <= 6),
      r as (select dz_id, 0::bigint n, []::varchar[] selected, 0 searches, 0 invalid from (select distinct dz_id from b) union all
       select r.dz_id, b.n, case when k % 2 = 1 and not list_contains(selected, before) and len(selected) < 2 then list_append(selected, before) else selected end, searches + (k % 2 = 0 and searches < 3)::int, invalid + ((k % 2 = 0 and searches >= 3) or (k % 2 = 1 and not list_contains(selected, before) and len(selected) >= 2))::int from r join b on b.dz_id = r.dz_id and b.n = r.n + 1)
      select dz_id, searches, array_to_string(selected, '|') selected, invalid from r qualify row_number() over (partition by dz_id order by n desc) = 1""",
    "baseline_check": f"with {_F}, g as (select strategy_id, bool_or(coalesce(not isnan(joint_score), false)) has from f group by 1) select coalesce(bool_or(has), false) any_baseline, count(*) filter (where not has) to_bootstrap from g",
    "month_advance": f"with {PAPERS}, {_I}, {_IC} select strategy_id, max(strftime(cut, '%Y-%m')) own, greatest(max(strftime(cut, '%Y-%m')), (select strftime(max(published), '%Y-%m') from p)) end_month from ic group by 1",
    "rubric_blocks": """select topic_id, 'Topic: ' || topic_name || case when len(coalesce(aliases, [])) > 0 then chr(10) || 'Operator focus: ' || array_to_string(aliases, ', ') else '' end || case when len(coalesce(keywords, [])) > 0 then chr(10) || 'Match criteria:' || array_to_string(list_transform(keywords, lambda x: chr(10) || '  - ' || x), '') else '' end block from topics""",
    "rubric_refresh": f"""with {_F}, k as (select topic_id, prior_score p, realization_score >= 0.5 l from f where topic_id is not null and prior_score is not null and realization_score is not null), r as (select *, rank() over (partition by topic_id order by p) + (count(*) over (partition by topic_id, p) - 1) / 2 rk from k),
      g as (select topic_id, count(*) filter (where l) positives, count(*) filter (where not l) negatives, sum(rk) filter (where l) s from r group by 1), a as (select *, case when positives > 0 and negatives > 0 then round((s - positives * (positives + 1) / 2) / (positives * negatives), 6) end auc from g)
      select topic_id, positives, negatives, positives > 0 and negatives > 0 and coalesce(auc, 0) >= 0.5 accepted, 1 + (positives > 0 and negatives > 0 and coalesce(auc, 0) >= 0.5)::int as version, case when positives = 0 or negatives = 0 then 'too few rollouts' when coalesce(auc, 0) >= 0.5 then 'passed' else 'rejected' end reason from a""",
    "daily_job": f"""with {PAPERS}, {_I}, {_IC}, j as (select *, max(cut) over (partition by strategy_id) l from ic where topic_id is not null and cut is not null), o as (select strategy_id, topic_id, cut, row_number() over (partition by strategy_id, topic_id order by score desc nulls last, pred_id)::int rank, {TOK.format(_IDEA)} a from j where cut = l qualify rank <= 5),
      r as (select topic_id, paper_id paper, published, {TOK.format(_PAPER)} b from p where topic_id is not null and published is not null and ingested_at >= timestamp '2025-12-31' - interval 60 day), x as (select strategy_id, topic_id, cut, rank, paper, round(case when len(a) + len(b) = 0 then 0 else {_JAC.format('a', 'b')} end, 6) score from o join r using (topic_id) where published > cut),
      q as (select strategy_id, topic_id, cut, list([{{'rank': rank, 'paper': paper}}] order by rank, score desc, paper desc) c from x where score > 0.1 group by all),
      t as (select strategy_id, unnest(list_reduce(c, lambda acc, y: case when len(list_filter(acc, lambda v: v.rank = y[1].rank or v.paper = y[1].paper)) > 0 then acc else list_concat(acc, y) end)) t from q), h as (select strategy_id, count(*) matched, min(t.rank) f from t group by 1)
      select strategy_id, count(*) predictions, coalesce(any_value(matched), 0) matched, floor((14 * ((coalesce(any_value(matched), 0) > 0)::int * 10000) + 6 * round(round(coalesce(1.0 / any_value(f), 0), 4) * 10000) + 10) / 20) / 10000 score from o left join h using (strategy_id) group by 1""",
    "generated_predictions": f"""with {PAPERS}, {_I}, {_IC}, w as (select distinct topic_id, cut from ic where topic_id is not null and cut is not null), met as (select w.topic_id, w.cut, p.paper_id, published, coalesce(title, '') title from w join p on p.topic_id = w.topic_id and published <= cut and year(cut) * 12 + month(cut) - year(published) * 12 - month(published) between 0 and 5),
      t as (select topic_id, cut, t, count(*) n from (select topic_id, cut, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) t from met) where length(t) >= 4 and t not in {T.TERM_STOP_WORDS} group by all), l as (select topic_id, cut, list(t order by r) w from (select *, row_number() over (partition by topic_id, cut order by n desc, t) r from t) where r <= 10 group by all),
      e as (select topic_id, cut, i, w[i % len(w) + 1] a, w[(i * 3 + 1) % len(w) + 1] b from (select *, unnest(range(6)) i from l)), g as (select topic_id, cut, a, b, min(i) i from e where a <> b group by all)
      select 'term_pairs' strategy, topic_id, cut, row_number() over (partition by topic_id, cut order by i)::int rank, a || ' meets ' || b title from g qualify rank <= 3
      union all select 'latest_titles', topic_id, cut, row_number() over (partition by topic_id, cut order by published desc, paper_id)::int, title from met qualify row_number() over (partition by topic_id, cut order by published desc, paper_id) <= 3""",
    "stub_judge": f"""with {_I}, t as (select pred_id, {TOK.format("coalesce(title, '')")} a, {TOK.format("coalesce(rationale, '')")} b from i) select pred_id, round(case when least(len(a), len(b)) = 0 then 0 else {_OV.format('a', 'b')} end, 4) score from t""",
    "joint_inference": f"""with {_F}, k as (select strategy_id, topic_id, forecast_id, case when proposal_text is null then -0.05 else round(least(greatest((coalesce(case when not isnan(prior_score) then prior_score end, 0) * 0.4::double + coalesce(case when not isnan(realization_score) then realization_score end, 0) * 0.6::double) / (0.4::double + 0.6::double), 0), 1), 4) end::double reward from f where topic_id is not null)
      select *, row_number() over (partition by strategy_id, topic_id order by reward desc, forecast_id)::int place from k qualify place <= 3""",
    "upserted_records": f"with {_I} select case when pred_id % 10 = 0 then 99 else rank end as rank, count(*) n from i where pred_id % 20 <> 0 group by 1",
    "paper_lookup": f"with {PAPERS}, {_S} select sample_id, future_paper_id paper_id, popularity_score, case when p.paper_id is not null then coalesce(len(refs), 0)::int end n_refs from s left join p on p.paper_id = future_paper_id where future_paper_id is not null",
    "community_overlap": f"""with {PAPERS}, e as (select distinct paper_id, unnest(refs) m from p), n as (select m, count(*) c from e where m is not null group by 1), o as (select paper_id, count(*) own, count(*) filter (where c > 1) common from e join n using (m) group by 1) select p.paper_id, coalesce(round(common / own, 6), 0) overlap from p left join o using (paper_id)""",
    "corpus_search": f"""with {PAPERS}, {_S}, q as (select topic_id, sample_id q, {TOK.format('innovation.gap')} a from s where sample_id % 50 = 0 and topic_id is not null and innovation.gap is not null), r as (select topic_id, paper_id p, strftime(published, '%Y-%m') as month, {TOK.format(_PAPER)} b from p where topic_id is not null),
      x as (select q, r.p, month, round(greatest({_OV.format('a', 'b')}, {_JAC.format('a', 'b')}), 6) score from q join r using (topic_id) where len(list_intersect(a, b)) > 0) select *, row_number() over (partition by q order by score desc, month nulls first, p)::int place from x qualify place <= 3""",
    "heuristic_triples": f"""with {PAPERS} select paper_id, case when len(coalesce(keywords, [])) > 0 then array_to_string(keywords[1:3], ' ') else array_to_string(list_filter(regexp_split_to_array(trim(title, ' '), '\\s+'), lambda x: x <> '')[1:5], ' ') end base_direction, 'extend' operator, substr(sha256(coalesce(case when summary <> '' then substr(summary, 1, 100) end, title)), 1, 16) gap from p where title is not null""",
}
QUERIES = {
    f.__name__: f
    for f in (
        topic_selection, cutoff_training, active_runs, nested_ideas, normalized_records, contract_round_trip, target_papers, run_errors, calendar_splits, hindsight_dataset, rendered_memory, index_build, reward_payloads, metric_rewards, strict_reasons, static_predictions, strict_rollouts,
        baseline_check, month_advance, rubric_blocks, rubric_refresh, daily_job, generated_predictions, stub_judge, joint_inference, upserted_records, paper_lookup, community_overlap, corpus_search, heuristic_triples,
    )
}
