"""Queries over the joins, aggregations, folds and rank statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import aggregates as A
from skein.operators import folds, joins
from skein.operators import statistics as S
from skein.plans.scalar_queries import PAPERS, TOK, jac, papers
from skein.plans.windows_queries import IDEA_TEXT, PAPER_TEXT
from skein.sources.tables import table


def _ideas(spark, d):
    return table(spark, d, "idea_predictions").dropDuplicates(["pred_id"])


def _samples(spark, d):
    return table(spark, d, "hindsight_samples").dropDuplicates(["sample_id"])


def _forecasts(spark, d):
    return table(spark, d, "scored_forecasts").select("forecast_id", "strategy_id", "topic_id", "cutoff_t", "rank", "prior_score", "realization_score", "joint_score").dropDuplicates(["forecast_id"])


def _idea_text():
    return T.idea_text(F.col("title"), F.col("rationale"), F.col("approach"), F.col("key_terms"))


def _paper_text():
    return T.paper_text(F.col("title"), F.col("keywords"), F.col("summary"))


def _usable(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding")


# joins


def topic_phrase_join(spark, d):
    p = papers(spark, d)
    text = F.concat_ws(" ", "title", "summary", F.array_join("keywords", " "))
    return joins.phrase_join(p, "paper_id", text, joins.topic_terms(table(spark, d, "topics")))


def overlap_retrieval_topk(spark, d):
    ideas = _ideas(spark, d).filter("topic_id is not null")
    p = papers(spark, d).filter("topic_id is not null")
    return joins.token_retrieval(ideas, "pred_id", _idea_text(), p, "paper_id", _paper_text(), 3, ["topic_id"])


def priority_join(spark, d):
    z = table(spark, d, "dz_rows").dropDuplicates(["dz_id"]).select(F.col("dz_id").alias("row_id"), F.col("source_future_id").alias("paper"), F.trim("cutoff_t").alias("cutoff"), F.col("target_z.gap").alias("fallback"))
    s = _samples(spark, d).select("sample_id", F.col("future_paper_id").alias("paper"), F.trim("cutoff_date").alias("cutoff"), F.col("innovation.gap").alias("value")).filter("paper is not null and cutoff is not null")
    return joins.priority_join(z, s)


def episode_fan_out(spark, d):
    episodes = table(spark, d, "dz_rows").dropDuplicates(["dz_id"]).select(F.col("dz_id").alias("episode"), F.explode_outer("context_paper_ids").alias("paper"))
    return joins.fan_out(episodes, _samples(spark, d).select("sample_id", F.col("future_paper_id").alias("paper")).filter("paper is not null"))


def paper_topic_first(spark, d):
    z = table(spark, d, "dz_rows").dropDuplicates(["dz_id"]).filter("source_future_id is not null")
    return joins.first_wins(z, "source_future_id", "topic_id", [F.col("dz_id")])


def citation_pairs(spark, d):
    return joins.citation_overlap(papers(spark, d), "paper_id", "refs").filter("shared >= 2")


def citation_hits(spark, d):
    p = papers(spark, d)
    cites = p.select(F.explode("refs").alias("ref"))
    hits = _samples(spark, d).select(F.col("future_paper_id").alias("paper")).distinct().withColumn("_h", F.lit(True))
    candidates = p.select(F.col("paper_id").alias("paper")).join(hits, "paper", "left").select("paper", F.coalesce("_h", F.lit(False)).alias("hit"))
    return joins.hit_control_citation(candidates, cites)


def known_papers(spark, d):
    """Set operations: papers that samples name, papers that no training row names, names without a paper."""
    p = papers(spark, d).select("paper_id")
    s, z = _samples(spark, d).select(F.col("future_paper_id").alias("paper_id")), table(spark, d, "dz_rows").select(F.col("source_future_id").alias("paper_id"))
    named = p.join(s, "paper_id", "left_semi").withColumn("what", F.lit("sampled"))
    bare = p.join(z, "paper_id", "left_anti").withColumn("what", F.lit("untrained"))
    unknown = s.unionByName(z).filter("paper_id is not null").distinct().join(p, "paper_id", "left_anti").withColumn("what", F.lit("unknown"))
    return named.unionByName(bare).unionByName(unknown).groupBy("what").agg(F.count("*").alias("n"))


def topic_seed(spark, d):
    facts = _ideas(spark, d).groupBy("topic_id").agg(F.count("*").alias("ideas"), V.exact_mean(T.coerced_score(F.col("score"))).alias("score"))
    return joins.hierarchy_fill(table(spark, d, "topics").select("topic_id", "topic_name"), facts, "topic_id", {"ideas": 0, "score": 0.0})


# aggregations


def top_terms(spark, d):
    return A.top_terms(papers(spark, d), F.coalesce("title", F.lit("")), 50)


def _keywords(spark, d):
    return A.document_keywords(papers(spark, d), "paper_id", "keywords")


def term_cooccurrence(spark, d):
    return A.frequent_pairs(_keywords(spark, d), "paper_id", 2)


def keyword_components(spark, d):
    return A.keyword_clusters(_keywords(spark, d), "paper_id", 3, 12)


def keyword_momentum(spark, d):
    p = papers(spark, d)
    kw = _keywords(spark, d).join(p.select("paper_id", "published"), "paper_id")
    members = A.cluster_members(_keywords(spark, d), "paper_id", 3).select("kw", "cluster")
    return A.cluster_momentum(kw, members, "paper_id", D.month_index(F.col("published")), 2025 * 12 + 5, 6)


def memory_build(spark, d):
    s = _samples(spark, d).filter("innovation is not null")
    cut, pub = D.cutoff_date(F.col("cutoff_date")), D.published_date(F.col("future_paper_published_date"))
    z = F.struct(F.lower(F.trim("innovation.operator")).alias("operator"), F.col("topic_id"), F.col("source"))
    s = s.select(z.alias("z"), F.col("future_paper_id").alias("source"), D.month_index(cut).alias("m"), F.struct(F.coalesce(pub, F.lit("1900-01-01").cast("date")).alias("pub"), "sample_id").alias("ord"))
    return A.build_memory(s, 2025 * 12 + 11).withColumn("recency", F.round("recency", 6)).withColumnRenamed("source", "src").toDF("operator", "topic_id", "via", "frequency", "source", "m", "recency")


def memory_topn(spark, d):
    m = memory_build(spark, d).withColumn("utility", (F.col("frequency") % 3).cast("double"))
    m = m.select("operator", "topic_id", "via", "frequency", "recency", "utility").fillna("", ["operator", "topic_id", "via"]).fillna(0.0, ["recency"])
    return A.top_memory(m, 25).select("operator", "topic_id", "via", "frequency", "blend")


def bucket_memory(spark, d):
    return A.bucket_memory(papers(spark, d), F.get("keywords", F.lit(0)), "published", "paper_id", "title", F.lit("2025-01-31").cast("date"), 6, 25)


def operator_distribution(spark, d):
    inventory = table(spark, d, "operator_inventory").select("op_id")
    n = table(spark, d, "dz_rows").dropDuplicates(["dz_id"]).groupBy(F.col("operator_closed").alias("op_id")).agg(F.count("*").alias("n"))
    return joins.hierarchy_fill(inventory, n, "op_id", {"n": 0})


def popularity_minmax(spark, d):
    return S.min_max(papers(spark, d).select("paper_id", "popularity_score"), "popularity_score", "scaled").select("paper_id", "scaled", F.round(V.popularity_weight(F.col("scaled")), 6).alias("weight"))


def impact_buckets(spark, d):
    cited = papers(spark, d).select(F.explode("refs").alias("paper_id")).groupBy("paper_id").agg(F.count("*").alias("cites"))
    return S.impact_buckets(papers(spark, d).join(cited, "paper_id", "left"), F.col("cites"), F.col("popularity_score"))


def strategy_leaderboard(spark, d):
    w = Window.partitionBy("strategy_id", "topic_id", "cutoff_t").orderBy(F.desc("joint_score"), "forecast_id")
    f = _forecasts(spark, d).filter("joint_score is not null and not isnan(joint_score)").withColumn("place", F.row_number().over(w)).filter("place <= 5")
    windows = f.groupBy("strategy_id", "topic_id", "cutoff_t").agg(F.max((F.col("realization_score") >= 0.7).cast("double")).alias("hit"), F.coalesce(60 / F.min(F.when(F.col("realization_score") >= 0.7, F.col("place"))), F.lit(0)).cast("bigint").alias("mrr"))
    # reciprocals of places up to 5 are summed in sixtieths
    per = windows.groupBy("strategy_id").agg(F.count("*").alias("windows"), V.exact_mean(F.col("hit")).alias("hit"), (F.floor((20_000 * F.sum("mrr") + 60 * F.count("*")) / (120 * F.count("*"))) / 10_000).alias("mrr"))
    return per.withColumn("score", V.leaderboard_score(F.coalesce("hit", F.lit(-1.0)), F.coalesce("mrr", F.lit(0.0)))).orderBy(F.desc("score"), "strategy_id")


def strategy_rollup(spark, d):
    f = _forecasts(spark, d).filter("topic_id is not null")
    per = f.groupBy("strategy_id", "topic_id").agg(F.count("*").alias("n"), F.avg("prior_score").alias("prior"), F.avg("realization_score").alias("realization"))
    return A.weighted_rollup(per, ["topic_id"], "n", ["prior", "realization"])


def coverage_audit(spark, d):
    return A.coverage_audit(_forecasts(spark, d), "topic_id", "cutoff_t")


def status_rollup(spark, d):
    status = F.when(F.isnan("joint_score"), "running").when(F.col("joint_score").isNull(), "failed").when(F.col("rank") == 0, "pending").otherwise("completed")
    return A.status_rollup(_forecasts(spark, d), ["strategy_id"], status)


def rank_disorder(spark, d):
    """Groups in which the rank reported is repeated, zero, or at odds with the order of the scores."""
    g = _forecasts(spark, d).groupBy("strategy_id", "topic_id", "cutoff_t").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("ranks"), F.count_if(F.col("rank") == 0).alias("zeros"))
    return g.groupBy("topic_id").agg(F.sum("n").alias("n"), F.sum("zeros").alias("zero"), F.sum(F.when(F.col("ranks") < F.col("n"), F.col("n")).otherwise(0)).alias("in_repeated"))


def midpoint_sample(spark, d):
    return A.midpoint_sample(papers(spark, d).select("topic_id", "paper_id", "published"), ["topic_id"], ["published", "paper_id"], 7).select("topic_id", "paper_id")


def reward_quantiles(spark, d):
    f = _ideas(spark, d).filter("score is not null").select("topic_id", "pred_id", "score")
    return A.quantile_groups(f, ["topic_id"], "score", "pred_id", 0.2, 2).select("topic_id", "pred_id", "side")


def episode_splits(spark, d):
    e = _samples(spark, d).select("topic_id", "episode_id").distinct()
    return A.split_labels(e, ["topic_id", "episode_id"], 0.7, 0.15)


# folds


def greedy_dedupe(spark, d):
    i = _ideas(spark, d).filter("topic_id is not null")
    return folds.greedy_dedupe(i, ["strategy_id", "topic_id", "cutoff_date"], ["pred_id"], "pred_id", F.coalesce("rationale", F.lit("")), 0.5)


def mmr_select(spark, d):
    """Three ideas of each window (strategy, topic, cutoff) out of all of them; those without a valid cutoff are one window."""
    i = _ideas(spark, d).filter("topic_id is not null").withColumns({"s": F.coalesce(T.coerced_score(F.col("score")), F.lit(0.0)), "cut": D.cutoff_date(F.col("cutoff_date"))})
    return folds.mmr_select(i, ["strategy_id", "topic_id", "cut"], "pred_id", "s", T.prediction_text(F.col("title"), F.col("rationale"), F.col("approach")), 3)


def utility_ema(spark, d):
    e = table(spark, d, "events")
    by_day = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return folds.ema(by_day, ["user_id"], ["day"], "v")


def search_states(spark, d):
    z = table(spark, d, "dz_rows").dropDuplicates(["dz_id"]).filter("context_paper_ids is not null").select("dz_id", F.posexplode("context_paper_ids").alias("step", "paper"))
    kind = F.element_at(F.array(F.lit("search"), F.lit("select"), F.lit("search"), F.lit("finish")), (F.col("step") % 4 + 1).cast("int"))
    ids = F.when(F.col("step") % 4 == 1, F.array(F.lag("paper").over(Window.partitionBy("dz_id").orderBy("step")))).otherwise(F.array("paper"))
    return folds.search_states(z.select("dz_id", "step", kind.alias("type"), ids.alias("ids")), "dz_id", 3, 2)


def balanced_split(spark, d):
    sizes = papers(spark, d).filter("topic_id is not null").groupBy("topic_id").agg(F.count("*").alias("n"))
    return folds.balanced_split(sizes, "topic_id", "n", 4)


def group_dup_penalty(spark, d):
    i = _ideas(spark, d).filter("topic_id is not null and cutoff_date is not null")
    return folds.duplicate_penalty(i, ["strategy_id", "topic_id", "cutoff_date"], "pred_id", F.coalesce("rationale", F.lit("")), 0.3)


# statistics


def auc_quality(spark, d):
    j = table(spark, d, "doc_labels").join(table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n")), "doc_id")
    return S.auc(j, "n", "abusive", ["source"])


def rank_corr(spark, d):
    return S.spearman(_forecasts(spark, d), "prior_score", "realization_score", ["topic_id"])


def mann_whitney_buckets(spark, d):
    s = _samples(spark, d).withColumn("days", F.datediff(D.published_date(F.col("future_paper_published_date")), D.cutoff_date(F.col("cutoff_date"))))
    return S.mann_whitney(s, "days", F.col("split").eqNullSafe("test"), ["topic_id"])


def lead_time_buckets(spark, d):
    s = _samples(spark, d)
    cut, pub = D.cutoff_date(F.col("cutoff_date")), D.published_date(F.col("future_paper_published_date"))
    f = F.when(cut.isNotNull() & pub.isNotNull(), D.lead_time_fraction(pub, cut, F.last_day(F.add_months(cut, 3))))
    return s.groupBy(S.thirds(f).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("split") == "test").cast("double")), 6).alias("test_share"))


def validation_report(spark, d):
    j = table(spark, d, "doc_labels").join(table(spark, d, "documents").select("doc_id", "doc_kind", F.length("text").alias("n")), "doc_id")
    return S.validation_report(j, ["doc_kind"], "n", "abusive")


def group_advantage(spark, d):
    return S.group_advantage(_ideas(spark, d).filter("score is not null").select("pred_id", "topic_id", "cutoff_date", T.coerced_score(F.col("score")).alias("s")), ["topic_id", "cutoff_date"], "s").select("pred_id", "advantage")


def mmd_rbf(spark, d):
    """All vectors in two samples, by odd and even label."""
    return S.mmd(_usable(spark, d), "embedding", F.pmod("label", F.lit(2)) == 1, "vec_id")


def wasserstein_1d(spark, d):
    return S.wasserstein(_forecasts(spark, d), "prior_score", F.col("strategy_id").startswith("strat-shared"))


def cosine_topr(spark, d):
    e = _usable(spark, d)
    a, b = e.select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("va")), e.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("vb"))
    pairs = a.filter("a % 50 = 0").join(b, "label").filter("a <> b").withColumn("cos", F.round(V.clamped_cosine(F.col("va"), F.col("vb")), 5))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))).filter("place <= 5").select("a", "b", "cos", "place")


def vector_novelty(spark, d):
    e = _usable(spark, d)
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    pairs = a.filter("a % 50 = 0").join(b, F.col("a") != F.col("b")).withColumn("cos", V.cosine(F.col("va"), F.col("vb")))
    return A.novelty(a.filter("a % 50 = 0"), "a", pairs, "cos")


def cluster_gated_coverage(spark, d):
    e = _usable(spark, d)
    a, b = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), e.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("vb"))
    pairs = a.join(b, F.col("a") != F.col("b")).withColumn("cos", V.clamped_cosine(F.col("va"), F.col("vb")))
    return A.gated_coverage(pairs, ["a"], "label", "cos", 0.3)


_I = "i as (select distinct on (pred_id) * from idea_predictions)"
_S = "s as (select distinct on (sample_id) * from hindsight_samples)"
_Z = "z as (select distinct on (dz_id) * from dz_rows)"
_F = "f as (select distinct on (forecast_id) * from scored_forecasts)"
_CUT = "try_cast(case when length(trim({0})) = 7 then trim({0}) || '-01' else trim({0}) end as date)"
_PUB = "case when length(trim({0})) = 7 then last_day(try_cast(trim({0}) || '-01' as date)) else try_cast(trim({0}) as date) end"
_CO = "case when score is not null then round(least(greatest(case when score > 1 then score / 10 else score end, 0), 1), 4) end"
_KW = f"{PAPERS}, kw as (select distinct paper_id, published, trim(lower(k)) kw from (select paper_id, published, unnest(keywords) k from p) where length(trim(lower(k))) > 2)"
_V = "v as (select vec_id, label, embedding::double[64] e from embeddings)"
_SD = f"sd as (select *, {_CUT.format('cutoff_date')} cut, {_PUB.format('future_paper_published_date')} pub from s)"

SQL = {
    "topic_phrase_join": f"""with {PAPERS}, t as (select distinct topic_id topic, array_to_string(regexp_extract_all(lower(r), '[a-z0-9]+'), ' ') term from (select topic_id, unnest(list_concat([topic_name], coalesce(aliases, []), coalesce(keywords, []))) r from topics)),
      c as (select paper_id, ' ' || array_to_string(regexp_extract_all(lower(concat_ws(' ', title, summary, array_to_string(keywords, ' '))), '[a-z0-9]+'), ' ') || ' ' c from p)
      select distinct paper_id, topic from c join t on term <> '' and contains(c, ' ' || term || ' ')""",
    "overlap_retrieval_topk": f"""with {_I}, {PAPERS}, q as (select pred_id q, topic_id, {TOK.format(IDEA_TEXT)} a from i where topic_id is not null), r as (select paper_id p, topic_id, {TOK.format(PAPER_TEXT)} b from p where topic_id is not null),
      x as (select q, p, len(list_intersect(a, b)) common, len(a) la, len(b) lb from q join r using (topic_id)), y as (select q, p, common, round(common / least(la, lb), 6) overlap, round(common / (la + lb - common), 6) jaccard from x where common > 0)
      select * from (select *, row_number() over (partition by q order by overlap desc, jaccard desc, p)::int place from y) where place <= 3""",
    "priority_join": f"""with {_Z}, {_S}, k as (select sample_id, future_paper_id paper, trim(cutoff_date) cutoff, innovation.gap v from s where future_paper_id is not null and cutoff_date is not null),
      x as (select paper, cutoff, arg_min_null(v, sample_id) v, 1 h from k group by all), l as (select paper, (list(v order by cutoff desc, sample_id))[1] v, 1 h from k group by paper)
      select dz_id row_id, case when x.h = 1 then x.v when l.h = 1 then l.v else target_z.gap end as value, case when x.h = 1 then 'exact' when l.h = 1 then 'latest' else 'derived' end how
      from z left join x on x.paper = source_future_id and x.cutoff = trim(cutoff_t) left join l on l.paper = source_future_id""",
    "episode_fan_out": f"""with {_Z}, {_S}, e as (select dz_id episode, unnest(case when coalesce(len(context_paper_ids), 0) = 0 then [null] else context_paper_ids end) paper from z), f as (select episode, sample_id from e join s on future_paper_id = paper)
      select * from f union all select distinct episode, null from e where episode not in (select episode from f)""",
    "paper_topic_first": f"with {_Z} select source_future_id, arg_min_null(topic_id, dz_id) topic_id from z where source_future_id is not null group by 1",
    "citation_pairs": f"with {PAPERS}, c as (select distinct paper_id, unnest(refs) r from p) select a.paper_id a, b.paper_id b, count(*) shared from c a join c b on a.r = b.r and a.paper_id < b.paper_id group by all having count(*) >= 2",
    "citation_hits": f"with {PAPERS}, c as (select distinct unnest(refs) r from p), x as (select paper_id in (select future_paper_id from hindsight_samples where future_paper_id is not null) hit, paper_id in (select r from c where r is not null) cited from p) select hit, count(*) papers, round(avg(cited::int), 6) cited_share from x group by hit",
    "known_papers": f"""with {PAPERS}, n as (select future_paper_id x from hindsight_samples union select source_future_id from dz_rows) select 'sampled' what, count(*) n from p where paper_id in (select future_paper_id from hindsight_samples)
      union all select 'untrained', count(*) from p where paper_id not in (select source_future_id from dz_rows where source_future_id is not null) union all select 'unknown', count(*) from n where x is not null and x not in (select paper_id from p)""",
    "topic_seed": f"with {_I}, a as (select topic_id, count(*) ideas, floor((2 * sum(round({_CO} * 10000)::bigint) + count({_CO})) / nullif(2 * count({_CO}), 0)) / 10000 score from i where true group by 1) select topic_id, topic_name, coalesce(ideas, 0) ideas, coalesce(score, 0) score from topics left join a using (topic_id)",
    "top_terms": f"with {PAPERS}, t as (select unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) term from p) select term, count(*) n from t where length(term) >= 4 and term not in {T.TERM_STOP_WORDS} group by term order by n desc, term limit 50",
    "term_cooccurrence": f"with {_KW} select a.kw a, b.kw b, count(*) n from kw a join kw b on a.paper_id = b.paper_id and a.kw < b.kw group by all having count(*) >= 2",
    "keyword_components": f"""with recursive {_KW}, o as (select kw, count(*) f from kw group by kw having count(*) >= 3), e as (select a.kw a, b.kw b from kw a join kw b on a.paper_id = b.paper_id and a.kw < b.kw where a.kw in (select kw from o) and b.kw in (select kw from o) group by all having count(*) >= 3),
      u as (select a x, b y from e union select b, a from e), r(x, y) as (select kw, kw from o union select r.x, u.y from r join u on u.x = r.y), c as (select x kw, min(y) cluster from r group by x)
      select cluster, string_agg(kw, '|' order by f desc, kw) keywords, sum(f)::bigint total from c join o using (kw) group by cluster order by total desc, cluster limit 12""",
    "keyword_momentum": f"""with recursive {_KW}, o as (select kw, count(*) f from kw group by kw having count(*) >= 3), e as (select a.kw a, b.kw b from kw a join kw b on a.paper_id = b.paper_id and a.kw < b.kw where a.kw in (select kw from o) and b.kw in (select kw from o) group by all having count(*) >= 3),
      u as (select a x, b y from e union select b, a from e), r(x, y) as (select kw, kw from o union select r.x, u.y from r join u on u.x = r.y), l as (select x kw, min(y) cluster from r group by x),
      h as (select distinct cluster, paper_id, year(published)*12 + month(published) - 1 m from kw join l using (kw)), c as (select cluster, count(*) total, count(*) filter (where m between {2025 * 12} and {2025 * 12 + 5}) recent from h group by 1)
      select *, (recent * 3 - greatest(1, total // 6))::double momentum from c""",
    "memory_build": f"""with {_S}, {_SD}, k as (select lower(trim(innovation.operator, ' ')) operator, topic_id, source via, future_paper_id, year(cut)*12 + month(cut) - 1 m, coalesce(pub, date '1900-01-01') o, sample_id from sd where innovation is not null)
      select operator, topic_id, via, count(*) frequency, (list(future_paper_id order by o, sample_id))[1] source, (list(m order by o, sample_id))[1]::int m, round(pow(0.9, greatest(0, {2025 * 12 + 11} - (list(m order by o, sample_id))[1])), 6) recency from k group by 1, 2, 3""",
    "memory_topn": f"""with {_S}, {_SD}, k as (select coalesce(lower(trim(innovation.operator, ' ')), '') operator, coalesce(topic_id, '') topic_id, coalesce(source, '') via, innovation.operator o0, topic_id t0, source s0, year(cut)*12 + month(cut) - 1 m, coalesce(pub, date '1900-01-01') o, sample_id from sd where innovation is not null),
      b as (select operator, topic_id, via, count(*) frequency, coalesce(round(pow(0.9, greatest(0, {2025 * 12 + 11} - (list(m order by o, sample_id))[1])), 6), 0) recency from k group by operator, topic_id, via, o0 is null, t0 is null, s0 is null), x as (select *, max(frequency) over () mf from b)
      select operator, topic_id, via, frequency, round((0.45::double * recency + 0.35::double * frequency / mf + 0.2::double * tanh(frequency % 3)) / 1.0::double, 9) blend from x order by blend desc, operator, topic_id, via limit 25""",
    "mmr_select": f"""with {_I}, c as (select strategy_id, topic_id, {_CUT.format('cutoff_date')} cut, pred_id, coalesce({_CO}, 0)::double s, {TOK.format("concat_ws(' ', title, rationale, approach)")} w from i where topic_id is not null), n as (select *, row_number() over (partition by strategy_id, topic_id, cut order by s desc, pred_id) n from c),
      a as (select * from n where n = 1), y as (select n.*, {jac('n.w', 'a.w')} ja, round(0.65::double * n.s + 0.35::double * (1 - {jac('n.w', 'a.w')}), 9) v from n join a on n.strategy_id is not distinct from a.strategy_id and n.topic_id = a.topic_id and n.cut is not distinct from a.cut where n.n > 1),
      b as (select * from y qualify row_number() over (partition by strategy_id, topic_id, cut order by v desc, n) = 1),
      u as (select y.*, round(0.65::double * y.s + 0.35::double * (1 - greatest(y.ja, {jac('y.w', 'b.w')})), 9) v3 from y join b on y.strategy_id is not distinct from b.strategy_id and y.topic_id = b.topic_id and y.cut is not distinct from b.cut where y.n <> b.n)
      select strategy_id, topic_id, cut, pred_id, 1 place, round(s, 4) mmr from a union all select strategy_id, topic_id, cut, pred_id, 2, round(v, 4) from b
      union all select strategy_id, topic_id, cut, pred_id, 3, round(v3, 4) from (select * from u qualify row_number() over (partition by strategy_id, topic_id, cut order by v3 desc, n) = 1)""",
    "search_states": f"""with recursive {_Z}, a as (select dz_id, unnest(context_paper_ids) paper, generate_subscripts(context_paper_ids, 1) n from z where context_paper_ids is not null), b as (select *, (n - 1) % 4 k, lag(paper) over (partition by dz_id order by n) before from a),
      r as (select dz_id, 0::bigint n, []::varchar[] surfaced, []::varchar[] selected, 0 searches, false done, 0 invalid from (select distinct dz_id from b) union all
       select r.dz_id, b.n, case when not done and k in (0, 2) and searches < 3 and not list_contains(surfaced, paper) then list_append(surfaced, paper) else surfaced end,
        case when not done and k = 1 and list_contains(surfaced, before) and not list_contains(selected, before) and len(selected) < 2 then list_append(selected, before) else selected end,
        searches + (not done and k in (0, 2) and searches < 3)::int, done or k = 3,
        invalid + (done or (k in (0, 2) and searches >= 3) or (k = 1 and not (list_contains(surfaced, before) and (list_contains(selected, before) or len(selected) < 2))))::int from r join b on b.dz_id = r.dz_id and b.n = r.n + 1)
      select dz_id, len(surfaced)::int surfaced, array_to_string(selected, '|') selected, searches, done, invalid from r qualify row_number() over (partition by dz_id order by n desc) = 1""",
    "balanced_split": f"""with recursive {PAPERS}, g as (select topic_id, count(*) n from p where topic_id is not null group by 1), o as (select *, row_number() over (order by n desc, topic_id) i from g),
      r as (select 0::bigint i, [0, 0, 0, 0]::bigint[] load, null::varchar topic_id, null::int part union all select o.i, list_transform(load, lambda v, j: case when j = list_position(load, list_min(load)) then v + n else v end), o.topic_id, (list_position(load, list_min(load)) - 1)::int from r join o on o.i = r.i + 1)
      select topic_id, part from r where i > 0""",
    "greedy_dedupe": f"""with {_I}, g as (select strategy_id, topic_id, cutoff_date, list(pred_id order by pred_id) ids, list({TOK.format("coalesce(rationale, '')")} order by pred_id) w from i where topic_id is not null group by all),
      k as (select *, list_reduce(list_transform(range(1, len(ids) + 1), lambda x: [x]), lambda acc, x: case when len(list_filter(acc, lambda j: {jac('w[j]', 'w[x[1]]')} >= 0.5)) > 0 then acc else list_concat(acc, x) end) keep from g)
      select strategy_id, topic_id, cutoff_date, ids[unnest(keep)] pred_id, (generate_subscripts(keep, 1) - 1)::int as position from k""",
    "bucket_memory": f"with {PAPERS} select keywords[1] bucket, count(*) total, count(*) filter (where date '2025-01-31' - published <= 182) recent, (list(title order by published desc, paper_id desc))[1] latest from p where published <= date '2025-01-31' and keywords[1] is not null group by 1 order by recent desc, total desc, bucket limit 25",
    "operator_distribution": f"with {_Z} select op_id, count(dz_id) n from operator_inventory left join z on operator_closed = op_id group by op_id",
    "popularity_minmax": f"with {PAPERS}, b as (select min(popularity_score) lo, max(popularity_score) hi from p), x as (select paper_id, case when popularity_score is not null then round(case when hi > lo then (popularity_score - lo) / (hi - lo) else 1 end, 6) end scaled from p, b) select paper_id, scaled, round(0.1::double + 0.9::double * coalesce(scaled, 0), 6) weight from x",
    "impact_buckets": f"""with {PAPERS}, c as (select unnest(refs) r from p), n as (select r, count(*) cites from c group by r) select case when cites is null then 'all' when cites < 5 then 'low' when cites < 50 then 'mid' else 'high' end bucket, count(*) n, round(avg(popularity_score), 6) mean from p left join n on r = paper_id group by 1""",
    "strategy_leaderboard": f"""with {_F}, t as (select *, row_number() over (partition by strategy_id, topic_id, cutoff_t order by joint_score desc, forecast_id) place from f where joint_score is not null and not isnan(joint_score)),
      w as (select strategy_id, topic_id, cutoff_t, max(case when realization_score is null then null when realization_score >= 0.7 then 1.0 else 0.0 end)::double hit, coalesce(60 // min(place) filter (where realization_score >= 0.7), 0) mrr from t where place <= 5 group by 1, 2, 3),
      s as (select strategy_id, count(*) windows, floor((2 * sum(hit * 10000)::bigint + count(hit)) / nullif(2 * count(hit), 0)) / 10000 hit, floor((20000 * sum(mrr)::bigint + 60 * count(*)) / (120 * count(*))) / 10000 mrr from w group by 1)
      select *, floor((14 * round(coalesce(hit, -1) * 10000)::bigint + 6 * round(coalesce(mrr, 0) * 10000)::bigint + 10) / 20) / 10000 score from s order by score desc, strategy_id""",
    "strategy_rollup": f"with {_F}, x as (select strategy_id, topic_id, count(*) n, avg(prior_score) p, avg(realization_score) r from f where topic_id is not null group by 1, 2) select topic_id, sum(n)::bigint n, round(sum(coalesce(p, 0) * n) / sum(n), 4) prior, round(sum(coalesce(r, 0) * n) / sum(n), 4) realization from x group by 1",
    "coverage_audit": f"with {_F}, w as (select topic_id, cutoff_t, count(*) n from f group by all) select sum(n)::bigint as rows, count(distinct topic_id) topics, count(*) windows, sum(n - 1)::bigint repeated from w",
    "status_rollup": f"with {_F}, t as (select strategy_id, case when isnan(joint_score) then 'running' when joint_score is null then 'failed' when rank = 0 then 'pending' else 'completed' end s from f) select strategy_id, count(*) n, case when bool_or(s = 'running') then 'running' when bool_or(s = 'failed') then 'failed' when bool_and(s = 'completed') then 'completed' else 'pending' end status from t group by 1",
    "rank_disorder": f"with {_F}, g as (select strategy_id, topic_id, cutoff_t, count(*) n, count(distinct rank) r, count(*) filter (where rank = 0) z from f group by all) select topic_id, sum(n)::bigint n, sum(z)::bigint as zero, sum(case when r < n then n else 0 end)::bigint in_repeated from g group by 1",
    "midpoint_sample": f"with {PAPERS}, r as (select topic_id, paper_id, row_number() over (partition by topic_id order by published, paper_id) - 1 i, count(*) over (partition by topic_id) n from p), k as (select unnest(range(7)) s) select distinct topic_id, paper_id from r, k where n <= 7 or i = floor((s + 0.5) / 7 * n)",
    "reward_quantiles": f"with {_I}, r as (select topic_id, pred_id, row_number() over (partition by topic_id order by score desc, pred_id) i, count(*) over (partition by topic_id) n from i where score is not null), c as (select *, least(greatest(floor(n * 0.2), 2), n // 2) c from r) select topic_id, pred_id, case when i <= c then 'top' else 'bottom' end side from c where i <= c or i > n - c",
    "episode_splits": f"with {_S}, e as (select distinct topic_id, episode_id from s), r as (select *, row_number() over (order by topic_id nulls first, episode_id nulls first) i, count(*) over () n from e) select topic_id, episode_id, case when i <= floor(n * 0.7) then 'train' when i <= floor(n * 0.7) + floor(n * 0.15) then 'validation' else 'test' end split from r",
    "utility_ema": "with d as (select user_id, ts::date d, round(avg(value), 6) v from events group by all), l as (select user_id, list(v order by d) v from d group by 1) select user_id, len(v)::int n, round(list_reduce(list_prepend(0.0::double, v), lambda u, e: u + 0.3::double * (e - u)), 6) ema from l",
    "group_dup_penalty": f"""with {_I}, t as (select strategy_id, topic_id, cutoff_date, pred_id, list_distinct(list_filter(regexp_split_to_array(trim(lower(coalesce(rationale, ''))), '\\s+'), lambda x: length(x) > 3)) w from i where topic_id is not null and cutoff_date is not null),
      p as (select a.strategy_id, a.topic_id, a.cutoff_date, a.pred_id, count(*) filter (where a.pred_id <> b.pred_id and {jac('a.w', 'b.w')} >= 0.3) alike, count(*) - 1 others from t a join t b using (strategy_id, topic_id, cutoff_date) group by all)
      select strategy_id, topic_id, cutoff_date, pred_id, alike, round(case when others > 0 then alike / others else 0 end, 4) penalty from p""",
    "auc_quality": """with j as (select source, length(text) n, abusive a from doc_labels join documents using (doc_id) where text is not null and abusive is not null), c as (select source, count(*) filter (where a = 1) positives, count(*) filter (where a = 0) negatives from j group by 1),
      x as (select p.source, sum(case when p.n > q.n then 1 when p.n = q.n then 0.5 else 0 end) u from j p join j q on p.source is not distinct from q.source and p.a = 1 and q.a = 0 group by 1) select c.source, positives, negatives, round(case when positives > 0 and negatives > 0 then u / (positives * negatives) else 0.5 end, 6) auc from c left join x on x.source is not distinct from c.source""",
    "rank_corr": f"""with {_F}, r as (select topic_id, rank() over (partition by topic_id order by prior_score) + (count(*) over (partition by topic_id, prior_score) - 1) / 2 x, rank() over (partition by topic_id order by realization_score) + (count(*) over (partition by topic_id, realization_score) - 1) / 2 y from f where prior_score is not null and realization_score is not null) select topic_id, count(*) n, round(coalesce(corr(x, y), 0), 4) rho from r group by 1""",
    "mann_whitney_buckets": f"""with {_S}, {_SD}, x as (select topic_id, (pub - cut) d, coalesce(split = 'test', false) f from sd where pub - cut is not null), c as (select topic_id, count(*) filter (where f) m, count(*) filter (where not f) n from x group by 1),
      u as (select a.topic_id, sum(case when a.d > b.d then 1 when a.d = b.d then 0.5 else 0 end) u from x a join x b on a.topic_id is not distinct from b.topic_id and a.f and not b.f group by 1), t as (select topic_id, sum(k * k * k - k) ties from (select topic_id, d, count(*)::double k from x group by 1, 2) group by 1),
      v as (select c.topic_id, m, n, coalesce(u, 0) u, m * n / 12 * (m + n + 1 - ties / nullif((m + n) * (m + n - 1), 0)) v from c left join u on c.topic_id is not distinct from u.topic_id join t on t.topic_id is not distinct from c.topic_id),
      z as (select *, (u - m * n / 2 - 0.5) / sqrt(case when v > 0 then v end) z from v), y as (select *, 1 / (1 + 0.2316419::double * abs(z)) t from z), q as (select *, exp(-z * z / 2) / 2.5066282746310002::double * t * (0.319381530::double + t * (-0.356563782::double + t * (1.781477937::double + t * (-1.821255978::double + t * 1.330274429::double)))) w from y)
      select topic_id, m, n, round(u, 4)::double u, round(z, 6) z, round(1 - case when z >= 0 then 1 - w else w end, 6) p from q""",
    "lead_time_buckets": f"""with {_S}, {_SD}, x as (select split, case when cut is not null and pub is not null then coalesce(least(greatest((pub - cut) / (last_day((cut + interval 3 month)::date) - cut)::double, 0), 1), 0) end f from sd)
      select case when f < 1/3 then 'early' when f < 2/3 then 'mid' when f is not null then 'late' end bucket, count(*) n, round(avg((split = 'test')::int), 6) test_share from x group by 1""",
    "validation_report": """with j as (select doc_kind, length(text) n, abusive a from doc_labels join documents using (doc_id) where text is not null and abusive is not null), m as (select doc_kind, count(*) filter (where a = 1) positives, count(*) filter (where a = 0) negatives, median(n) filter (where a = 1) positive_median, median(n) filter (where a = 0) negative_median, max(n) filter (where a = 0) negative_max from j group by 1),
      x as (select p.doc_kind, sum(case when p.n > q.n then 1 when p.n = q.n then 0.5 else 0 end) u from j p join j q on p.doc_kind = q.doc_kind and p.a = 1 and q.a = 0 group by 1), l as (select doc_kind, count(*) filter (where a = 0 and n >= positive_median) leaks from j join m using (doc_kind) group by 1)
      select m.*, round(case when positives > 0 and negatives > 0 then u / (positives * negatives) else 0.5 end, 6) auc, leaks, round(case when positives > 0 and negatives > 0 then u / (positives * negatives) else 0.5 end, 6) >= 0.75 and leaks = 0 passed from m left join x using (doc_kind) join l using (doc_kind)""",
    "group_advantage": f"with {_I}, x as (select pred_id, topic_id, cutoff_date, {_CO} s from i where score is not null), g as (select *, avg(s) over (partition by topic_id, cutoff_date) m, stddev_pop(s) over (partition by topic_id, cutoff_date) d from x) select pred_id, round((s - m) / case when d > 1e-12 then d else 1 end, 6) advantage from g",
    "mmd_rbf": """with v as (select vec_id k, label % 2 as label, embedding::double[64] e from embeddings), p as (select a.k ka, b.k kb, a.label la, b.label lb, array_distance(a.e, b.e) * array_distance(a.e, b.e) d from v a, v b), h as (select quantile_cont(d, 0.5) / 2 h from p), k as (select *, exp(-d / h / 2) g from p, h)
      select round(avg(g) filter (where la = 0 and lb = 0 and ka <> kb) + avg(g) filter (where la = 1 and lb = 1 and ka <> kb) - 2 * avg(g) filter (where la <> lb), 6) mmd, round(max(h), 6) bandwidth from k""",
    "wasserstein_1d": f"with {_F}, c as (select prior_score v, count(*) filter (where strategy_id not like 'strat-shared%') a, count(*) filter (where strategy_id like 'strat-shared%') b from f where prior_score is not null group by 1), w as (select sum(a) over o / sum(a) over () fa, sum(b) over o / sum(b) over () fb, lead(v) over o - v width from c window o as (order by v)) select round(sum(abs(fa - fb) * width), 6) distance from w",
    "cosine_topr": f"with {_V}, p as (select a.vec_id a, b.vec_id b, round(greatest(array_cosine_similarity(a.e, b.e), 0), 5) cos from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 50 = 0) select * from (select *, row_number() over (partition by a order by cos desc, b)::int place from p) where place <= 5",
    "vector_novelty": f"with {_V} select a.vec_id a, round(1 - greatest(max(array_cosine_similarity(a.e, b.e)), 0), 5) novelty from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by 1",
    "cluster_gated_coverage": f"with {_V}, m as (select a.vec_id a, b.label, max(greatest(array_cosine_similarity(a.e, b.e), 0)) best from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by 1, 2) select a, count(*) clusters, round(avg(case when best >= 0.3 then best else 0 end), 5) coverage from m group by 1",
}
QUERIES = {
    f.__name__: f
    for f in (
        topic_phrase_join, overlap_retrieval_topk, priority_join, episode_fan_out, paper_topic_first, citation_pairs, citation_hits, known_papers, topic_seed, top_terms, term_cooccurrence, keyword_components, keyword_momentum, memory_build, memory_topn,
        bucket_memory, operator_distribution, popularity_minmax, impact_buckets, strategy_leaderboard, strategy_rollup, coverage_audit, status_rollup, rank_disorder, midpoint_sample, reward_quantiles, episode_splits, greedy_dedupe, mmr_select,
        utility_ema, search_states, balanced_split, group_dup_penalty, auc_quality, rank_corr, mann_whitney_buckets, lead_time_buckets, validation_report, group_advantage, mmd_rbf, wasserstein_1d, cosine_topr, vector_novelty, cluster_gated_coverage,
    )
}
