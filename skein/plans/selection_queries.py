"""Queries over selections, contexts, priors, audits and run tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import aggregates as A
from skein.operators import selection as S
from skein.operators.lexical import lexical_similarity, nearest
from skein.plans.scalar_queries import PAPERS, TOK, papers
from skein.plans.spread import spread
from skein.sources.tables import table


def _ideas(spark, d):
    return table(spark, d, "idea_predictions").dropDuplicates(["pred_id"])


def _samples(spark, d):
    return table(spark, d, "hindsight_samples").dropDuplicates(["sample_id"])


def _rows(spark, d):
    return table(spark, d, "dz_rows").dropDuplicates(["dz_id"])


def _forecasts(spark, d):
    return table(spark, d, "scored_forecasts").select("forecast_id", "strategy_id", "topic_id", "cutoff_t", "rank", "prior_score", "realization_score", "joint_score", "evidence_paper_ids", "proposal_text").dropDuplicates(["forecast_id"])


def base_scores(spark, d):
    """Coverage of the topic's signal terms (the 20 most frequent tokens of its papers' summaries and keywords) and specificity of each idea."""
    p = papers(spark, d).filter("topic_id is not null")
    terms = p.select("topic_id", F.explode(T.tokens(F.concat_ws(" ", "summary", F.array_join("keywords", " ")))).alias("t")).filter((F.length("t") > 3) & ~F.col("t").isin(*T.TERM_STOP_WORDS)).groupBy("topic_id", "t").agg(F.count("*").alias("n"))
    top = terms.withColumn("r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("n"), "t"))).filter("r <= 20").groupBy("topic_id").agg(F.collect_set("t").alias("signals"))
    i = _ideas(spark, d).join(top, "topic_id")
    return i.select("pred_id", S.base_score(T.token_set(T.prediction_text(F.col("title"), F.col("rationale"), F.col("approach"))), F.col("signals")).alias("base"))


def latest_generation(spark, d):
    """The ideas of each strategy and topic at its latest cutoff."""
    i = _ideas(spark, d).withColumn("cut", D.cutoff_date(F.col("cutoff_date"))).filter("cut is not null and topic_id is not null")
    return S.latest(i, ["strategy_id", "topic_id"], "cut").select("pred_id", "cut")


def recent_and_long_term(spark, d):
    """Papers of each topic within six months of a cutoff, and before; the last ten stand in where none is recent."""
    p = papers(spark, d).filter("topic_id is not null and published <= date '2024-06-30'")
    return S.recent_rows(p, ["topic_id"], "published", "paper_id", F.lit("2024-06-30").cast("date"), 6, 10).groupBy("topic_id", "part").agg(F.count("*").alias("n"))


def materialized_context(spark, d):
    """Titles of a row's context papers in their order; papers that are missing are left out."""
    z = _rows(spark, d).filter("context_paper_ids is not null")
    out = S.materialized(z, "dz_id", "context_paper_ids", papers(spark, d).select("paper_id", "title"), "paper_id", "title")
    return out.select("dz_id", F.size("found").alias("n"), T.short_hash(F.array_join("found", "|", "-")).alias("h"))


def soft_rewards(spark, d):
    """The greatest soft score over the first ten forecasts of each window that match by three grades."""
    f = _forecasts(spark, d).filter("topic_id is not null")
    g = [F.pmod(F.floor(F.col(c) * 1000), F.lit(4)) for c in ("prior_score", "realization_score")]
    soft = V.soft_score(g[0], g[1], F.lit(2))
    r = f.withColumn("place", F.row_number().over(Window.partitionBy("strategy_id", "topic_id", "cutoff_t").orderBy(F.desc("prior_score"), "forecast_id"))).filter("place <= 10")
    return r.groupBy("strategy_id", "topic_id", "cutoff_t").agg(F.round(F.coalesce(F.max(F.when(V.judged_match(g[0], g[1], F.lit(2)), soft)), F.lit(0.0)), 6).alias("reward"))


def manifest_summary(spark, d):
    s = _samples(spark, d)
    return s.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("topic_id").alias("topics"), F.count_distinct("topic_id", "episode_id").alias("episodes"), F.count_if(F.col("innovation").isNotNull() & F.col("innovation.gap").isNotNull()).alias("with_gap"))


def evidence_quality(spark, d):
    """Mean over a forecast's evidence papers of the greater of token overlap and lexical similarity between the proposal and the paper's whole text."""
    f = _forecasts(spark, d).filter("proposal_text is not null").select("forecast_id", "proposal_text", F.explode("evidence_paper_ids").alias("paper_id"))
    p = papers(spark, d).select("paper_id", T.paper_text(F.col("title"), F.col("keywords"), F.col("summary")).alias("text"))
    j = spread(f, "paper_id").join(p, "paper_id")
    overlap = T.overlap(T.token_set(F.col("proposal_text")), T.token_set(F.col("text")))
    return j.groupBy("forecast_id").agg(F.count("*").alias("n"), F.round(F.avg(F.greatest(overlap, lexical_similarity(F.col("proposal_text"), F.col("text")))), 4).alias("quality"))


def heuristic_prior(spark, d):
    """Log prior of each sample's gap under the topic's memory: the greatest of similarity times strength, at least 1e-6."""
    s = _samples(spark, d).filter("topic_id is not null and innovation.gap is not null").select("sample_id", "topic_id", F.col("innovation.gap").alias("gap"))
    m = _rows(spark, d).filter("topic_id is not null and target_z.gap is not null").select("topic_id", F.col("dz_id").alias("entry"), F.col("target_z.gap").alias("known"))
    return S.prior(s, "sample_id", "gap", m, "entry", "known", ["topic_id"])


def trajectory_audit(spark, d):
    """Evidence that is no known paper, by forecast: the first fault found, if any."""
    f = _forecasts(spark, d).select("forecast_id", "cutoff_t", F.coalesce("evidence_paper_ids", F.array().cast("array<string>")).alias("e"))
    p = papers(spark, d).select("paper_id", "published")
    return S.audited(f, "forecast_id", "e", D.cutoff_date(F.col("cutoff_t")), p).groupBy("fault").agg(F.count("*").alias("n"))


def run_table(spark, d):
    """Strategies' families side by side in a fixed order: windows, hits at two thresholds, short windows, and families not scored."""
    f = _forecasts(spark, d).withColumn("family", F.when(F.col("strategy_id").contains("shared"), F.col("strategy_id")).otherwise("single"))
    w = f.groupBy("family", "strategy_id", "topic_id", "cutoff_t").agg(F.bool_or(F.col("realization_score") >= 0.7).alias("hit"), F.bool_or(F.col("realization_score") >= 0.9).alias("strict"), F.count("*").alias("k"))
    return S.run_table(w, "family", ["strat-shared-01", "strat-shared-02", "missing-run", "single"])


def popularity_enrichment(spark, d):
    """Cited ids known to the corpus with their scores, unknown ones with 0, and how many are unknown."""
    named = _samples(spark, d).select(F.col("future_paper_id").alias("paper_id")).unionByName(_rows(spark, d).select(F.col("source_future_id").alias("paper_id"))).filter("paper_id is not null").distinct()
    j = named.join(papers(spark, d).select("paper_id", "popularity_score", F.lit(True).alias("known")), "paper_id", "left")
    return j.select("paper_id", F.coalesce("popularity_score", F.lit(0.0)).alias("score"), F.coalesce("known", F.lit(False)).alias("known"))


def sft_rows(spark, d):
    """Per sample the three operators its topic had used most before its cutoff, without those of its own paper."""
    s = _samples(spark, d).withColumn("m", D.month_index(D.cutoff_date(F.col("cutoff_date")))).filter("m is not null and topic_id is not null")
    entries = s.select("topic_id", "m", F.col("future_paper_id").alias("source"), F.lower(F.trim("innovation.operator")).alias("op")).filter("op is not null and op <> ''")
    return S.memory_before(s.select("sample_id", "topic_id", "m", F.col("future_paper_id").alias("own")), entries, 3)


def utility_update(spark, d):
    """Mean score of the forecasts made from each training row's topic and operator."""
    f = table(spark, d, "scored_forecasts").select("forecast_id", "topic_id", F.lower(F.trim("innovation.operator")).alias("op"), "joint_score").dropDuplicates(["forecast_id"]).filter("joint_score is not null and not isnan(joint_score)")
    # sums of millionths: no order of summation shows in the result
    u = f.groupBy("topic_id", "op").agg(F.sum(F.round(F.col("joint_score") * 1_000_000).cast("bigint")).alias("u"), F.count("*").alias("n"))
    z = _rows(spark, d).select("dz_id", "topic_id", F.lower(F.trim("operator_closed")).alias("op"))
    return z.join(u, ["topic_id", "op"], "left").select("dz_id", F.coalesce("n", F.lit(0)).alias("events"), (F.floor((6 * F.coalesce("u", F.lit(0)) + 1000 * F.coalesce("n", F.lit(1))) / (2000 * F.coalesce("n", F.lit(1)))) / 10_000).alias("utility"))


def unmatched_future(spark, d):
    """Papers of each topic and month that no sample names."""
    p = papers(spark, d)
    left = p.join(_samples(spark, d).select(F.col("future_paper_id").alias("paper_id")), "paper_id", "left_anti")
    return left.groupBy("topic_id", F.date_format("published", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def paper_memory(spark, d):
    """Triples from papers alone: the first three keywords or five title words, and the summary's first hundred characters."""
    p = papers(spark, d)
    words = T.token_set(F.coalesce("title", F.lit("")))
    base = F.when(F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0, F.array_join(F.slice("keywords", 1, 3), ", ")).otherwise(F.array_join(F.slice(words, 1, 5), " "))
    return p.select("paper_id", base.alias("base_direction"), F.length(F.substring("summary", 1, 100)).alias("gap_n"))


def novelty_of_ideas(spark, d):
    """One less the greatest lexical similarity of the idea's whole text with a paper of the topic published by the idea's cutoff."""
    i = _ideas(spark, d).select("topic_id", F.col("pred_id").alias("q"), T.idea_text(F.col("title"), F.col("rationale"), F.col("approach"), F.col("key_terms")).alias("text"), D.cutoff_date(F.col("cutoff_date")).alias("day")).filter("topic_id is not null and day is not null")
    p = papers(spark, d).select("topic_id", T.paper_text(F.col("title"), F.col("keywords"), F.col("summary")).alias("text"), F.col("published").alias("day")).filter("topic_id is not null and day is not null")
    return A.novelty(i.withColumnRenamed("q", "pred_id"), "pred_id", nearest(i, p, ["topic_id"]).withColumnRenamed("q", "pred_id"), "s")


_I = "i as (select distinct on (pred_id) * from idea_predictions)"
_S = "s as (select distinct on (sample_id) * from hindsight_samples)"
_Z = "z as (select distinct on (dz_id) * from dz_rows)"
_F = "f as (select distinct on (forecast_id) * from scored_forecasts)"
_CUT = "try_cast(case when length(trim({0})) = 7 then trim({0}) || '-01' else trim({0}) end as date)"
SQL = {
    "base_scores": f"""with {PAPERS}, {_I}, t as (select topic_id, t, count(*) n from (select topic_id, unnest(regexp_extract_all(lower(concat_ws(' ', summary, array_to_string(keywords, ' '))), '[a-z0-9]+')) t from p where topic_id is not null) where length(t) > 3 and t not in {T.TERM_STOP_WORDS} group by all),
      k as (select topic_id, list(t) g from (select *, row_number() over (partition by topic_id order by n desc, t) r from t) where r <= 20 group by 1), w as (select pred_id, g, {TOK.format("concat_ws(' ', title, rationale, approach)")} w from i join k using (topic_id))
      select pred_id, round(0.75::double * len(list_intersect(g, w)) / len(g) + 0.25::double * least(len(w) / 30, 1), 4) base from w""",
    "latest_generation": f"with {_I}, c as (select *, {_CUT.format('cutoff_date')} cut from i), m as (select *, max(cut) over (partition by strategy_id, topic_id) l from c where cut is not null and topic_id is not null) select pred_id, cut from m where cut = l",
    "recent_and_long_term": f"""with {PAPERS}, k as (select topic_id, published >= date '2024-06-30' - interval 6 month recent, row_number() over (partition by topic_id order by published desc, paper_id desc) r from p where topic_id is not null and published <= date '2024-06-30'), a as (select *, bool_or(recent) over (partition by topic_id) has from k)
      select topic_id, case when case when has then recent else r <= 10 end then 'recent' else 'long_term' end part, count(*) n from a group by all""",
    "materialized_context": f"""with {PAPERS}, {_Z}, e as (select dz_id, unnest(context_paper_ids) c, generate_subscripts(context_paper_ids, 1) o from z where context_paper_ids is not null), j as (select dz_id, list(coalesce(title, '-') order by o) t from e join p on paper_id = c group by 1)
      select z.dz_id, coalesce(len(t), 0)::int n, substr(sha256(coalesce(array_to_string(t, '|'), '')), 1, 16) h from z left join j using (dz_id) where context_paper_ids is not null""",
    "soft_rewards": f"""with {_F}, r as (select *, row_number() over (partition by strategy_id, topic_id, cutoff_t order by prior_score desc nulls last, forecast_id) place, floor(prior_score * 1000)::bigint % 4 a, floor(realization_score * 1000)::bigint % 4 b from f where topic_id is not null)
      select strategy_id, topic_id, cutoff_t, round(coalesce(max((a + b + 2) / 9) filter (where a + b >= 5), 0), 6) reward from r where place <= 10 group by 1, 2, 3""",
    "manifest_summary": f"with {_S} select split, count(*) as rows, count(distinct topic_id) topics, count(distinct case when topic_id is not null and episode_id is not null then topic_id || '|' || episode_id end) episodes, count(innovation.gap) with_gap from s group by 1",
    "heuristic_prior": f"""with {_S}, {_Z}, a as (select sample_id, topic_id, {TOK.format('innovation.gap')} a from s where topic_id is not null and innovation.gap is not null), b as (select topic_id, {TOK.format('target_z.gap')} b, row_number() over (partition by topic_id order by dz_id) / count(*) over (partition by topic_id) st from z where topic_id is not null and target_z.gap is not null),
      x as (select sample_id, max(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double * st) v from a join b using (topic_id) where len(list_intersect(a, b)) > 0 group by 1) select sample_id, round(ln(greatest(coalesce(v, 0), 1e-6)), 6) log_prior from a left join x using (sample_id)""",
    "trajectory_audit": f"""with {PAPERS}, {_F}, e as (select forecast_id, {_CUT.format('cutoff_t')} cut, unnest(evidence_paper_ids) c from f), j as (select forecast_id, bool_or(paper_id is null) unknown, bool_or(published > cut) late from e left join p on paper_id = c group by 1),
      k as (select case when coalesce(len(evidence_paper_ids), 0) = 0 then 'none' when unknown then 'unknown' when late then 'late' else 'ok' end fault from f left join j using (forecast_id)) select fault, count(*) n from k group by 1""",
    "run_table": f"""with {_F}, w as (select case when contains(strategy_id, 'shared') then strategy_id else 'single' end family, strategy_id, topic_id, cutoff_t, bool_or(realization_score >= 0.7) hit, bool_or(realization_score >= 0.9) strict, count(*) k from f group by all),
      a as (select family, count(*) windows, count(*) filter (where hit) hits, count(*) filter (where strict) strict_hits, count(*) filter (where k < 5) short from w group by 1), o as (select * from (values (0, 'strat-shared-01'), (1, 'strat-shared-02'), (2, 'missing-run'), (3, 'single')) t(pos, family))
      select coalesce(pos, 4)::int pos, coalesce(a.family, o.family) family, coalesce(windows, 0) windows, coalesce(hits, 0) hits, coalesce(strict_hits, 0) strict_hits, coalesce(short, 0) short, case when windows is null then 'not scored' else 'scored' end status from a full join o using (family)""",
    "popularity_enrichment": f"with {PAPERS}, {_S}, {_Z}, n as (select future_paper_id paper_id from s union select source_future_id from z) select n.paper_id, coalesce(popularity_score, 0) score, p.paper_id is not null known from n left join p using (paper_id) where n.paper_id is not null",
    "sft_rows": f"""with {_S}, k as (select sample_id, topic_id, year({_CUT.format('cutoff_date')})*12 + month({_CUT.format('cutoff_date')}) - 1 m, future_paper_id own, lower(trim(innovation.operator, ' ')) op from s), e as (select * from k where m is not null and topic_id is not null),
      c as (select a.sample_id, b.op, count(*) n from e a join e b on a.topic_id = b.topic_id and b.m < a.m and b.own is distinct from a.own and b.op <> '' group by all), r as (select *, row_number() over (partition by sample_id order by n desc, op) r from c)
      select e.sample_id, coalesce(string_agg(r.op || ':' || n, '|' order by r) filter (where r <= 3), '') memory from e left join r using (sample_id) group by 1""",
    "utility_update": f"""with {_F}, {_Z}, u as (select topic_id, lower(trim(innovation.operator, ' ')) op, sum(round(joint_score * 1000000)::bigint) u, count(*) n from f where joint_score is not null and not isnan(joint_score) group by 1, 2)
      select dz_id, coalesce(n, 0) events, floor((6 * coalesce(u, 0) + 1000 * coalesce(n, 1)) / (2000 * coalesce(n, 1))) / 10000 utility from z left join u on u.topic_id = z.topic_id and u.op = lower(trim(operator_closed, ' '))""",
    "unmatched_future": f"with {PAPERS} select topic_id, strftime(published, '%Y-%m') as month, count(*) n from p where paper_id not in (select future_paper_id from hindsight_samples where future_paper_id is not null) group by 1, 2",
    "paper_memory": f"""with {PAPERS}, t as (select paper_id, keywords, summary, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+') w from p), u as (select *, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda y: list_position(w, y[1]) = y[2]), lambda y: y[1]) d from t)
      select paper_id, case when len(keywords) > 0 then array_to_string(keywords[1:3], ', ') else coalesce(array_to_string(d[1:5], ' '), '') end base_direction, length(substr(summary, 1, 100))::int gap_n from u""",
}
QUERIES = {
    f.__name__: f
    for f in (
        base_scores, latest_generation, recent_and_long_term, materialized_context, soft_rewards, manifest_summary, evidence_quality, heuristic_prior, trajectory_audit, run_table, popularity_enrichment, sft_rows, utility_update, unmatched_future, paper_memory, novelty_of_ideas,
    )
}
