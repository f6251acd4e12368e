"""Queries over lexical similarity, clusters and rewards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import folds, lexical
from skein.operators import rewards as R
from skein.operators.mapping import small
from skein.plans.scalar_queries import PAPERS, TOK, cited, papers
from skein.sources.tables import table

TECHNICAL = ["benchmark", "dataset", "encoder", "graph", "model", "prompt", "reward", "token"]


def _ideas(spark, d):
    return table(spark, d, "idea_predictions").dropDuplicates(["pred_id"])


def _forecasts(spark, d):
    return table(spark, d, "scored_forecasts").select("forecast_id", "strategy_id", "topic_id", "cutoff_t", "innovation", "proposal_text", "joint_score", "prior_score", "evidence_paper_ids").dropDuplicates(["forecast_id"])


def lexical_scores(spark, d):
    i = _ideas(spark, d)
    return i.select("pred_id", F.round(lexical.lexical_similarity(F.coalesce("title", F.lit("")), F.coalesce("approach", F.lit(""))), 6).alias("similarity"))


def two_stage_retrieval(spark, d):
    """The three papers most like each idea among those of its topic published by its cutoff, whole texts on both sides."""
    i = _ideas(spark, d).select("topic_id", F.col("pred_id").alias("q"), T.idea_text(F.col("title"), F.col("rationale"), F.col("approach"), F.col("key_terms")).alias("text"), D.cutoff_date(F.col("cutoff_date")).alias("day"))
    p = papers(spark, d).select("topic_id", F.col("paper_id").alias("p"), T.paper_text(F.col("title"), F.col("keywords"), F.col("summary")).alias("text"), F.col("published").alias("day"))
    return lexical.two_stage_retrieval(i.filter("topic_id is not null and day is not null"), p.filter("topic_id is not null and day is not null"), ["topic_id"], 3, 0.1)


def lexical_diversity(spark, d):
    i = _ideas(spark, d).filter("topic_id is not null").withColumn("text", T.idea_text(F.col("title"), F.col("rationale"), F.col("approach"), F.col("key_terms")))
    return lexical.diversity(i, ["strategy_id", "topic_id", "cutoff_date"], [F.col("rank").asc_nulls_last(), F.col("pred_id")], "text")


def close_keywords(spark, d):
    kw = papers(spark, d).select(F.explode("keywords").alias("kw"))
    return lexical.close_category(kw, "kw", ["benchmark", "calibration", "gradient", "landscape", "prototype", "taxonomy"]).filter("category is not null")


def hashed_embeddings(spark, d):
    p = papers(spark, d).select("paper_id", lexical.hashed_embedding(F.col("title")).alias("v"))
    return p.select("paper_id", F.round(V.dot(F.col("v"), F.col("v")), 4).alias("norm"), F.size(F.filter("v", lambda x: x != 0)).alias("places"))


def cluster_coverage(spark, d):
    e = table(spark, d, "embeddings").withColumn("matched", F.col("vec_id") % 7 == 0)
    return lexical.cluster_coverage(e, ["label"], "vec_id", "embedding", "matched", 8)


def judged_match(spark, d):
    """The first five ideas of each window (strategy, topic, cutoff) by reported rank, with the topic's papers of the three months after the cutoff
    judged by three grades, in order of retrieval; each prediction takes its first match that is still free."""
    window = ["strategy_id", "topic_id", "cut"]
    i = _ideas(spark, d).withColumn("cut", D.cutoff_date(F.col("cutoff_date"))).filter("topic_id is not null and cut is not null")
    place = Window.partitionBy(*window).orderBy(F.col("rank").asc_nulls_last(), "pred_id")
    i = i.select(*window, "pred_id", F.row_number().over(place).alias("rank")).filter("rank <= 5").withColumn("m", F.explode(F.sequence(D.month_index(F.col("cut")), D.month_index(F.col("cut")) + 3)))
    p = papers(spark, d).filter("topic_id is not null").select("topic_id", D.month_index(F.col("published")).alias("m"), "published", F.col("paper_id").alias("paper"))
    g = [F.conv(F.substring(F.md5(F.concat_ws("|", "paper", F.col("pred_id").cast("string"), F.lit(x))), 1, 6), 16, 10).cast("bigint") % 4 for x in "pms"]
    c = i.join(p, ["topic_id", "m"]).filter("published > cut").filter(V.judged_match(*g)).withColumn("score", -F.conv(F.substring(F.md5("paper"), 1, 8), 16, 10).cast("double"))
    return folds.greedy_match(c.select(*window, "rank", "paper", "score"), window, 5).select(*window, "rank", "paper")


def proposal_gates(spark, d):
    """Gates over the operators of the inventory; the papers' numbers have eight digits here."""
    inventory = table(spark, d, "operator_inventory").agg(F.collect_set("op_id").alias("closed"))  # one row, a dimension's ids
    f = _forecasts(spark, d).join(F.broadcast(inventory))
    gate = R.gates(F.col("proposal_text"), F.col("evidence_paper_ids"), F.lower(F.trim("innovation.operator")), F.col("closed"), digits=8)
    return f.groupBy(F.coalesce(gate, F.lit("passed")).alias("gate")).agg(F.count("*").alias("n"))


def proposal_rewards(spark, d):
    f = _forecasts(spark, d).filter("topic_id is not null")
    inventory = table(spark, d, "operator_inventory").select("op_id", F.split("op_id", "_").alias("keywords"))
    j = f.withColumn("op", F.lower(F.trim("innovation.operator"))).join(small(inventory), F.col("op") == F.col("op_id"), "left")
    a = R.adherence(F.col("proposal_text"), F.col("keywords"), F.coalesce("op", F.lit("?")))
    c = R.coherence(F.col("proposal_text"), F.concat_ws(" ", "innovation.base_direction", "innovation.gap"), TECHNICAL)
    return j.select("forecast_id", a.alias("adherence"), c.alias("coherence"), R.combined(F.when(~F.isnan("prior_score"), F.col("prior_score")), a, c, digits=6).alias("reward"))


def proposal_predictions(spark, d):
    f = _forecasts(spark, d).filter("proposal_text is not null")
    p = R.proposal_as_prediction(F.col("proposal_text"), F.col("innovation.gap"))
    return f.select("forecast_id", p.alias("p")).select("forecast_id", T.short_hash(F.col("p.title")).alias("title"), F.length("p.approach").alias("n"))


def alignment_gate(spark, d):
    f = _forecasts(spark, d).filter("topic_id is not null").withColumn("reward", F.when(~F.isnan("joint_score"), F.col("joint_score"))).select("topic_id", "reward", F.col("prior_score").alias("prior"))
    return R.alignment(f, "topic_id", "reward", ["prior"])


def reference_lists(spark, d):
    return papers(spark, d).filter("size(refs) > 0").select("paper_id", T.short_hash(R.rendered_references(F.col("refs"), 3)).alias("h"))


_F = "f as (select distinct on (forecast_id) * from scored_forecasts)"
_TECH = "[" + ", ".join(f"'{w}'" for w in TECHNICAL) + "]"
_CUT = "try_cast(case when length(trim(cutoff_date)) = 7 then trim(cutoff_date) || '-01' else trim(cutoff_date) end as date)"
_G = "(('0x' || substr(md5(concat_ws('|', paper, pred_id, '{0}')), 1, 6))::bigint % 4)"
SQL = {
    "judged_match": f"""with {PAPERS}, i as (select distinct on (pred_id) * from idea_predictions), c as (select *, {_CUT} cut from i), o as (select strategy_id, topic_id, cut, pred_id, row_number() over (partition by strategy_id, topic_id, cut order by rank nulls last, pred_id)::int rank from c where topic_id is not null and cut is not null qualify row_number() over (partition by strategy_id, topic_id, cut order by rank nulls last, pred_id) <= 5),
      r as (select topic_id, paper_id paper, published from p where topic_id is not null), j as (select strategy_id, topic_id, cut, rank, paper, ('0x' || substr(md5(paper), 1, 8))::bigint h, {_G.format('p')} p, {_G.format('m')} m, {_G.format('s')} s from o join r using (topic_id) where published > cut and year(published) * 12 + month(published) <= year(cut) * 12 + month(cut) + 3),
      l as (select strategy_id, topic_id, cut, list([{{'rank': rank, 'paper': paper}}] order by rank, h, paper desc) c from j where p + m >= 5 and s >= 2 group by all),
      u as (select strategy_id, topic_id, cut, unnest(list_reduce(c, lambda acc, x: case when len(list_filter(acc, lambda y: y.rank = x[1].rank or y.paper = x[1].paper)) > 0 then acc else list_concat(acc, x) end)) t from l) select strategy_id, topic_id, cut, t.rank, t.paper from u""",
    "proposal_gates": f"""with {_F}, g as (select case when length(trim(coalesce(proposal_text, ''), ' ')) < 40 then 'format' when len(list_filter({cited('proposal_text')}, lambda x: not list_contains(coalesce(evidence_paper_ids, []), x))) > 0 then 'grounding'
      when coalesce(lower(trim(innovation.operator, ' ')) not in (select op_id from operator_inventory), true) then 'operator' else 'passed' end gate from f) select gate, count(*) n from g group by 1""",
    "proposal_rewards": f"""with {_F}, j as (select forecast_id, prior_score, coalesce(proposal_text, '') t, lower(trim(innovation.operator, ' ')) op, op_id, string_split(op_id, '_') k, concat_ws(' ', innovation.base_direction, innovation.gap) z from f left join operator_inventory on op_id = lower(trim(innovation.operator, ' ')) where topic_id is not null),
      w as (select *, {TOK.format('t')} wt, {TOK.format('z')} wz, lower(t) lt from j),
      s as (select forecast_id, prior_score, round(case when k is not null then len(list_filter(k, lambda x: contains(lt, x))) / len(k)::double else case when contains(lt, coalesce(op, '?')) then 1.0 else 0.0 end end, 4)::double adherence,
       case when len(wt) = 0 then 0 else round(least(greatest(0.4::double * least(1, length(trim(t)) / 200) + 0.3::double * least(1, len(list_intersect(wt, {_TECH})) / 5) + 0.3::double * case when least(len(wt), len(wz)) = 0 then 0 else len(list_intersect(wt, wz)) / least(len(wt), len(wz)) end, 0), 1), 4) end coherence from w)
      select forecast_id, adherence, coherence, round(least(greatest(coalesce(prior_score, 0) * 0.4::double + adherence * 0.3::double + coherence * 0.3::double, 0), 1), 6) reward from s""",
    "proposal_predictions": f"""with {_F} select forecast_id, substr(sha256(trim(regexp_replace(split_part(trim(proposal_text, ' '), chr(10), 1), '^#+\\s*', ''))), 1, 16) title,
      length(substr(concat_ws(' ', innovation.gap, nullif(trim(regexp_replace(proposal_text, '^[^\\n]*\\n?', '')), '')), 1, 500))::int n from f where proposal_text is not null""",
    "alignment_gate": f"""with {_F}, k as (select topic_id, case when not isnan(joint_score) then joint_score end r, prior_score p from f where topic_id is not null), b as (select topic_id, (list({{'r': r, 'p': p}} order by coalesce(r, '-infinity'::double) desc, p desc nulls last))[1] x, count(*) filter (where r is null) bad, count(*) filter (where r = 0) z, count(*) n from k group by 1)
      select count(*) prompts, round(avg(x.r), 4) reward, round(avg(x.p), 4) prior, round(sum(bad) / sum(n), 4) invalid, round(sum(z) / sum(n), 4) as zero from b""",
    "reference_lists": f"with {PAPERS} select paper_id, substr(sha256(array_to_string(list_transform(refs[1:3], lambda r, i: '[' || i || '] ' || r), chr(10))), 1, 16) h from p where len(refs) > 0",
}
QUERIES = {
    f.__name__: f
    for f in (lexical_scores, two_stage_retrieval, lexical_diversity, close_keywords, hashed_embeddings, cluster_coverage, judged_match, proposal_gates, proposal_rewards, proposal_predictions, alignment_gate, reference_lists)
}
