"""Queries over rolling windows: splits, and backtests of the predictions against the papers that came after."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as T
from skein.operators import backtest as B
from skein.operators import folds
from skein.operators import windows as W
from skein.plans.cut import cut
from skein.plans.scalar_queries import PAPERS, TOK, jac, papers
from skein.plans.spread import spread
from skein.sources.tables import table

TOP_K, HORIZON, MIN_TRAIN, LEAST = 5, 3, 6, 0.1
WINDOW = ["strategy_id", "topic_id", "cut"]


def _papers(spark, d):
    return papers(spark, d).filter("topic_id is not null and published is not null")


def window_split_counts(spark, d):
    p = _papers(spark, d).select(F.col("topic_id").alias("topic"), "paper_id", "published", F.col("popularity_score").alias("score"))
    return W.split_counts(p, HORIZON, MIN_TRAIN)


def predictions(spark, d):
    """The first five ideas of each window (strategy, topic, cutoff) by score, ranked anew, with their words."""
    i = table(spark, d, "idea_predictions").dropDuplicates(["pred_id"]).withColumn("cut", D.cutoff_date(F.col("cutoff_date"))).filter("topic_id is not null and cut is not null")
    first = B.reranked(i, WINDOW, [F.desc("score"), F.col("pred_id")], TOP_K)
    return first.select(*WINDOW, "rank", "pred_id", T.hashed_set(T.token_set(T.idea_text(F.col("title"), F.col("rationale"), F.col("approach"), F.col("key_terms")))).alias("words"))


def _future(spark, d, predicted):
    """Predictions with the future papers of their window: they meet by topic and month."""
    p = _papers(spark, d).select("topic_id", D.month_index(F.col("published")).alias("m"), "published", F.col("paper_id").alias("paper"), T.hashed_set(T.token_set(T.paper_text(F.col("title"), F.col("keywords"), F.col("summary")))).alias("paper_words"))
    at = D.month_index(F.col("cut"))
    asked = predicted.withColumn("m", F.explode(F.sequence(at, at + HORIZON)))
    return spread(asked, "topic_id", "m").join(p, ["topic_id", "m"]).filter("published > cut")


def candidates(spark, d, predicted):
    """Future papers of the predictions' windows that are like them, by the Jaccard similarity of their whole texts."""
    near = _future(spark, d, predicted).filter(T.may_exceed(F.col("words"), F.col("paper_words"), LEAST))
    scored = near.withColumn("score", F.round(T.jaccard(F.col("words"), F.col("paper_words")), 6))
    return scored.filter(F.col("score") > LEAST).select(*WINDOW, "rank", "paper", "score", "published")


def greedy_match(spark, d):
    return folds.greedy_match(candidates(spark, d, predictions(spark, d)), WINDOW, TOP_K)


def window_eval(spark, d):
    """The backtest of every window: its predictions against its future papers."""
    predicted = cut(predictions(spark, d))
    sides = B.side_counts(_papers(spark, d), predicted, HORIZON)
    return B.evaluate(predicted, cut(candidates(spark, d, predicted)), sides, TOP_K, HORIZON, MIN_TRAIN)


def topic_weighted_rollup(spark, d):
    return B.per_topic(cut(window_eval(spark, d)))


def record_backtest(spark, d):
    """Per strategy and topic the windows, rates and score of its predictions, or why there are none."""
    return B.by_record(window_eval(spark, d), predictions(spark, d))


def _grade(*parts):
    """0 to 3 out of a hash that any engine has, in place of a judge."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 6), 16, 10).cast("bigint") % 4


def _judged(spark, d):
    met = _future(spark, d, predictions(spark, d))
    number = F.col("pred_id").cast("string")
    problem, method, specificity = (_grade("paper", number, F.lit(x)) for x in "pms")
    unread = F.conv(F.substring(F.md5(F.concat_ws("|", number, "paper")), 1, 6), 16, 10).cast("bigint") % 16 == 0
    order = -F.conv(F.substring(F.md5("paper"), 1, 8), 16, 10).cast("double")
    return met.select(*WINDOW, "rank", "paper", order.alias("score"), problem.alias("problem"), F.when(~unread, method).alias("method"), specificity.alias("specificity"))


def judged_eval(spark, d):
    """Precision, reciprocal rank, soft score and failures of the windows whose future papers are judged by three grades."""
    return B.judged_evaluation(predictions(spark, d), cut(_judged(spark, d)), TOP_K)


def delayed_feedback(spark, d):
    """What became of every prediction of the windows: the paper it took, if any."""
    predicted = predictions(spark, d)
    return B.delayed_feedback(predicted.select(*WINDOW, "rank", "pred_id"), greedy_match(spark, d), WINDOW).select("pred_id", "paper", "score", "matched")


_COUNTED = f"""{PAPERS}, corpus as (select topic_id topic, paper_id, published, year(published)*12+month(published)-1 m from p where topic_id is not null and published is not null),
 cutoffs as (select distinct make_date(cast(m//12 as bigint), cast(m%12+1 as bigint), 1) cutoff, m from corpus where m <= (select max(m) from corpus) - {HORIZON}),
 counts as (select topic, cutoff, c.m, count(*) filter (where published <= cutoff) train_n, count(*) filter (where published > cutoff and p.m <= c.m + {HORIZON}) future_n from corpus p join cutoffs c on true group by topic, cutoff, c.m)"""
#: The whole texts of an idea and of a paper, up to blanks.
IDEA_TEXT = "concat_ws(' ', title, rationale, approach, nullif(array_to_string(list_filter(list_transform(coalesce(key_terms, []), lambda x: trim(x, ' ')), lambda x: x <> ''), ' '), ''))"
PAPER_TEXT = "concat(coalesce(title, ''), ' Keywords: ', coalesce(array_to_string(keywords, ', '), ''), ' ', coalesce(summary, ''))"
_CUT = "try_cast(case when length(trim(cutoff_date)) = 7 then trim(cutoff_date) || '-01' else trim(cutoff_date) end as date)"
_MET = f"""{PAPERS}, i as (select distinct on (pred_id) * from idea_predictions), c as (select *, {_CUT} cut from i), o as (select strategy_id, topic_id, cut, pred_id, row_number() over (partition by strategy_id, topic_id, cut order by score desc nulls last, pred_id)::int rank, {TOK.format(IDEA_TEXT)} a from c where topic_id is not null and cut is not null qualify rank <= {TOP_K}),
  r as (select topic_id, paper_id paper, published, year(published) * 12 + month(published) m, {TOK.format(PAPER_TEXT)} b from p where topic_id is not null and published is not null),
  met as (select * from o join r using (topic_id) where published > cut and m <= year(cut) * 12 + month(cut) + {HORIZON})"""
#: A fold over k, the candidates sorted within each window: each takes what is free.
_TAKE = """l as (select strategy_id, topic_id, cut, list([{'rank': rank, 'paper': paper, 'score': score}] order by rank, score desc, paper desc) c from k group by all),
  u as (select strategy_id, topic_id, cut, unnest(list_reduce(c, lambda acc, x: case when len(list_filter(acc, lambda y: y.rank = x[1].rank or y.paper = x[1].paper)) > 0 then acc else list_concat(acc, x) end)) t from l),
  taken as (select strategy_id, topic_id, cut, t.rank, t.paper, t.score from u)"""
_CANDIDATES = f"{_MET}, k as (select strategy_id, topic_id, cut, rank, paper, score, published from (select *, round({jac('a', 'b')}, 6) score from met) where score > {LEAST})"
_END = f"last_day((date_trunc('month', cut) + interval {HORIZON} month)::date)"
_EVALUATED = f"""{_CANDIDATES}, {_TAKE}, s as (select w.topic_id, cut, count(*) filter (where published <= cut) train_n, count(*) filter (where published > cut and published <= {_END}) future_n from (select distinct topic_id, cut from o) w join r on r.topic_id = w.topic_id group by 1, 2),
  g as (select o.strategy_id, o.topic_id, o.cut, o.rank, t.paper, date_diff('day', o.cut, r.published) ahead, exists (select 1 from k where k.strategy_id is not distinct from o.strategy_id and k.topic_id = o.topic_id and k.cut = o.cut and k.rank = o.rank) able
   from o left join taken t on t.strategy_id is not distinct from o.strategy_id and t.topic_id = o.topic_id and t.cut = o.cut and t.rank = o.rank left join r on r.topic_id = t.topic_id and r.paper = t.paper),
  v as (select strategy_id, topic_id, cut, count(*) n, count(paper) matched, min(rank) filter (where paper is not null) f, sum(ahead) ahead, count(*) filter (where able and paper is null) blocked from g group by all),
  evaluated as (select strategy_id, v.topic_id, v.cut, train_n, future_n, matched, (matched > 0)::int::double hit_at_k, round(matched / future_n, 4) coverage_at_k, round(matched / least({TOP_K}, n), 4) precision_at_k, round(coalesce(1.0 / f, 0), 4)::double mrr,
   round(coalesce(ahead / (matched * date_diff('day', v.cut, {_END.replace('cut', 'v.cut')})), 0), 4) lead_time, round(blocked / n, 4) duplicate_rate from v join s on s.topic_id = v.topic_id and s.cut = v.cut where train_n >= {MIN_TRAIN} and future_n > 0)"""
_MEAN = "floor((2 * sum(round({0} * 10000)::bigint) + count({0})) / nullif(2 * count({0}), 0)) / 10000"
_G = "(('0x' || substr(md5(concat_ws('|', {0})), 1, 6))::bigint % {1})"

SQL = {
    "window_split_counts": f"with {_COUNTED} select topic, cutoff, train_n, future_n from counts where train_n >= {MIN_TRAIN} and future_n > 0",
    "greedy_match": f"with {_CANDIDATES}, {_TAKE} select * from taken",
    "window_eval": f"with {_EVALUATED} select * from evaluated",
    "topic_weighted_rollup": f"""with {_EVALUATED}, t as (select topic_id topic, count(*) windows, {', '.join(f'{_MEAN.format(m)} {m}' for m in B.METRICS)} from evaluated group by 1)
      select * from t union all select 'ALL', sum(windows)::bigint, {', '.join(f'floor((2 * sum(round({m} * 10000)::bigint * windows) + sum(windows)) / (2 * sum(windows))) / 10000' for m in B.METRICS)} from t having count(*) > 0""",
    "record_backtest": f"""with {_EVALUATED}, a as (select strategy_id, topic_id, count(*) windows, {_MEAN.format('hit_at_k')} hit, {_MEAN.format('mrr')} mrr from evaluated group by all)
      select w.strategy_id, w.topic_id, coalesce(windows, 0) windows, hit, mrr, floor((14 * round(hit * 10000) + 6 * round(mrr * 10000) + 10) / 20) / 10000 score, case when windows is null then 'no window with train and future papers' end error
      from (select distinct strategy_id, topic_id from o) w left join a on a.strategy_id is not distinct from w.strategy_id and a.topic_id = w.topic_id""",
    "judged_eval": f"""with {_MET}, j as (select strategy_id, topic_id, cut, rank, paper, -(('0x' || substr(md5(paper), 1, 8))::bigint)::double score, {_G.format("paper, pred_id, 'p'", 4)} p, case when {_G.format('pred_id, paper', 16)} <> 0 then {_G.format("paper, pred_id, 'm'", 4)} end m, {_G.format("paper, pred_id, 's'", 4)} s from met),
      k as (select * from j where p + m >= 5 and s >= 2), {_TAKE}, h as (select t.strategy_id, t.topic_id, t.cut, count(*) matched, min(t.rank) f, sum(p + m + s) points from taken t join k on k.strategy_id is not distinct from t.strategy_id and k.topic_id = t.topic_id and k.cut = t.cut and k.rank = t.rank and k.paper = t.paper group by all),
      n as (select strategy_id, topic_id, cut, count(*) calls, count(*) filter (where m is null) failed from j group by all)
      select w.strategy_id, w.topic_id, w.cut, coalesce(matched, 0) matched, coalesce(calls, 0) judge_calls, (coalesce(matched, 0) > 0)::int::double hit_at_k, round(coalesce(matched, 0) / {TOP_K}, 4) precision_at_k, round(coalesce(1.0 / f, 0), 4)::double mrr, round(coalesce(points / (9 * matched), 0), 4) soft_score, coalesce(round(failed / calls, 4), 0) failed_share
      from (select distinct strategy_id, topic_id, cut from o) w left join h on h.strategy_id is not distinct from w.strategy_id and h.topic_id = w.topic_id and h.cut = w.cut left join n on n.strategy_id is not distinct from w.strategy_id and n.topic_id = w.topic_id and n.cut = w.cut""",
    "delayed_feedback": f"with {_CANDIDATES}, {_TAKE} select pred_id, t.paper, coalesce(t.score, 0) score, t.paper is not null matched from o left join taken t on t.strategy_id is not distinct from o.strategy_id and t.topic_id = o.topic_id and t.cut = o.cut and t.rank = o.rank",
}
QUERIES = {f.__name__: f for f in (window_split_counts, greedy_match, window_eval, topic_weighted_rollup, record_backtest, judged_eval, delayed_feedback)}
