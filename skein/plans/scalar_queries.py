"""Queries over dates, texts, scores and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators.mapping import exact_map
from skein.sources.tables import table


def papers(spark, d):
    """Papers once each, with the date of publication that their fields allow."""
    p = table(spark, d, "papers").dropDuplicates(["paper_id"])
    return p.withColumn("published", D.published_of_paper(F.col("published_date"), F.col("paper_id"), F.col("pub_month")))


#: The same in SQL, as a table expression p.
PAPERS = """p as (select distinct on (paper_id) *, coalesce(
  try_cast(case when regexp_full_match(trim(published_date), '\\d{4}-\\d{2}-\\d{2}') then trim(published_date) end as date),
  last_day(try_cast(case when regexp_full_match(trim(published_date), '\\d{4}-\\d{2}') then trim(published_date) || '-01' end as date)),
  last_day(try_cast(case when regexp_matches(paper_id, '^\\d{2}(0[1-9]|1[0-2])\\.') then '20' || substr(paper_id, 1, 2) || '-' || substr(paper_id, 3, 2) || '-01' end as date)),
  last_day(try_cast(case when regexp_full_match(pub_month, '\\d{4}-\\d{2}') then pub_month || '-01' end as date))) published from papers)"""
TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


def jac(a: str, b: str, empty: str = "0") -> str:
    return f"case when len({a}) + len({b}) = 0 then {empty} else len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::double end"


def papers_dated(spark, d):
    return papers(spark, d).select("paper_id", "published", D.yymm(F.col("published")).alias("yymm"), D.month_index(F.col("published")).alias("month_index"))


def month_scalars(spark, d):
    m = D.normalize_month(F.col("raw"))
    p = table(spark, d, "papers").select(F.explode(F.array("pub_month", "published_date", F.substring("paper_id", 1, 4))).alias("raw")).distinct().withColumn("month", m)
    return p.select("raw", "month", D.index_of_month(F.col("month")).alias("index"), D.shift_month(F.col("month"), 3).alias("plus3"), D.month_start(F.col("month")).alias("first_day"), D.month_end(F.col("month")).alias("last_day"))


def cutoff_scalars(spark, d):
    c = table(spark, d, "dz_rows").select("cutoff_t").distinct()
    first, last = D.cutoff_date(F.col("cutoff_t")), D.published_date(F.col("cutoff_t"))
    return c.select("cutoff_t", first.alias("as_cutoff"), last.alias("as_published"), F.date_add(first, 1).alias("index_key"), D.month_index(last).alias("m"))


def lead_times(spark, d):
    s = table(spark, d, "hindsight_samples").dropDuplicates(["sample_id"])
    cut, pub = D.cutoff_date(F.col("cutoff_date")), D.published_date(F.col("future_paper_published_date"))
    return s.select("sample_id", F.datediff(pub, cut).alias("days"), F.round(D.lead_time_fraction(pub, cut, F.last_day(F.add_months(cut, 3))), 4).alias("fraction"))


def daily_cutoffs(spark, d):
    e = table(spark, d, "events")
    return e.select(F.to_date("ts").alias("utc_day"), D.new_york_date(F.col("ts")).alias("new_york_day")).groupBy("utc_day", "new_york_day").agg(F.count("*").alias("n"))


def title_scalars(spark, d):
    p = papers(spark, d)
    t = F.col("title")
    return p.select("paper_id", T.phrase(t).alias("phrase"), T.title_key(t).alias("title_key"), T.short_hash(t).alias("hash"), T.shortened(t, 40).alias("short"), F.size(T.token_set(t)).alias("n_tokens"))


def keywords_clean(spark, d):
    return papers(spark, d).select("paper_id", F.array_join(T.keyword_list(F.col("keywords"), F.col("title")), "|").alias("keywords"))


def similarity_scalars(spark, d):
    p = table(spark, d, "idea_predictions").dropDuplicates(["pred_id"])
    e = F.lit("")
    a, b = T.token_set(F.coalesce("title", e)), T.token_set(F.coalesce("rationale", e))
    p = p.select("pred_id", a.alias("a"), b.alias("b"))
    return p.select("pred_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(T.jaccard(F.col("a"), F.col("b"), 1.0), 6).alias("jaccard_empty_1"), F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


def coerced_scores(spark, d):
    p = table(spark, d, "idea_predictions").dropDuplicates(["pred_id"])
    return p.select("pred_id", T.coerced_score(F.col("score")).alias("score"), T.coerced_score(F.col("confidence")).alias("confidence"))


def clean_texts(spark, d):
    c = T.without_control(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(c).alias("n"), T.short_hash(c, 12).alias("hash"))


def operator_closed_ids(spark, d):
    inventory = table(spark, d, "operator_inventory")
    names = inventory.select("op_id", F.explode(F.concat(F.array("op_id", "op_name"), "aliases")).alias("name"))
    rows = table(spark, d, "dz_rows").dropDuplicates(["dz_id"]).select("dz_id", "operator_closed")
    return exact_map(rows, "operator_closed", names, "name", "op_id", "other").select("dz_id", F.col("mapped").alias("op_id"))


#: Fixed order: the first hint found decides.
HINTS = [("scale", ("scal", "large")), ("benchmark", ("benchmark", "dataset")), ("simplify", ("sparse", "minimal")), ("analyze", ("rethinking", "explain"))]


def operator_hints(spark, d):
    p = papers(spark, d)
    hint = T.first_hint(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))), HINTS, "extend")
    return p.select("paper_id", hint.alias("operator"))


def judge_replies(spark, d):
    p = table(spark, d, "idea_predictions").dropDuplicates(["pred_id"])
    reply = F.concat(F.lit("<think>METHOD_MATCH: 3</think>\nproblem_match: "), (F.col("pred_id") % 4).cast("string"), F.lit("\n METHOD_MATCH : "), (F.col("pred_id") % 5).cast("string"), F.lit("\nSPECIFICITY: "), F.when(F.col("pred_id") % 7 == 0, "2/3").otherwise((F.col("pred_id") % 3).cast("string")))
    p = p.select("pred_id", reply.alias("r"))
    s = [T.judged(F.col("r"), x) for x in ("PROBLEM_MATCH", "METHOD_MATCH", "SPECIFICITY")]
    p = p.select("pred_id", s[0].alias("pm"), s[1].alias("mm"), s[2].alias("sp"), T.judged(F.col("r"), "SPECIFICITY", lenient=True).alias("sp_lenient"))
    args = (F.col("pm"), F.col("mm"), F.col("sp"))
    return p.select("*", V.judged_match(*args).alias("is_match"), V.strict_match(*args).alias("is_strict"), F.round(V.soft_score(*args), 4).alias("soft"))


def json_replies(spark, d):
    p = table(spark, d, "idea_predictions").dropDuplicates(["pred_id"])
    one = F.to_json(F.struct("rank", "title"))
    reply = F.when(F.col("pred_id") % 4 == 0, F.concat(F.lit("Sure: ["), one, F.lit(","), one, F.lit("] done"))).when(F.col("pred_id") % 4 == 1, F.concat(F.lit('{"ideas":['), one, F.lit("]}"))).when(F.col("pred_id") % 4 == 2, one).otherwise(F.lit("no ideas {"))
    return p.select("pred_id", F.posexplode(T.predictions(reply)).alias("pos", "p")).select("pred_id", "pos", F.col("p.rank").alias("rank"), F.col("p.title").alias("title"))


def citations_in_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.citations(F.col("text"), 8), "|").alias("cited")).filter(F.col("cited") != "")


def specificity_scores(spark, d):
    p = table(spark, d, "idea_predictions").dropDuplicates(["pred_id"])
    return p.select("pred_id", V.specificity(F.col("title"), F.col("rationale"), F.col("approach")).alias("specificity"))


def joint_scores(spark, d):
    s = table(spark, d, "scored_forecasts").select("forecast_id", "prior_score", "realization_score").dropDuplicates(["forecast_id"])
    return s.select("forecast_id", F.round(V.joint_score([(F.col("prior_score"), 0.4), (F.col("realization_score"), 0.6)]), 4).alias("joint"))


def vector_pairs(spark, d):
    e = table(spark, d, "embeddings")
    pairs = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    a, b = F.col("a.embedding"), F.col("b.embedding")
    return pairs.select(F.col("a.vec_id").alias("vec_id"), F.round(V.cosine(a, b), 5).alias("cos"), F.round(V.clamped_cosine(a, b), 5).alias("clamped"), F.round(V.squared_distance(a, b), 5).alias("sq"))


_PRED = "i as (select distinct on (pred_id) * from idea_predictions)"
_REPLY = """'problem_match: ' || (pred_id % 4) || chr(10) || ' METHOD_MATCH : ' || (pred_id % 5) || chr(10) || 'SPECIFICITY: ' || case when pred_id % 7 = 0 then '2/3' else (pred_id % 3)::varchar end"""
_CITED = "list_concat(" + ", ".join("regexp_extract_all(@, '" + p.replace("{4,6}", "{4,8}") + "', 1)" for p in T.CITATIONS) + ")"


def cited(text: str) -> str:
    """The citations of a text in SQL: distinct, in order."""
    found = _CITED.replace("@", f"coalesce({text}, '')")
    return f"list_transform(list_filter(list_zip({found}, range(1, len({found}) + 1)), lambda y: list_position({found}, y[1]) = y[2]), lambda y: y[1])"


SQL = {
    "citations_in_documents": f"with c as (select doc_id, array_to_string({cited('text')}, '|') cited from documents) select * from c where cited <> ''",
    "papers_dated": f"with {PAPERS} select paper_id, published, strftime(published, '%y%m') yymm, (year(published)*12+month(published)-1)::int month_index from p",
    "month_scalars": r"""with r as (select distinct unnest([pub_month, published_date, substr(paper_id,1,4)]) raw from papers),
      m as (select raw, case when regexp_full_match(trim(raw), '\d{4}-\d{2}(-\d{2})?') then substr(trim(raw),1,7) when regexp_full_match(trim(raw), '\d{2}(0[1-9]|1[0-2])') then '20' || substr(trim(raw),1,2) || '-' || substr(trim(raw),3,2) end as month from r)
      select raw, month, (substr(month,1,4)::int*12 + substr(month,6,2)::int - 1)::int as index, strftime((month || '-01')::date + interval 3 month, '%Y-%m') plus3, (month || '-01')::date first_day, last_day((month || '-01')::date) last_day from m""",
    "cutoff_scalars": r"""with c as (select distinct cutoff_t, trim(cutoff_t) t from dz_rows), v as (select *, try_cast(case when regexp_full_match(t, '\d{4}-\d{2}') then t || '-01' when regexp_full_match(t, '\d{4}-\d{2}-\d{2}') then t end as date) f from c)
      select cutoff_t, f as_cutoff, case when length(t) = 7 then last_day(f) else f end as_published, (f + 1)::date index_key, (year(f)*12+month(f)-1)::int m from v""",
    "lead_times": r"""with s as (select distinct on (sample_id) sample_id, trim(cutoff_date) c, trim(future_paper_published_date) p from hindsight_samples),
      v as (select sample_id, try_cast(case when length(c) = 7 then c || '-01' else c end as date) cut, case when length(p) = 7 then last_day(try_cast(p || '-01' as date)) else try_cast(p as date) end pub from s),
      w as (select *, last_day((cut + interval 3 month)::date) e from v)
      select sample_id, datediff('day', cut, pub)::int as days, round(coalesce(least(greatest(datediff('day', cut, pub) / datediff('day', cut, e)::double, 0), 1), 0), 4) fraction from w""",
    "daily_cutoffs": "select ts::date utc_day, timezone('America/New_York', timezone('UTC', ts))::date new_york_day, count(*) n from events group by all",
    "title_scalars": rf"""with {PAPERS} select paper_id, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') phrase, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) title_key, substr(sha256(title), 1, 16) hash,
      case when length(title) > 40 then rtrim(substr(title, 1, 37)) || '...' else title end short, len({TOK.format('title')})::int n_tokens from p""",
    "keywords_clean": f"""with {PAPERS}, k as (select paper_id, list_sort(list_distinct(list_filter(list_transform(keywords, lambda x: trim(lower(x))), lambda x: x <> ''))) k,
      list_filter(list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 3 and x not in {T.STOP_WORDS}) w from p)
      select paper_id, case when len(k) > 0 then array_to_string(k, '|') else coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda y: list_position(w, y[1]) = y[2]), lambda y: y[1]), '|'), '') end keywords from k""",
    "similarity_scalars": f"""with {_PRED}, t as (select pred_id, {TOK.format("coalesce(title, '')")} a, {TOK.format("coalesce(rationale, '')")} b from i)
      select pred_id, round({jac('a', 'b')}, 6) jaccard, round({jac('a', 'b', '1')}, 6) jaccard_empty_1, round(case when least(len(a), len(b)) = 0 then 0 else len(list_intersect(a, b)) / least(len(a), len(b))::double end, 6) overlap from t""",
    "coerced_scores": f"with {_PRED} select pred_id, round(least(greatest(case when score > 1 then score / 10 else score end, case when score is not null then 0 end), case when score is not null then 1 end), 4) score, round(least(greatest(case when confidence > 1 then confidence / 10 else confidence end, case when confidence is not null then 0 end), case when confidence is not null then 1 end), 4) confidence from i",
    "clean_texts": r"with c as (select doc_id, regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g') t from documents) select doc_id, length(t)::int n, substr(sha256(t), 1, 12) hash from c",
    "operator_closed_ids": """with n as (select op_id, lower(trim(unnest(list_concat([op_id, op_name], aliases)))) name from operator_inventory), m as (select name, min(op_id) op_id from n group by name), z as (select distinct on (dz_id) dz_id, operator_closed from dz_rows)
      select dz_id, coalesce(op_id, 'other') op_id from z left join m on lower(trim(operator_closed)) = name""",
    "operator_hints": f"""with {PAPERS}, t as (select paper_id, lower(coalesce(title, '') || ' ' || coalesce(summary, '')) t from p)
      select paper_id, case {' '.join('when ' + ' or '.join(f"contains(t, '{w}')" for w in ws) + f" then '{n}'" for n, ws in HINTS)} else 'extend' end operator from t""",
    "judge_replies": f"""with {_PRED}, r as (select pred_id, {_REPLY} r from i), s as (select pred_id, try_cast(regexp_extract(r, '(?m)^problem_match: ([0-3])', 1) as int) pm, try_cast(regexp_extract(r, '(?m)^ METHOD_MATCH : ([0-3])', 1) as int) mm,
      try_cast(regexp_extract(r, 'SPECIFICITY: ([0-3])$', 1) as int) sp, try_cast(regexp_extract(r, 'SPECIFICITY: ([0-9])', 1) as int) sp_lenient from r)
      select *, pm + mm >= 5 and sp >= 2 is_match, pm + mm >= 5 and sp >= 3 is_strict, round((pm + mm + sp) / 9, 4) soft from s""",
    "json_replies": """with i as (select distinct on (pred_id) pred_id, rank, title from idea_predictions) select pred_id, unnest(case when pred_id % 4 = 0 then [0, 1] else [0] end)::int pos, rank, title from i where pred_id % 4 < 3 and trim(title) <> ''""",
    "specificity_scores": f"""with {_PRED} select pred_id, round((case when trim(coalesce(title, '')) <> '' then 0.2 else 0 end + 0.4 * least(1, length(trim(coalesce(rationale, ''))) / 80) + 0.4 * least(1, length(trim(coalesce(approach, ''))) / 80)) / 1.0, 4)::double specificity from i""",
    "joint_scores": "with s as (select distinct on (forecast_id) * from scored_forecasts) select forecast_id, round(coalesce(prior_score, 0) * 0.4::double + coalesce(realization_score, 0) * 0.6::double, 4) joint from s",
    "vector_pairs": """with p as (select a.vec_id, a.embedding::double[64] x, b.embedding::double[64] y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
      select vec_id, round(array_cosine_similarity(x, y), 5) cos, round(greatest(array_cosine_similarity(x, y), 0), 5) clamped, round(array_distance(x, y) * array_distance(x, y), 5) sq from p""",
}
QUERIES = {f.__name__: f for f in (papers_dated, month_scalars, cutoff_scalars, lead_times, daily_cutoffs, title_scalars, keywords_clean, similarity_scalars, coerced_scores, clean_texts, operator_closed_ids, operator_hints, judge_replies, json_replies, citations_in_documents, specificity_scores, joint_scores, vector_pairs)}
