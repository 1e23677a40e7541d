"""Queries on replies in JSON, prompts from templates, and what a round of reviews or an evaluation finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions import prompts
from sluicework.jobs import outputs
from sluicework.jobs import verification as made
from sluicework.jobs.inputs import draw, table, to_duck, to_spark
from sluicework.operators import json_answers, metrics, reviews

_FORM = draw(601, 14)
_LABEL = f"cast({draw(602, 3)} as string)"
_INDEX = f"cast({draw(603, 3)} as string)"
_SIGNAL = draw(604, 2)
#: Replies: a whole text, then a line that should hold JSON.
REPLY = f"""case {_FORM} when 0 then null when 1 then '' when 2 then concat(text, ' 1 and 2') when 3 then 'no digit' when 4 then concat(text, chr(10), 'FINAL_ANSWER_JSON: {{"label": }}')
 when 5 then concat(text, chr(10), 'FINAL_ANSWER_JSON: {{"label": 3}}') when 6 then concat(text, chr(10), 'FINAL_ANSWER_JSON: {{"label": true}}') when 7 then concat(text, chr(10), 'FINAL_ANSWER_JSON: {{"a": 1}}')
 else concat(coalesce(text, ''), chr(10), 'so FINAL_ANSWER_JSON : {{"label": ', case when {_FORM} = 8 then {_LABEL} else concat('"', {_LABEL}, '"') end, ', "uncertainty_option_index": ', {_INDEX},
  case when {_FORM} = 9 then '' when {_SIGNAL} = 0 then ', "uncertainty_signal": false' else ', "uncertainty_signal": "yes"' end, '}}', chr(10), ' ') end"""
REPLY = REPLY.replace("{{", "{").replace("}}", "}")


def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(to_spark(REPLY)).alias("reply"), F.array(*[F.expr(to_spark(o)) for o in outputs.OPTION.values()]).alias("options"))
    return json_answers.final_answers(docs, "doc_id", "reply", "options")


#: A template of the second pass; its braces are text.
TEMPLATE = "Sample {sample_id}: {{\n{context}\n}} Question: {question}\n{answers}\nFirst label: {label}, because {evidence} ({label})\n"


def template_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of whole documents, by a template with named placeholders; what a failed first pass left is null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.expr(to_spark(made.LABEL)).alias("label"), F.expr(to_spark(f"{draw(611, 4)} > 0")).alias("known"))
    text = prompts.render(TEMPLATE, {
        "sample_id": F.col("doc_id"), "context": F.col("text"), "question": F.concat(F.lit("Is it {lang} "), "lang"), "answers": prompts.numbered(F.array("source", "lang")),
        "label": F.when(F.col("known"), F.col("label")), "evidence": F.when(F.col("known"), F.col("source")),
    })
    return docs.select("doc_id", F.md5(text).alias("prompt_md5"))


_SAID = "case when toxic = 1 then 'adjudication_required' when quality = 1 then 'reviewed' else 'rejected' end"


def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents reviewed by their labels; disputes are settled by those that have a page."""
    labels, pages = table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    decisions = labels.select("doc_id", F.expr(_SAID).alias("decision"))
    settled = labels.filter("toxic = 1").join(pages, "doc_id", "left_semi").select("doc_id", F.expr("case when quality = 1 then 'accept' else 'reject' end").alias("decision"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    coverage = docs.groupBy("lang").agg(F.count("*").alias("n")).filter("n < 150").select(F.col("lang").alias("ord"), F.concat("lang", F.lit(" requires at least 150 records")).alias("message"))
    found = reviews.review_report(docs.select("doc_id"), decisions, settled, "doc_id", 600, coverage.filter("ord is not null"))
    return found.withColumn("violations", F.array_join("violations", "; "))


_PRED = {"label": f"case {draw(621, 12)} when 0 then 3 when 1 then null when 2 then -1 else {draw(622, 3)} end", "seconds": f"case {draw(623, 12)} when 0 then -0.5 when 1 then null when 2 then cast('nan' as double) else n_chars / 8 end"}


def prediction_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", *[F.expr(to_spark(e)).alias(c) for c, e in _PRED.items()])
    return metrics.prediction_faults(rows, "doc_id", "label", "seconds")


TRAPS = ("src1", "en", "src3", "none")


def subset_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong labels within subsets that overlap: the languages and sources of labelled documents."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.array("lang", "source", "lang").alias("subsets"), (F.col("quality") == F.col("n_chars") % 2).alias("hit"))
    return metrics.subset_errors(rows, "subsets", "hit", TRAPS)


QUERIES = (json_replies, template_prompts, review_report, prediction_faults, subset_errors)
_U = outputs._UNKNOWN_AT
ORACLE = {
    "json_replies": f"""with d as (select doc_id, text, {_FORM} as k, {_LABEL} as l, {_INDEX} as i, {_SIGNAL} as sig, [{", ".join(outputs.OPTION.values())}] as o from documents), e as (select *, cast({_U} as int) as u from d),
w as (select *, concat_ws('; ', case when cast(i as int) <> u then 'uncertainty_option_index ' || i || ' != expected ' || u end, case when k <> 9 and (sig = 1) <> (cast(l as int) = u) then 'uncertainty_signal mismatch' end) as warn from e),
m as (select *, case when text is null and k in (2, 4, 5, 6, 7) then 0 else k end as k2 from w)
select doc_id, cast(case when k2 = 2 then 2 when k2 > 7 then cast(l as int) end as int) as label,
 case when k2 in (0, 1) then 'empty' when k2 = 2 then 'digit_fallback' when k2 = 3 then 'parse_failed' when k2 = 4 then 'json_decode_error' when k2 in (5, 6, 7) then 'invalid_label' when warn = '' then 'final_json' else 'final_json_contract_warning' end as method,
 case when k2 in (0, 1) then 'empty response' when k2 in (2, 3) then 'missing FINAL_ANSWER_JSON' when k2 = 4 then 'Expecting value: line 1 column 11 (char 10)' when k2 = 5 then 'invalid label: ''3''' when k2 = 6 then 'invalid label: ''True'''
  when k2 = 7 then 'invalid label: None' else nullif(warn, '') end as error from m""",
    "template_prompts": f"""with d as (select *, {draw(611, 4)} > 0 as known, {made.LABEL} as l from documents),
e as (select *, coalesce(case when known then l end, 'null') as a, coalesce(case when known then source end, 'null') as b from d)
select doc_id, md5('Sample ' || doc_id || ': {{' || chr(10) || coalesce(text, 'null') || chr(10) || '}} Question: ' || 'Is it {{lang}} ' || lang || chr(10) || '0. ' || source || chr(10) || '1. ' || lang || chr(10) || 'First label: ' || a || ', because ' || b || ' (' || a || ')' || chr(10)) as prompt_md5 from e""",
    "review_report": f"""with r as (select d.doc_id, {_SAID} as s, l.doc_id is null as none, case when toxic = 1 and d.doc_id in (select page_id from pages) then case when quality = 1 then 'accept' else 'reject' end end as f from documents d left join labels l on d.doc_id = l.doc_id),
c as (select count(*) as input_records, count(*) filter (not none) as decisions, (select count(*) from labels where toxic = 1 and doc_id in (select page_id from pages)) as adjudications, count(*) filter (not none and s = 'reviewed') as reviewed,
 count(*) filter (f = 'accept') as adjudicated, count(*) filter (not none and s = 'rejected' or f = 'reject') as rejected, count(*) filter (not none and s = 'adjudication_required') as disputes, count(*) filter (not none and s = 'adjudication_required' and f is null) as open from r),
v as (select string_agg(lang || ' requires at least 150 records', '; ' order by lang) as t from (select lang from documents where lang is not null group by lang having count(*) < 150)),
t as (select c.*, nullif(concat_ws('; ', case when input_records <> 600 then 'review input must contain exactly 600 records' end, case when input_records <> decisions then 'all 600 input records require a terminal review decision' end,
 case when open > 0 then open || ' disputes require adjudication' end, v.t), '') as violations from c, v)
select input_records, decisions, adjudications, reviewed, adjudicated, rejected, disputes, input_records - decisions as missing_decisions, reviewed + adjudicated as retained, input_records - decisions + open as unresolved, coalesce(violations, '') as violations, violations is null as promotion_ready from t""",
    "prediction_faults": f"""with p as (select doc_id, {_PRED["label"]} as label, {_PRED["seconds"]} as seconds from documents)
select doc_id, doc_id || ': predicted_label must be 0, 1, or 2' as message from p where label is null or label not in (0, 1, 2) union all select doc_id, doc_id || ': elapsed_seconds must be non-negative' from p where seconds is null or isnan(seconds) or seconds < 0""",
    "subset_errors": f"""with r as (select lang, source, quality = n_chars % 2 as hit from labels join documents using (doc_id)), s as (select lang as x from r where not hit union all select source from r where not hit)
select name, count(x) as errors from (select unnest(['{"', '".join(TRAPS)}']) as name) n left join s on x = name group by name""",
}
ORACLE = {k: to_duck(v) for k, v in ORACLE.items()}
