"""Queries on reviews, adjudications and the evaluation of governed records.

Records, reviews and adjudications are derived from documents and labels by draws that both engines evaluate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.jobs.inputs import draw, table, to_duck, to_spark
from sluicework.operators import metrics, reviews

NAMES = tuple(reviews.SUBSET_EVIDENCE)
BASES = ("insufficient_evidence", "stated_text_fact", "objective_visual_evidence", "valid_elimination")


def _pick(k: int, names: tuple[str, ...]) -> str:
    return f"case {draw(k, len(names))} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"


#: Fields by document; a second subset is there for a third of them.
RECORD = {"author_id": f"concat('a', cast({draw(41, 9)} as string))", "expected_label": draw(42, 3), "uncertainty_option_index": draw(43, 3)}
REVIEW = {
    "reviewer_id": f"concat('a', cast({draw(44, 9)} as string))",
    "independent_label": f"case when {draw(45, 5)} = 0 then {draw(46, 3)} else {draw(42, 3)} end",
    "proposed_label": f"case when {draw(47, 11)} = 0 then {draw(48, 3)} else {draw(42, 3)} end",
    "decision": f"case {draw(49, 6)} when 0 then 'rejected' when 1 then 'adjudication_required' when 2 then 'adjudication_required' else 'reviewed' end",
    "evidence_basis": _pick(50, BASES),
    "checks_pass": f"{draw(51, 7)} > 0",
}
FINAL = {
    "adjudicator_id": f"concat('a', cast({draw(52, 9)} as string))",
    "final_label": draw(53, 3),
    "decision": f"case when {draw(54, 4)} = 0 then 'rejected' else 'adjudicated' end",
    "evidence_basis": _pick(55, BASES),
    "checks_pass": f"{draw(56, 7)} > 0",
}
FINAL_GIVEN = f"{draw(57, 5)} > 0"
SUBSETS = {"subsets": (58, 59, 60), "final_subsets": (61, 62, 63)}


def _struct(fields: dict[str, str], *more: Column) -> Column:
    return F.struct(*[F.expr(to_spark(e)).alias(c) for c, e in fields.items()], *more)


def _subsets(name: str) -> Column:
    a, b, c = SUBSETS[name]
    first, second = F.expr(to_spark(_pick(a, NAMES))), F.expr(to_spark(_pick(b, NAMES)))
    return F.when(F.expr(to_spark(f"{draw(c, 3)} = 0")), F.array(first, second)).otherwise(F.array(first)).alias(name)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their review, which labelled documents have, and their adjudication."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    records = docs.select("doc_id", _struct(RECORD, _subsets("subsets")).alias("record"))
    given = labels.select("doc_id", _struct(REVIEW).alias("review"))
    finals = labels.filter(F.expr(to_spark(FINAL_GIVEN))).select("doc_id", _struct(FINAL, _subsets("final_subsets")).alias("final"))
    return records.join(given, "doc_id", "left").join(finals, "doc_id", "left").withColumnRenamed("doc_id", "sample_id")


def review_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    record, review, final = F.col("record"), F.col("review"), F.col("final")
    needed = (review["decision"] == "adjudication_required") & final.isNotNull()
    adjudication = F.when(needed, reviews.adjudication_violation(record, review, final))
    return _joined(spark, sf_dir).filter("review is not null").select("sample_id", reviews.review_violation(record, review).alias("review_violation"), adjudication.alias("adjudication_violation"))


def updated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.updated_records(_joined(spark, sf_dir)).withColumn("subsets", F.array_join("subsets", ","))


def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reviews.review_history(_joined(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, ",") for c in ("before_subsets", "after_subsets")})


def multi_subset_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record counts once in each of its subsets; a subset without records has accuracy 0.0."""
    hit = F.expr(to_spark(f"cast({draw(42, 3)} = {draw(64, 3)} as int)")).alias("hit")
    return metrics.accuracy_by_subset(table(spark, sf_dir, "documents").select("doc_id", _subsets("subsets"), hit), "subsets", [*NAMES, "nobody"])


FLAGS = {
    "parse_valid": f"case {draw(65, 9)} when 0 then false when 1 then null else true end",
    "image_loaded": f"case {draw(66, 11)} when 0 then false when 1 then null else true end",
    "unresolved": f"case {draw(67, 8)} when 0 then true when 1 then null else false end",
}


def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(*[F.expr(to_spark(e)).alias(c) for c, e in FLAGS.items()])
    return metrics.failure_rates(rows, *FLAGS)


QUERIES = (review_violations, updated_records, review_history, multi_subset_accuracy, failure_rates)


def _list(name: str) -> str:
    a, b, c = SUBSETS[name]
    return f"case when {draw(c, 3)} = 0 then [{_pick(a, NAMES)}, {_pick(b, NAMES)}] else [{_pick(a, NAMES)}] end"


def _evidence(label: str, subsets: str, basis: str) -> str:
    allowed = " or ".join(f"(x = '{k}' and {basis} in ({', '.join(repr(e) for e in v)}))" for k, v in reviews.SUBSET_EVIDENCE.items())
    wrong = f"list_filter({subsets}, lambda x: not ({allowed}))"
    return f"""when done and {label} = u and ({basis} <> 'insufficient_evidence' or not list_contains({subsets}, 'ambiguous')) then 'uncertainty label requires ambiguous/insufficient evidence'
 when done and {label} <> u and ({basis} = 'insufficient_evidence' or list_contains({subsets}, 'ambiguous')) then 'resolvable label has inconsistent evidence'
 when done and {label} <> u and len({wrong}) > 0 then 'evidence_basis is incompatible with subsets ' || array_to_string({wrong}, ', ')"""


_ALL = f"""r as (select doc_id as sample_id, {RECORD["author_id"]} as author, {RECORD["expected_label"]} as label, {RECORD["uncertainty_option_index"]} as u, {_list("subsets")} as subsets,
 {REVIEW["reviewer_id"]} as reviewer, {REVIEW["independent_label"]} as own, {REVIEW["proposed_label"]} as proposed, {REVIEW["decision"]} as decision, {REVIEW["evidence_basis"]} as basis, {REVIEW["checks_pass"]} as checks,
 {FINAL_GIVEN} as has_final, {FINAL["adjudicator_id"]} as judge, {FINAL["final_label"]} as f_label, {FINAL["decision"]} as f_decision, {FINAL["evidence_basis"]} as f_basis, {FINAL["checks_pass"]} as f_checks, {_list("final_subsets")} as f_subsets
 from documents where doc_id in (select doc_id from labels))"""
ORACLE = {
    "review_violations": f"""with {_ALL}, a as (select *, decision = 'reviewed' as done from r), b as (select *, case when reviewer = author then 'independent reviewer must differ from author' when proposed <> label then 'proposed_label does not match dataset'
 when done and own <> proposed then 'reviewed decision requires matching independent_label' when done and not checks then 'reviewed decision requires all quality checks' {_evidence("own", "subsets", "basis")} end as review_violation from a),
c as (select * exclude (done), f_decision = 'adjudicated' as done from b)
select sample_id, review_violation, case when decision = 'adjudication_required' and has_final then case when judge = author then 'adjudicator must differ from author' when judge = reviewer then 'adjudicator must differ from reviewer'
 when done and not f_checks then 'adjudicated decision requires all quality checks' {_evidence("f_label", "f_subsets", "f_basis")} end end as adjudication_violation from c""",
    "updated_records": f"""with {_ALL}, a as (select *, decision = 'adjudication_required' and has_final and f_decision = 'adjudicated' as by_final from r)
select sample_id, case when by_final then f_label else label end as expected_label, case when by_final then f_label else label end = u as expected_is_uncertainty, array_to_string(case when by_final then f_subsets else subsets end, ',') as subsets,
 case when by_final then 'adjudicated' else 'reviewed' end as review_status, case when by_final then judge else reviewer end as reviewer_id from a where by_final or decision = 'reviewed'""",
    "review_history": f"""with {_ALL} select sample_id, 1 as step, 'review' as event_type, reviewer as actor_id, decision, label as before_label, case when decision = 'reviewed' then label end as after_label, array_to_string(subsets, ',') as before_subsets,
 case when decision = 'reviewed' then array_to_string(subsets, ',') end as after_subsets from r
union all select sample_id, 2, 'adjudication', judge, f_decision, label, case when f_decision = 'adjudicated' then f_label end, array_to_string(subsets, ','), case when f_decision = 'adjudicated' then array_to_string(f_subsets, ',') end from r where has_final and decision = 'adjudication_required'""",
    "multi_subset_accuracy": f"""with d as (select doc_id, unnest(list_distinct({_list("subsets")})) as name, case when {draw(42, 3)} = {draw(64, 3)} then 1 else 0 end as hit from documents),
dim as (select unnest(['{"', '".join((*NAMES, "nobody"))}']) as name), g as (select dim.name, count(doc_id) as n, cast(coalesce(sum(hit), 0) as bigint) as correct from dim left join d on dim.name = d.name group by dim.name)
select name, n, correct, case when n > 0 then cast(correct as double) / n else 0.0 end as accuracy from g""",
    "failure_rates": f"""with f as (select {", ".join(f"{e} as {c}" for c, e in FLAGS.items())} from documents)
select count(*) as n, cast(count(*) filter (not coalesce(parse_valid, true)) as double) / count(*) as parse_failure_rate, cast(count(*) filter (not coalesce(image_loaded, true)) as double) / count(*) as image_load_failure_rate,
 cast(count(*) filter (coalesce(unresolved, false)) as double) / count(*) as unresolved_rate from f""",
}
ORACLE = {k: to_duck(v) for k, v in ORACLE.items()}
