"""Queries on artifacts and prompts: faults of lines, wrapped answers, prompt texts, merges of repairs and traps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions import prompts
from sluicework.jobs import outputs
from sluicework.jobs.inputs import draw, runs, table, to_duck, to_spark
from sluicework.operators import artifacts, decisions, parsing
from sluicework.operators.answers import ANONYMOUS_GROUP

OPTIONS = ("source", "lang", "'Cannot be determined'")
SAMPLE = f"case when {draw(71, 9)} = 0 then doc_id - 1 else doc_id end"
RUN, VERSION = f"case when {draw(72, 13)} = 0 then 'run2' else 'run1' end", f"case when {draw(73, 17)} = 0 then 'v0' when {draw(73, 17)} = 1 then 'v2' else 'v3' end"
STATUS = f"case {draw(74, 12)} when 0 then 'lost' when 1 then 'image_failed' else 'generated' end"
SHAPE = draw(75, 20)
_TEXT = "to_json(named_struct('raw_output', text))"  # without the key if it is null
LINE = f"""case {SHAPE} when 0 then ' ' when 1 then '[]' when 2 then '{{"run_id": "run1"' when 3 then '{{"run_id": 1}}' when 4 then '{{"run_id": "run1", "sample_id": " "}}'
 else concat('{{"run_id": "', {RUN}, '", "sample_id": "s', cast({SAMPLE} as string), '", "prompt_version": "', {VERSION}, '", "status": "', {STATUS}, '", ', substring({_TEXT}, 2, length({_TEXT}) - 1)) end"""


def artifact_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a line; its whole text is the raw output."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.expr(to_spark(LINE)).alias("line"))
    return artifacts.record_faults(lines, ("v2", "v3")).groupBy("fault").agg(F.count("*").alias("n"), F.sum("ordinal").alias("ordinals"))


def wrapped_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts around an object, some of them broken before it."""
    output = to_spark(f"concat(replace(coalesce(text, ''), '{{', '('), case {draw(76, 4)} when 0 then ' {{broken ' when 1 then ' {parsing.MARKER} ' else ' ' end, case when {draw(77, 5)} = 0 then 'none' else concat('{{\"label\": \"', {draw(78, 3)}, '\", \"a\": [1]}}') end, ' done')")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(output).alias("output"))
    return parsing.first_object(docs, "doc_id", "output")


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of whole documents and conversations' turns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.array(*[F.expr(o) for o in OPTIONS]).alias("options"))
    text = prompts.user_text(F.coalesce("text", F.lit("")), prompts.shown(F.col("lang")), F.col("options"))
    return docs.select("doc_id", F.md5(text).alias("prompt_md5"), F.length(text).cast("long").alias("n_chars"))


#: Questions: some ask for a tendency, of a whole text or of its source.
QUESTION = f"case {draw(81, 5)} when 0 then concat('Who is More Likely from ', source) when 1 then concat(text, ' Is it generally so') when 2 then concat('Likely ', text) when 3 then 'Who tends to' else text end"
_CANDIDATE = "cast((doc_id * 7 + quality) % 3 as bigint)"


def trap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of one run, corrected by another that has only the labelled documents; contexts and questions are whole texts."""
    docs = table(spark, sf_dir, "documents")
    items = docs.select("doc_id", F.expr(to_spark(outputs.CONTEXT)).alias("context"), F.expr(to_spark(QUESTION)).alias("question"), F.array(*[F.expr(to_spark(o)) for o in outputs.OPTION.values()]).alias("options"))
    base = runs(spark, sf_dir).select("doc_id", F.col("m0").alias("label"))
    candidate = table(spark, sf_dir, "labels").select("doc_id", F.expr(_CANDIDATE).alias("label"))
    return decisions.merge_traps(base, candidate, items, "doc_id")


def repair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr(to_spark(f"case when {draw(79, 4)} = 0 then 'invalid_json' else 'valid' end")).alias("status")
    source = runs(spark, sf_dir).select("doc_id", status, F.col("m0").alias("label"))
    again = table(spark, sf_dir, "labels").select("doc_id", F.expr(to_spark(f"case when {draw(80, 5)} = 0 then 'invalid_json' else 'valid' end")).alias("status"), F.col("quality").cast("long").alias("label"))
    return decisions.repair_merge(source, again, "doc_id", "status", ("run1", "repair1"))


QUERIES = (artifact_faults, wrapped_objects, prompt_texts, trap_merge, repair_merge)
_ASKED = "Which option is correct? Remember: if there is no explicit evidence, choose the uncertainty option."
ORACLE = {
    "artifact_faults": f"""with d as (select doc_id as ordinal, {SHAPE} as shape, {SAMPLE} as sample, {RUN} as run, {VERSION} as version, {STATUS} as status, text from documents),
known as (select * from d where shape > 4), f as (select sample, min(ordinal) as first from known group by sample),
h as (select min_by(run, ordinal) as run_0, min_by(version, ordinal) as version_0 from (select ordinal, run, version from known union all select ordinal, 'run1', null from d where shape = 4)),
v as (select min_by(version, ordinal) as version_0 from known), r as (select run_0 from h),
j as (select d.ordinal, case when shape = 0 then 'blank line' when shape = 2 then 'invalid JSON' when shape = 1 then 'must be a JSON object' when shape = 3 then 'invalid run_id' when shape = 4 then 'invalid sample_id'
 when version = 'v0' then 'invalid prompt_version' when version <> v.version_0 then 'mixes prompt_version values' when run <> run_0 then 'mixes run_id values' when d.ordinal > first then 'duplicate sample_id'
 when status = 'lost' then 'invalid status' when status <> 'generated' and text is not null then 'failure row must contain null raw_output' end as fault
 from d left join f on d.shape > 4 and d.sample = f.sample cross join v cross join r)
select fault, count(*) as n, cast(sum(ordinal) as bigint) as ordinals from j where fault is not null group by fault""",
    "wrapped_objects": f"""select doc_id, case when {draw(77, 5)} > 0 then '{{"a":[1],"label":"' || {draw(78, 3)} || '"}}' end as found from documents""",
    "prompt_texts": f"""with p as (select doc_id, 'Context: ' || coalesce(text, '') || chr(10) || 'Question: ' || coalesce(lang, 'null') || chr(10) || 'Options:' || chr(10) || '0. ' || source || chr(10) || '1. ' || lang || chr(10) || '2. Cannot be determined' || chr(10) || chr(10) || '{_ASKED}' as t from documents)
select doc_id, md5(t) as prompt_md5, cast(length(t) as bigint) as n_chars from p""",
    "trap_merge": f"""with r as (select d.doc_id, cast(d.doc_id % 3 as bigint) as m0, c.label as c, {outputs.CONTEXT.replace("doc_id", "d.doc_id")} as context, {QUESTION.replace("doc_id", "d.doc_id")} as question, [{", ".join(o.replace("doc_id", "d.doc_id") for o in outputs.OPTION.values())}] as o
  from documents d left join (select doc_id, {_CANDIDATE} as label from labels) c on d.doc_id = c.doc_id),
u as (select *, {outputs._UNKNOWN_AT} as u from r), s as (select *, coalesce(c <> m0 and c = u and regexp_matches(context, '{ANONYMOUS_GROUP}') and regexp_matches(question, '{decisions.LIKELY}'), false) as swapped from u)
select doc_id, case when swapped then c else m0 end as label, swapped from s""",
    "repair_merge": f"""with s as (select doc_id, case when {draw(79, 4)} = 0 then 'invalid_json' else 'valid' end as status, cast(doc_id % 3 as bigint) as label from documents), a as (select doc_id, cast(quality as bigint) as label from labels where {draw(80, 5)} > 0)
select s.doc_id, case when status <> 'valid' and a.doc_id is not null then 'valid' else status end as status, case when status <> 'valid' and a.doc_id is not null then a.label else s.label end as label,
 case when status <> 'valid' and a.doc_id is not null then 'repair1' else 'run1' end as origin_run_id from s left join a on s.doc_id = a.doc_id""",
}
ORACLE = {k: to_duck(v) for k, v in ORACLE.items()}
