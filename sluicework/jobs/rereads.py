"""Queries on artifacts read again: verification records of whole texts, and parsed answers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.jobs import verification as made
from sluicework.jobs.inputs import draw, table, to_duck, to_spark
from sluicework.operators import revalidation

RUN = "run1"
#: Records as they are made elsewhere, but with whole texts as reasons.
VALUES = made.RECORD | {"verifier_reason": made.RECORD["verifier_reason"].replace("then lang", "then text")}
_BREAK = draw(301, 50)
#: JSON of each field over the columns of VALUES; some broken by the column ``broken``.
PIECES = {
    "run_id": f"case broken when 7 then '\"other\"' when 8 then '\" x\"' else '\"{RUN}\"' end",
    "sample_id": "case broken when 9 then '7' when 22 then concat('\"s', cast(doc_id - 1 as string), '\"') else concat('\"s', cast(doc_id as string), '\"') end",
    "prompt_version": "'\"v3\"'",
    "triggers": "case broken when 10 then '\"a\"' when 11 then '[\"low_confidence\", \"low_confidence\"]' when 12 then '[\"odd\"]' when 13 then '[\"protected_attribute_risk\", \"low_confidence\"]' when 23 then '[1]' else case when n_triggers > 0 then '[\"low_confidence\"]' else '[]' end end",
    "requires_verification": "case broken when 14 then '1' else cast(requires_verification as string) end",
    "before_label": "case broken when 15 then '2' else '\"2\"' end",
    **{k: f"coalesce(QUOTED({k}), 'null')" for k in ("raw_verifier_output", "after_label", "verifier_reason", "verifier_evidence_type")},
    **{k: f"coalesce(cast({k} as string), 'null')" for k in ("reasoner_defect_found", "objective_support")},
    **{k: f"coalesce(QUOTED({k}), 'null')" for k in ("image_status", "verifier_parse_status")},
    "generation_metadata": "case broken when 19 then '3' when 24 then '{\"a\": [1, null]}' else 'null' end",
    "model_load_metadata": "case broken when 20 then '[]' else 'null' end",
    "elapsed_seconds": "case broken when 3 then 'NaN' when 16 then '-1' when 17 then 'true' when 18 then '\"1\"' when 25 then '1e999' else '1.5' end",
    "status": "case broken when 21 then '\"done\"' else QUOTED(status) end",
    **{k: f"coalesce(QUOTED({k}), 'null')" for k in ("error_type", "error_message")},
}
_OBJECT = "concat('{', concat_ws(', ', " + ", ".join(f"case when broken = 5 and '{k}' = 'status' then null else '\"{k}\": ' || ({v}) end" for k, v in PIECES.items()) + "), case broken when 6 then ', \"more\": 1' when 2 then ', \"run_id\": \"x\"' else '' end, '}')"
LINE = f"case broken when 0 then ' ' when 1 then '[{{}}]' when 4 then '{{' else {_OBJECT} end"


def _spark(sql: str) -> str:
    return re.sub(r"QUOTED\((\w+)\)", r"substring(to_json(named_struct('a', \1)), 6, case when \1 is null then null else length(to_json(named_struct('a', \1))) - 6 end)", to_spark(sql))


def _duck(sql: str) -> str:
    return re.sub(r"QUOTED\((\w+)\)", r"cast(to_json(\1) as varchar)", to_duck(sql))


def reread_verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a line of the artifact; sound ones give back what was written."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(to_spark(_BREAK)).alias("broken"), *[F.expr(to_spark(e)).alias(c) for c, e in VALUES.items()])
    lines = rows.select(F.col("doc_id").alias("ordinal"), F.expr(_spark(LINE)).alias("line"))
    found = revalidation.read_verifications(lines, RUN)
    sound = F.col("error").isNull()
    return found.select(F.col("ordinal").alias("doc_id"), "error", F.when(sound, F.md5("record.verifier_reason")).alias("reason_md5"), F.when(sound, F.col("record.after_label")).alias("after_label"), F.when(sound, F.col("record.objective_support")).alias("objective_support"))


_STATE = draw(311, 3)
_SPOIL = draw(312, 30)
_LABEL, _INDEX = made.LABEL, f"cast({made.INDEX} as string)"
_SURE = f"{_LABEL} <> {_INDEX}"
#: Parsed answers by column: a third failed, the others valid; some spoiled.
ANSWERS = {
    "run_id": f"case {_SPOIL} when 0 then 'run2' when 1 then ' ' else '{RUN}' end",
    "sample_id": f"case {_SPOIL} when 2 then '' when 3 then concat('s', cast(doc_id - 1 as string)) else concat('s', cast(doc_id as string)) end",
    "parsed_label": f"case when {_STATE} = 0 then case {_SPOIL} when 4 then '1' else '' end when {_SPOIL} = 5 then '3' else {_LABEL} end",
    "uncertainty_option_index": f"case when {_STATE} = 0 then '' when {_SPOIL} = 6 then 'x' else {_INDEX} end",
    "evidence_summary": f"case when {_STATE} = 0 then '' when {_SPOIL} = 7 then ' ' else text end",
    "evidence_type": f"case when {_STATE} = 0 then '' when {_SPOIL} = 8 then 'guess' when ({_SURE}) = ({_SPOIL} <> 9) then 'elimination' else 'insufficient_evidence' end",
    "uncertainty_signal": f"case when {_STATE} = 0 then '' when {_SPOIL} = 10 then 'yes' when ({_SURE}) = ({_SPOIL} <> 11) then 'false' else 'true' end",
    "risk_flags": f"case {_SPOIL} when 12 then '[' when 13 then '{{}}' when 14 then '[\"odd\"]' when 15 then '[\"protected_attribute_risk\",\"protected_attribute_risk\"]' when 16 then '[ ]' when 17 then '[\"invalid_parse\", \"protected_attribute_risk\"]' when 18 then '[]' when 19 then '[\"invalid_parse\"]' else case when {_STATE} = 0 then '[\"invalid_parse\",\"protected_attribute_risk\"]' else '[\"protected_attribute_risk\"]' end end",
    "schema_version": f"case when {_STATE} = 0 then '' when {_SPOIL} = 20 then 'v2' else '{revalidation.VERSION}' end",
    "parse_status": f"case when {_SPOIL} = 21 then 'odd' when {_STATE} = 0 then 'invalid_json' else 'valid' end",
    "parse_error": f"case when ({_STATE} = 0) = ({_SPOIL} <> 22) then source else '' end",
}


def reread_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a parsed answer artifact, with whole texts as evidence."""
    cells = F.create_map(*[x for k, e in ANSWERS.items() for x in (F.lit(k), F.expr(to_spark(e)))])
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), cells.alias("row"))
    found = revalidation.reread_answers(rows, RUN)
    return found.select(F.col("number").alias("doc_id"), "error", F.array_join(F.transform("faults", lambda f: f["code"]), ",").alias("codes"))


QUERIES = (reread_verifications, reread_answers)
_BLANKS = "[ \\t\\n\\r\\v\\f]"


def _untrimmed(x: str) -> str:
    return f"({x} is not null and ({x} = '' or regexp_matches({x}, '^{_BLANKS}|{_BLANKS}$')))"


_FIELDS = {
    10: "triggers must be a JSON string array", 23: "triggers must be a JSON string array", 11: "triggers contains duplicate", 12: "triggers contains unsupported values", 13: "triggers must use deterministic ordering",
    14: "requires_verification must be a boolean", 15: "before_label must be exactly 0, 1, or 2",
}
_LATE = {
    19: "generation_metadata must be an object or null", 20: "model_load_metadata must be an object or null", 16: "elapsed_seconds must be non-negative", 25: "elapsed_seconds must be non-negative",
    17: "elapsed_seconds must be a number", 18: "elapsed_seconds must be a number", 21: "status is invalid",
}
_ANSWER_RULES = [
    ("run_id", "run_id must be a non-empty string", "trim(run_id) = ''"),
    ("sample_id", "sample_id must be a non-empty string", "sample_id = ''"),
    ("run", f"run_id ''' || run_id || ''' does not match expected run_id ''{RUN}''", f"trim(run_id) <> '' and run_id <> '{RUN}'"),
    ("duplicate", "duplicate sample_id: ' || sample_id || '", "number > first"),
    ("status", "has invalid parse_status", "parse_status = 'odd'"),
    ("flags", "risk_flags is invalid JSON: Expecting value: line 1 column 2 (char 1)", "spoil = 12"),
    ("flags", "has invalid risk_flags", "spoil in (13, 14)"),
    ("flags", "has duplicate risk_flags", "spoil = 15"),
    ("flags", "risk_flags must use deterministic JSON encoding", "spoil in (16, 17)"),
    ("unflagged", "non-valid state requires invalid_parse", "spoil not in (12, 13) and parse_status <> 'valid' and not contains(risk_flags, 'invalid_parse')"),
    ("flagged", "valid state must not carry invalid_parse", "parse_status = 'valid' and contains(risk_flags, 'invalid_parse')"),
    ("no_error", "non-valid state requires parse_error", "failed and trim(coalesce(parse_error, '')) = ''"),
    ("carried", "invalid state must not carry valid fields", "failed and parsed_label || coalesce(evidence_summary, '') || evidence_type || uncertainty_signal || uncertainty_option_index || schema_version <> ''"),
    ("parsed_label", "has invalid parsed_label", "not failed and parsed_label not in ('0', '1', '2')"),
    ("evidence_summary", "has invalid evidence_summary", f"not failed and not regexp_matches(coalesce(evidence_summary, ''), '[^{_BLANKS[1:]}')"),
    ("evidence_type", "has invalid evidence_type", "not failed and evidence_type not in ('elimination', 'insufficient_evidence')"),
    ("uncertainty_signal", "has invalid uncertainty_signal", "not failed and uncertainty_signal not in ('true', 'false')"),
    ("uncertainty_option_index", "has invalid uncertainty_option_index", "not failed and uncertainty_option_index not in ('0', '1', '2')"),
    ("schema_version", "has invalid schema_version", f"not failed and schema_version <> '{revalidation.VERSION}'"),
    ("uncertainty", "has inconsistent uncertainty", "not failed and parsed_label in ('0', '1', '2') and uncertainty_option_index in ('0', '1', '2') and uncertainty_signal in ('true', 'false') and (uncertainty_signal = 'true') <> (parsed_label = uncertainty_option_index)"),
    ("evidence", "has inconsistent evidence_type", "not failed and parsed_label in ('0', '1', '2') and uncertainty_option_index in ('0', '1', '2') and evidence_type in ('elimination', 'insufficient_evidence') and (evidence_type = 'insufficient_evidence') <> (parsed_label = uncertainty_option_index)"),
    ("has_error", "valid state has parse_error", "not failed and coalesce(parse_error, '') <> ''"),
]
_CONTRACT = made.ORACLE["verification_contract"].split(" from documents), k as")[1]
ORACLE = {
    "reread_verifications": _duck(f"""with c as (select doc_id, {_BREAK} as broken, {", ".join(f"{e} as {c}" for c, e in VALUES.items())} from documents), k as{_CONTRACT.replace(")" + chr(10) + "select doc_id, case", ")," + chr(10) + "w as (select *, case")}),
s as (select *, case when broken in (0, 1, 2, 3, 4, 5, 6, 9) then null when broken = 22 then doc_id - 1 else doc_id end as sample from w),
f as (select *, min(case when sample is not null then doc_id end) over (partition by sample) as first from s),
e as (select *, case broken when 0 then 'verification artifact contains blank logical record ' || doc_id
  else 'verification row ' || doc_id || ' ' || case when broken = 1 then 'must be a JSON object' when broken = 2 then 'is malformed JSON: duplicate JSON key ''run_id''' when broken = 3 then 'is malformed JSON: unsupported JSON constant NaN'
   when broken = 4 then 'is malformed JSON: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)' when broken in (5, 6) then 'fields must be exactly: {", ".join(revalidation.VERIFICATION_FIELDS)}'
   when broken = 8 then 'run_id must be a non-empty string' when broken = 9 then 'sample_id must be a non-empty string' {" ".join(f"when broken = {k} then '{v}'" for k, v in _FIELDS.items())}
   when {_untrimmed("raw_verifier_output")} then 'raw_verifier_output must be a non-empty string' when {_untrimmed("verifier_reason")} then 'verifier_reason must be a non-empty string'
   when image_status = 'blurred' then 'image_status is invalid' when verifier_parse_status = 'odd' then 'verifier_parse_status is invalid' {" ".join(f"when broken = {k} then '{v}'" for k, v in _LATE.items())}
   when violation is not null then violation when broken = 7 then 'run_id does not match expected run_id' end end as error from f),
g as (select *, coalesce(error, case when doc_id > first then 'verification artifact has duplicate sample_id: s' || sample end) as told from e)
select doc_id, told as error, case when told is null then md5(verifier_reason) end as reason_md5, case when told is null then after_label end as after_label, case when told is null then objective_support end as objective_support from g"""),
    "reread_answers": to_duck(f"""with c as (select doc_id as number, {_SPOIL} as spoil, {", ".join(f"{e} as {c}" for c, e in ANSWERS.items())} from documents),
k as (select *, parse_status <> 'valid' or contains(risk_flags, '"invalid_parse"') as failed, min(case when sample_id <> '' then number end) over (partition by sample_id) as first from c),
f as (select *, list_filter([{", ".join(f"case when {test} then struct_pack(code := '{code}', message := '{message}') end" for code, message, test in _ANSWER_RULES)}], lambda x: x is not null) as faults from k)
select number as doc_id, case when len(faults) = 0 then null when faults[1].code in ('run_id', 'sample_id') then faults[1].message when faults[1].code = 'duplicate' then 'parsed Reasoner artifact has ' || faults[1].message else 'parsed Reasoner row ' || number || ' ' || faults[1].message end as error,
 array_to_string(list_transform(faults, lambda x: x.code), ',') as codes from f"""),
}
