"""Queries on answers and verifications: strict parses with their errors, outcomes, and the contract of records.

The tables hold no model outputs. Outputs are built from each document: its whole text is the evidence or the reason, and every
part of the body varies by draws from its id, malformed ones included. The SQL works from the same draws, without JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.jobs.inputs import draw, table, to_duck, to_spark
from sluicework.operators import parsing, verification

TYPES = parsing.EVIDENCE_TYPES
LABEL = f"cast({draw(2, 3)} as string)"
TYPE = f"case {draw(5, 4)} when 0 then '{TYPES[0]}' when 1 then '{TYPES[1]}' when 2 then '{TYPES[2]}' else '{TYPES[3]}' end"
FIRST, SECOND = f"({draw(7, 2)} = 0)", f"({draw(9, 2)} = 0)"
#: JSON of the parts; those that a draw spoils come first.
LABEL_JSON = f"""case {draw(1, 20)} when 0 then '3' when 1 then '"x"' when 2 then 'null' else concat('"', {LABEL}, '"') end"""
_OBJECT = "to_json(named_struct('t', coalesce(text, '')))"
TEXT_JSON = f"""case {draw(3, 12)} when 0 then '"  "' when 1 then '7' else substring({_OBJECT}, 6, length({_OBJECT}) - 6) end"""
TYPE_JSON = f"""case {draw(4, 16)} when 0 then '"guess"' when 1 then 'true' else concat('"', {TYPE}, '"') end"""
FIRST_JSON = f"""case when {draw(6, 10)} = 0 then '"true"' when {FIRST} then 'true' else 'false' end"""
SECOND_JSON = f"case when {draw(8, 10)} = 0 then '1' when {SECOND} then 'true' else 'false' end"
SHAPE = draw(10, 15)
VERIFIER, ANSWER = parsing.VERIFIER_KEYS, ("label", "evidence", *parsing.KEYS_V2[2:])
INDEX = draw(11, 3)
INDEX_JSON = f"case {draw(12, 14)} when 0 then '3' when 1 then '2.0' when 2 then 'true' else cast({INDEX} as string) end"
VERSION_JSON = f"""case {draw(13, 14)} when 0 then '"reasoner_output_v2"' else '"{parsing.VERSION}"' end"""
ANSWER_REST = f"""', "uncertainty_option_index": ', {INDEX_JSON}, ', "schema_version": ', {VERSION_JSON}"""


def _output(marker: str, keys: tuple[str, ...], rest: str = "''") -> str:
    """A model's output: thoughts, then the marked line, then blank lines."""
    a, b, c, d, e = keys
    parts = f"""'"{c}": ', {TYPE_JSON}, ', "{d}": ', {FIRST_JSON}, ', "{e}": ', {SECOND_JSON}, {rest}"""
    head = f"""'{{"{a}": ', {LABEL_JSON}"""
    full = f"""{head}, ', "{b}": ', {TEXT_JSON}, ', ', {parts}"""
    body = f"""case {SHAPE} when 0 then concat({head}, ', ', {parts}, '}}') when 1 then concat({full}, ', "zz": 1, "aa": 2}}') when 2 then concat({full}, ', "{a}": "0"}}')
 when 3 then concat({full}, '}} x') when 4 then '[1, 2]' when 5 then concat({full}, ', "n": NaN}}') else concat({full}, '}}') end"""
    return f"concat('Thinking about {{}}.', chr(10), case {SHAPE} when 6 then ' {marker}' else '{marker}' end, {body}, case {SHAPE} when 7 then concat(chr(10), 'Done.') else concat(chr(10), ' ', chr(13), chr(10)) end)"


def _plain_error():
    """Errors without the place that the JSON decoder adds."""
    return F.regexp_replace("parse_error", r": line \d+ column \d+ \(char \d+\)$", "").alias("parse_error")


def _verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(to_spark(_output(parsing.VERIFIER_MARKER, VERIFIER))).alias("output"))
    return parsing.parse_verifications(docs, "doc_id", "output")


def verifier_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verifications(spark, sf_dir).select("doc_id", "parse_status", "label", F.md5("reason").alias("reason_md5"), "evidence_type", "reasoner_defect_found", "objective_support", _plain_error())


def answer_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = F.expr(to_spark(_output(parsing.MARKER, ANSWER, ANSWER_REST)))
    status = F.expr(to_spark(f"case {draw(14, 12)} when 0 then 'inference_failed' when 1 then 'image_failed' else 'generated' end"))
    failure = parsing.source_failure(status, F.expr(to_spark(f"case when {draw(15, 3)} > 0 then ' ImageLoadError' end")), F.expr(to_spark(f"case when {draw(16, 2)} = 0 then concat('no ', source, ' ') else ' ' end")))
    docs = table(spark, sf_dir, "documents").select("doc_id", output.alias("output"), status.alias("status"), failure.alias("failure"))
    found = parsing.parse_outputs(docs, "doc_id", "output", F.col("status") == "generated", failure=F.col("failure"))
    return found.select("doc_id", "parse_status", "label", F.md5("evidence").alias("evidence_md5"), "evidence_type", "uncertainty_signal", "protected_attribute_risk", "option_index", _plain_error())


REQUIRED, IMAGE = f"{draw(17, 4)} > 0", f"case {draw(18, 12)} when 0 then 'missing' when 1 then 'corrupt' when 2 then null else 'loaded' end"
PROMPT, INFERENCE = f"case when {draw(19, 11)} = 0 then 'no template' end", f"case when {draw(20, 9)} = 0 then 'out of memory' end"


def verification_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's second pass, with the triggers that follow from it."""
    inputs = {"required": REQUIRED, "image": IMAGE, "prompt": PROMPT, "inference": INFERENCE}
    docs = table(spark, sf_dir, "documents").select("doc_id", *[F.expr(to_spark(e)).alias(c) for c, e in inputs.items()])
    done = verification.outcome(F.col("required"), F.col("image"), F.concat(F.lit("image is "), "image"), F.col("prompt"), F.col("inference"), F.col("parse_status"), _plain_error())
    rows = docs.join(_verifications(spark, sf_dir), "doc_id").withColumn("o", done)
    verified = F.col("o.status") == "verified"
    found = F.expr(to_spark(f"case {draw(21, 3)} when 0 then array('protected_attribute_risk', 'low_confidence') when 1 then array('low_confidence') else array('appearance_only_reasoning') end"))
    kept = F.when(F.col("required"), found).otherwise(F.array().cast("array<string>"))
    conflict = verified & (F.expr(to_spark(f"cast({draw(22, 3)} as string)")) != F.col("label"))
    return rows.select("doc_id", "o.status", "o.error_type", "o.error_message", F.when(verified, F.col("label")).alias("after_label"), F.array_join(verification.ordered_triggers(kept, conflict), ",").alias("triggers"))


KIND = draw(23, 5)
#: Records of the second pass, some with a fault by draws.
RECORD = {
    "status": f"case {KIND} when 0 then 'skipped_not_triggered' when 1 then 'image_failed' when 2 then 'parse_failed' else 'verified' end",
    "requires_verification": f"({KIND} > 0) = ({draw(24, 9)} > 0)",
    "n_triggers": f"case when {KIND} = 0 and {draw(25, 5)} > 0 then 0 else {draw(26, 3)} end",
    "raw_verifier_output": f"case when {KIND} < 2 then case when {draw(27, 9)} = 0 then 'x' end when {draw(27, 9)} = 0 then '' else source end",
    "after_label": f"case when {KIND} < 3 then case when {draw(28, 9)} = 0 then '1' end when {draw(28, 12)} > 0 then {LABEL} end",
    "verifier_reason": f"case when {KIND} < 3 then case when {draw(29, 9)} = 0 then 'r' end when {draw(29, 12)} > 0 then lang end",
    "verifier_evidence_type": f"case when {KIND} < 3 then null when {draw(30, 14)} > 0 then {TYPE} end",
    "reasoner_defect_found": f"case when {KIND} < 3 then null when {draw(31, 14)} > 0 then {FIRST} end",
    "objective_support": f"case when {KIND} < 3 then null when {draw(32, 14)} > 0 then {SECOND} end",
    "image_status": f"case when {KIND} = 0 then null when {draw(33, 12)} = 0 then 'blurred' when {KIND} = 1 then 'missing' else 'loaded' end",
    "verifier_parse_status": f"case when {KIND} < 2 then null when {draw(34, 12)} = 0 then 'odd' when {KIND} = 2 then 'invalid_json' else 'valid' end",
    "error_type": f"case when {KIND} in (1, 2) and {draw(35, 8)} > 0 then 'ParseError' when {draw(35, 16)} = 1 then 'X' end",
    "error_message": f"case when {KIND} in (1, 2) then 'm' end",
}


def verification_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", *[F.expr(to_spark(e)).alias(c) for c, e in RECORD.items()])
    rows = rows.withColumn("triggers", F.array_repeat(F.lit("low_confidence"), F.col("n_triggers").cast("int")))
    return rows.select("doc_id", verification.contract_violation().alias("violation"))


QUERIES = (verifier_outputs, answer_outputs, verification_outcomes, verification_contract)

_PARTS = {
    "shape": SHAPE, "lab": LABEL, "bad_lab": f"{draw(1, 20)} < 3", "d3": draw(3, 12), "bad_type": f"{draw(4, 16)} < 2", "etype": TYPE, "bad_first": f"{draw(6, 10)} = 0", "first_": FIRST,
    "bad_second": f"{draw(8, 10)} = 0", "second_": SECOND, "idx": f"cast({INDEX} as string)", "bad_idx": f"{draw(12, 14)} < 3", "bad_version": f"{draw(13, 14)} = 0",
}
_DRAWS = "select *, coalesce(text, '') as t, " + ", ".join(f"{e} as {n}" for n, e in _PARTS.items()) + " from documents"
_TYPE_TEXT = f"evidence_type must be one of: {', '.join(TYPES)}"


def _ladder(no_object: str, marker: str, what: str, keys: tuple[str, ...], label_text: str, text_text: str, rest: list[tuple[str, str]]) -> str:
    """The first fault as status|error, null if there is none."""
    steps = [
        ("shape in (6, 7)", f"missing_marker|final non-empty line must start with {marker}"),
        ("shape = 2", f"invalid_json|{what}duplicate key: ''{keys[0]}''"),
        ("shape = 3", f"invalid_json|{what}Extra data"),
        ("shape = 5", f"invalid_json|{what}non-standard JSON constant: NaN"),
        ("shape = 4", f"invalid_schema|{no_object}"),
        ("shape = 0", f"invalid_schema|missing fields: {keys[1]}"),
        ("shape = 1", "invalid_schema|extra fields: aa, zz"),
        ("bad_lab", f"invalid_label|{label_text}"),
        ("d3 < 2 or not regexp_matches(t, '\\S')", f"invalid_schema|{text_text}"),
        ("bad_type", f"invalid_schema|{_TYPE_TEXT}"),
        ("bad_first", f"invalid_schema|{keys[3]} must be a JSON boolean"),
        ("bad_second", f"invalid_schema|{keys[4]} must be a JSON boolean"),
        *[(test, f"invalid_schema|{text}") for test, text in rest],
    ]
    return "case " + " ".join(f"when {test} then '{text}'" for test, text in steps) + " end"


_VERIFIER_LADDER = _ladder(
    "Verifier answer must be an object", parsing.VERIFIER_MARKER, "Verifier JSON is invalid: ", VERIFIER, "label must be exactly 0, 1, or 2", "reason must be a non-empty string",
    [("lab = '2' and (etype <> 'insufficient_evidence' or second_)", "label 2 requires insufficient evidence without objective support"),
     ("lab <> '2' and (etype = 'insufficient_evidence' or not second_)", "person labels require decisive evidence and objective support")],
)
_ANSWER_LADDER = _ladder(
    "final answer must be a JSON object", parsing.MARKER, "final answer JSON is invalid: ", ANSWER, "label must be exactly one of: 0, 1, 2", "evidence must be a non-empty string",
    [("bad_idx", "uncertainty_option_index must be a JSON integer from 0 through 2"), ("bad_version", "schema_version must be exactly reasoner_output_v3"),
     ("first_ <> (lab = idx)", "uncertainty_signal must equal label == uncertainty_option_index"), ("lab = idx and etype <> 'insufficient_evidence'", "uncertainty selection requires insufficient_evidence"),
     ("lab <> idx and etype = 'insufficient_evidence'", "decisive selection requires decisive evidence")],
)
_VERIFIED = f"""d as ({_DRAWS}), f as (select *, {_VERIFIER_LADDER} as fault from d),
p as (select *, coalesce(split_part(fault, '|', 1), 'valid') as parse_status, substr(fault, strpos(fault, '|') + 1) as parse_error, fault is null as ok from f)"""
_SOURCE = f"case {draw(14, 12)} when 0 then 'inference_failed' when 1 then 'image_failed' end"
_SAID = f"concat_ws(': ', 'raw Reasoner status is ' || source_status, case when {draw(15, 3)} > 0 then 'ImageLoadError' end, case when {draw(16, 2)} = 0 then 'no ' || source end)"
_ANY = "coalesce({}) is not null"
_VERDICT = "verifier_reason, verifier_evidence_type, cast(reasoner_defect_found as string), cast(objective_support as string)"
ORACLE = {
    "verifier_outputs": f"""with {_VERIFIED} select doc_id, parse_status, case when ok then lab end as label, case when ok then md5(t) end as reason_md5, case when ok then etype end as evidence_type,
 case when ok then first_ end as reasoner_defect_found, case when ok then second_ end as objective_support, parse_error from p""",
    "answer_outputs": f"""with d as ({_DRAWS}), f as (select *, {_SOURCE} as source_status, {_ANSWER_LADDER} as fault from d),
p as (select *, case when source_status is not null then 'source_failed' else coalesce(split_part(fault, '|', 1), 'valid') end as parse_status, source_status is null and fault is null as ok from f)
select doc_id, parse_status, case when ok then lab end as label, case when ok then md5(t) end as evidence_md5, case when ok then etype end as evidence_type, case when ok then first_ end as uncertainty_signal,
 case when ok then second_ end as protected_attribute_risk, case when ok then cast(idx as int) end as option_index,
 case when source_status is not null then 'sample ' || doc_id || ' ' || {_SAID} when fault is not null then 'sample ' || doc_id || ' ' || case when parse_status = 'invalid_schema' then 'final answer schema is invalid: ' else '' end || substr(fault, strpos(fault, '|') + 1) end as parse_error from p""",
    "verification_outcomes": f"""with {_VERIFIED}, o as (select *, {REQUIRED} as required, {IMAGE} as image, {PROMPT} as prompt, {INFERENCE} as inference from p),
s as (select *, case when not required then 'skipped_not_triggered' when image is null or image <> 'loaded' then 'image_failed' when prompt is not null then 'prompt_failed' when inference is not null then 'inference_failed' when not ok then 'parse_failed' else 'verified' end as status from o)
select doc_id, status, case status when 'image_failed' then 'ImageLoadError' when 'prompt_failed' then 'ConfigurationError' when 'inference_failed' then 'InferenceError' when 'parse_failed' then 'ParseError' end as error_type,
 case status when 'image_failed' then 'image is ' || image when 'prompt_failed' then prompt when 'inference_failed' then inference when 'parse_failed' then parse_error end as error_message, case when status = 'verified' then lab end as after_label,
 concat_ws(',', case when required then case {draw(21, 3)} when 0 then 'low_confidence,protected_attribute_risk' when 1 then 'low_confidence' else 'appearance_only_reasoning' end end, case when status = 'verified' and cast({draw(22, 3)} as string) <> lab then 'reasoner_verifier_conflict' end) as triggers from s""",
    "verification_contract": f"""with c as (select doc_id, {", ".join(f"{e} as {c}" for c, e in RECORD.items())} from documents), k as (select *, status = 'skipped_not_triggered' as sk, status = 'verified' as ve from c)
select doc_id, case when sk and requires_verification then 'requires_verification is invalid for skipped row' when sk and n_triggers > 0 then 'triggers must be empty'
 when sk and {_ANY.format(f"raw_verifier_output, after_label, {_VERDICT}, image_status, verifier_parse_status, error_type, error_message")} then 'skipped fields must be null'
 when sk then null when not requires_verification then 'requires_verification must be true'
 when ve and coalesce(raw_verifier_output, '') = '' then 'raw_verifier_output must be non-empty' when ve and after_label is null then 'after_label is required' when ve and verifier_reason is null then 'verifier_reason is required'
 when ve and verifier_evidence_type is null then 'verifier_evidence_type is required' when ve and (reasoner_defect_found is null or objective_support is null) then 'verifier support booleans are required'
 when ve and image_status <> 'loaded' then 'image_status is invalid' when ve and verifier_parse_status <> 'valid' then 'verifier_parse_status is invalid' when ve and (error_type is not null or error_message is not null) then 'verified rows must not include errors'
 when ve and after_label in ('0', '1') and (not objective_support or verifier_evidence_type = 'insufficient_evidence') then 'person after_label requires objective support'
 when ve and after_label = '2' and (objective_support or verifier_evidence_type <> 'insufficient_evidence') then 'label 2 requires insufficient evidence' when ve then null
 when after_label is not null then 'after_label must be null' when {_ANY.format(_VERDICT)} then 'failed verifier fields must be null'
 when image_status not in ('loaded', 'missing', 'unreadable', 'corrupt') then 'image_status is invalid' when verifier_parse_status not in ('valid', 'missing_marker', 'invalid_json', 'invalid_schema', 'invalid_label') then 'verifier_parse_status is invalid'
 when error_type is null or error_message is null then 'error_type and error_message are required' end as violation from k""",
}
ORACLE = {k: to_duck(v) for k, v in ORACLE.items()}
