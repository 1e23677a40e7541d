"""Artifacts read again, on explicit records: sound, odd, null and repeated ones; round trips of what Spark writes."""

import json

from pyspark.sql import functions as F
from sluicework.jobs import rereads
from sluicework.operators import revalidation

SOUND = {
    "run_id": "r", "sample_id": "s1", "prompt_version": "v3", "triggers": ["low_confidence"], "requires_verification": True, "before_label": None, "raw_verifier_output": "out", "after_label": "1",
    "verifier_reason": "because", "verifier_evidence_type": "elimination", "reasoner_defect_found": True, "objective_support": True, "image_status": "loaded", "verifier_parse_status": "valid",
    "generation_metadata": {"b": [1, None], "a": 2}, "model_load_metadata": None, "elapsed_seconds": 2, "status": "verified", "error_type": None, "error_message": None,
}


def messages(faults):
    return [f.message for f in faults]


def test_verification_records(spark):
    cases = [
        (json.dumps(SOUND), []),
        (json.dumps(SOUND | {"sample_id": "s2", "before_label": 1, "elapsed_seconds": "2", "status": "x"}), ["before_label must be exactly 0, 1, or 2", "elapsed_seconds must be a number", "status is invalid"]),
        (json.dumps(SOUND | {"sample_id": "s3", "objective_support": None}), ["verifier support booleans are required"]),
        (json.dumps(SOUND | {"sample_id": "s4", "error_message": " x"}), ["error_message must be a non-empty string"]),
        (json.dumps(SOUND | {"run_id": "q"}), ["run_id does not match expected run_id", "duplicate sample_id: s1"]),
        (json.dumps(SOUND | {"sample_id": "s5", "triggers": ["low_confidence", 1]}), ["triggers must be a JSON string array"]),
        (json.dumps(SOUND | {"sample_id": "s6", "elapsed_seconds": True, "model_load_metadata": [1]}), ["model_load_metadata must be an object or null", "elapsed_seconds must be a number"]),
        (json.dumps(SOUND)[:-1] + ', "status": "verified"}', ["is malformed JSON: duplicate JSON key 'status'"]),
        (json.dumps(SOUND | {"elapsed_seconds": float("nan")}), ["is malformed JSON: unsupported JSON constant NaN"]),
        ("[1]", ["must be a JSON object"]),
        ("{}", ["fields must be exactly: " + ", ".join(revalidation.VERIFICATION_FIELDS)]),
        (None, ["blank"]),
        (" ", ["blank"]),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases, 1)], "ordinal long, line string").withColumns({c: F.lit(1) for c in ("status", "run", "sample", "record")})
    got = {r.ordinal: r for r in revalidation.read_verifications(df, "r").collect()}
    for k, (line, want) in enumerate(cases, 1):
        assert messages(got[k].faults) == want, line
    record = got[1].record.asDict()
    assert record.pop("generation_metadata") == '{"a":2,"b":[1,null]}' and record.pop("elapsed_seconds") == 2.0
    assert record == {k: v for k, v in SOUND.items() if k in record}
    assert (got[1].error, got[12].error, got[5].error) == (None, "verification artifact contains blank logical record 12", "verification row 5 run_id does not match expected run_id")
    assert revalidation.read_verifications(df.limit(0), "r").count() == 0


def test_parsed_answers(spark):
    good = dict(zip(revalidation.ANSWER_COLUMNS, ("r", "s1", "1", "2", "seen", "elimination", "false", "[]", "reasoner_output_v3", "valid", ""), strict=True))
    bad = dict.fromkeys(good, "") | {"run_id": "r", "sample_id": "s2", "risk_flags": '["invalid_parse"]', "parse_status": "invalid_json", "parse_error": "why"}
    cases = [
        (good, []),
        (bad, []),
        (bad | {"parse_error": None, "sample_id": "s3", "evidence_type": "guess"}, ["non-valid state requires parse_error", "invalid state must not carry valid fields"]),
        (good | {"sample_id": "s4", "risk_flags": '["protected_attribute_risk" ]'}, ["risk_flags must use deterministic JSON encoding"]),
        (good | {"sample_id": "s5", "parsed_label": "2"}, ["has inconsistent uncertainty", "has inconsistent evidence_type"]),
        (good | {"parse_error": "x"}, ["duplicate sample_id: s1", "valid state has parse_error"]),
        (good | {"sample_id": None, "risk_flags": None}, ["sample_id must be a non-empty string", "risk_flags is invalid JSON: Expecting value: line 1 column 1 (char 0)"]),
        (good | {"sample_id": "s8", "risk_flags": "{}"}, ["has invalid risk_flags"]),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases, 2)], "number long, row map<string,string>")
    got = {r.number: r for r in revalidation.reread_answers(df, "r").collect()}
    for k, (row, want) in enumerate(cases, 2):
        assert messages(got[k].faults) == want, row
    assert got[7].error == "parsed Reasoner artifact has duplicate sample_id: s1" and got[6].error == "parsed Reasoner row 6 has inconsistent uncertainty"
    assert revalidation.reread_answers(df.limit(0), "r").count() == 0


def test_queries_have_rows_of_many_kinds(spark, tiny):
    for query, least in ((rereads.reread_verifications, 18), (rereads.reread_answers, 15)):
        kinds = query(spark, tiny).select(F.regexp_replace("error", "[0-9]+", "").alias("e")).groupBy("e").count().collect()
        assert len(kinds) >= least and any(r.e is None and r["count"] > 10 for r in kinds)
