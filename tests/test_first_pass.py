"""States of the first pass, inputs of the second, captions, sequences, names and times, on odd rows."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from sluicework.functions import names
from sluicework.operators import first_pass
from sluicework.operators.rules import all_faults


def test_states_follow_each_other(spark):
    rows = [("loaded", None, b"x", None, "p", None, "out"), ("loaded", None, b"", "bad", None, "late", None), ("loaded", None, b"x", None, "p", "oom", "half"), ("missing", "", None, "bad", None, None, None), (None, None, None, None, None, None, None), ("corrupt", "why", b"y", None, "p", None, "o")]
    df = spark.createDataFrame(rows, "s string, e string, i binary, pe string, p string, ie string, o string")
    got = [r.r for r in df.select(first_pass.first_pass(*[F.col(c) for c in ("s", "e", "i", "pe", "p", "ie", "o")]).alias("r")).collect()]
    assert [(r.status, r.error_type, r.error_message, r.raw_output) for r in got] == [
        ("generated", None, None, "out"), ("prompt_failed", "ConfigurationError", "bad", None), ("inference_failed", "InferenceError", "oom", None),
        ("image_failed", "ImageLoadError", "image load failed with status: missing", None), ("image_failed", "ImageLoadError", "image load failed with status: None", None), ("image_failed", "ImageLoadError", "why", None),
    ]
    assert [(r.prompt_sha256 is None, r.image_bytes) for r in got] == [(False, 1), (True, 0), (False, 1), (True, None), (True, None), (True, 1)]


def test_inputs_of_the_second_pass(spark):
    good = {"run_id": "r", "sample_id": "s", "schema_version": None, "uncertainty_option_index": None, "risk_flags": [], "parse_status": "valid", "parsed_label": "1", "evidence_summary": "e", "evidence_type": "elimination", "uncertainty_signal": False}
    cases = [
        ({}, []), ({"parse_status": "invalid_json", "parsed_label": None, "evidence_summary": None, "evidence_type": None, "uncertainty_signal": None}, []), ({"schema_version": "reasoner_output_v3", "run_id": None}, ["lineage", "identity"]),
        ({"risk_flags": None}, ["flags"]), ({"risk_flags": ["invalid_parse", None]}, ["flags"]), ({"parsed_label": "3", "evidence_summary": " \t", "evidence_type": None, "uncertainty_signal": None}, ["label", "evidence", "type", "signal"]),
    ]
    schema = "run_id string, sample_id string, schema_version string, uncertainty_option_index int, risk_flags array<string>, parse_status string, parsed_label string, evidence_summary string, evidence_type string, uncertainty_signal boolean"
    df = spark.createDataFrame([good | change for change, _ in cases], schema)
    assert [[f.code for f in r.f] for r in df.select(all_faults(first_pass.trigger_input_rules()).alias("f")).collect()] == [want for _, want in cases]


def test_captions_first_wins_among_eligible_ones(spark):
    rows = [
        (1, "A PERSON here", "on", "a", 7), (2, "a person here", "on", "a", 1), (3, "a person", "on", "a", 0), (4, "a person", "on", "a", 9), (5, "person.", "on", "b", 1), (6, None, "on", "b", 1), (7, "person", "near", "b", 1),
        (8, "person", None, "b", 1), (9, "person", "under", None, 1), (10, "the person\nsat", "facing", "b", None), (11, "x person", "in", "b", 1),
    ]
    df = spark.createDataFrame(rows, "o int, caption string, relation string, image string, label int").withColumns({c: F.lit(1) for c in ("first", "of", "person", "seen")}).repartition(4)
    got = [r.reason for r in first_pass.relation_captions(df, "o", "caption", "relation", "image", "label").orderBy("o").collect()]
    assert got == ["malformed", "eligible", "duplicate", "duplicate", "no_person", "no_person", "relation", "relation", "duplicate", "malformed", "eligible"]
    assert first_pass.relation_captions(df.limit(0), "o", "caption", "relation", "image", "label").count() == 0


def test_sequences_of_one_length(spark):
    one = spark.range(50).withColumn("place", F.lit("x")).repartition(5)
    two = spark.range(50).select((F.lit(100) - F.col("id")).alias("id")).repartition(3)
    got = first_pass.zipped([(one, "id"), (two, "id")]).orderBy("place").collect()
    assert [(r.place, r.p0.id, r.p1.id) for r in got] == [(k + 1, k, 51 + k) for k in range(50)]
    with pytest.raises(ValueError, match="lengths"):
        first_pass.zipped([(one, "id"), (two.limit(3), "id")])
    assert first_pass.zipped([(one.limit(0), "id"), (two.limit(0), "id")]).count() == 0


def test_names_and_times(spark):
    values = [" A-b  C ", "__x__", "-_ ", "", None, "é", "a/b", "A___-b", "9", "x\ty"]

    def name(v):
        plain = re.sub("_+", "_", (v or "").strip().lower().replace("-", "_").replace(" ", "_")).strip("_")
        return plain if re.fullmatch("[a-z0-9_]+", plain) else None

    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", names.run_name(F.col("v")).alias("n")).collect()
    assert all(r.n == name(r.v) for r in got)
    logs = ["try again at 1:05 PM.", "Try again at 12:00 AM", "try again at 3:00 pm\ntry again at 9:5 am..", "try again at 13:00 PM", "try again at 1:60 PM", "try again at", "", None, "x try again at 01:00   pm \nmore", "try again at 0:10 AM"]
    now = datetime(2026, 2, 28, 13, 5, 30)

    def again(log):
        at = (log or "").lower().rfind("try again at ")
        if at < 0:
            return None
        try:
            time = datetime.strptime(((log[at + 13 :].splitlines() or [""])[0]).strip().rstrip("."), "%I:%M %p")
        except ValueError:
            return None
        found = now.replace(hour=time.hour, minute=time.minute, second=30)
        return found if found > now else found + timedelta(days=1)

    got = spark.createDataFrame([(v,) for v in logs], "v string").select("v", names.retry_at(F.col("v"), F.lit(str(now)).cast("timestamp")).cast("string").alias("t")).collect()
    assert all(r.t == (None if again(r.v) is None else str(again(r.v))) for r in got)
