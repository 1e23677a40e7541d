"""Replies in JSON, templates, review reports, contracts of predictions and repairs, on odd rows."""

import pytest
from pyspark.sql import functions as F
from sluicework.functions import prompts
from sluicework.operators import decisions, json_answers, metrics, reviews

MARK = "FINAL_ANSWER_JSON:"
CASES = [
    (None, (None, "empty", "empty response")),
    ("", (None, "empty", "empty response")),
    (" \n ", (None, "parse_failed", "missing FINAL_ANSWER_JSON")),
    ("it is 1, or 2. 30", (2, "digit_fallback", "missing FINAL_ANSWER_JSON")),
    (f'x\n{MARK}{{"label": "0", "uncertainty_option_index": 2}} \n\n', (0, "final_json", None)),
    (f'{MARK} {{"label": 2, "uncertainty_option_index": 2.0, "uncertainty_signal": [0]}}', (2, "final_json", None)),
    (f'{MARK} {{"label": 2, "uncertainty_option_index": true, "uncertainty_signal": 0}}', (2, "final_json_contract_warning", "uncertainty_option_index True != expected 2; uncertainty_signal mismatch")),
    (f'{MARK} {{"label": "1", "uncertainty_option_index": "2", "uncertainty_signal": null}}', (1, "final_json_contract_warning", "uncertainty_option_index '2' != expected 2")),
    (f'{MARK} {{"label": 1.0}}', (None, "invalid_label", "invalid label: 1.0")),
    (f"{MARK} {{}}", (None, "invalid_label", "invalid label: None")),
    (f'{MARK} {{"label": 1,}} 0', (0, "digit_fallback", "missing FINAL_ANSWER_JSON")),
    (f'{MARK} {{"label": NaN, "label": 1}}', (1, "final_json_contract_warning", "uncertainty_option_index None != expected 2")),
    (f'{MARK} {{"label": 1\n{MARK} {{"label" 1}}', (None, "json_decode_error", "Expecting ':' delimiter: line 1 column 10 (char 9)")),
]


def test_final_answers(spark):
    df = spark.createDataFrame([(k, c[0], ["a", "b", "Unknown"]) for k, c in enumerate(CASES)] * 2, "id int, reply string, options array<string>").withColumns({c: F.lit(1) for c in ("at", "error", "fields")})
    got = json_answers.final_answers(df, "id", "reply", "options").collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert (r.label, r.method, r.error) == CASES[r.id][1], CASES[r.id][0]
    assert json_answers.final_answers(df.limit(0), "id", "reply", "options").count() == 0


def test_templates_have_exactly_their_placeholders(spark):
    df = spark.createDataFrame([("{b}", None)], "a string, b string")
    assert df.select(prompts.render("{{x}} {a}{b}{a}", {"a": F.col("a"), "b": F.col("b")}).alias("t")).first().t == "{x} {b}null{b}"
    assert df.select(prompts.render("", {}).alias("t")).first().t == ""
    for template, names, said in (("{a}", "ab", "lacks placeholders: b"), ("{a}{c}", "a", "unknown placeholders: c"), ("{a:>3}", "a", "unsupported"), ("{a!r}", "a", "unsupported"), ("{}", "", "unsupported"), ("{a.b}", "a", "unsupported"), ("{a", "a", "invalid braces")):
        with pytest.raises(ValueError, match=said):
            prompts.render(template, {n: F.col(n) for n in names})


def test_review_report_of_odd_rounds(spark):
    docs = spark.createDataFrame([(k,) for k in range(6)], "id int")
    said = spark.createDataFrame([(0, "reviewed"), (1, "rejected"), (2, "adjudication_required"), (3, "adjudication_required"), (4, "adjudication_required"), (99, "reviewed")], "id int, decision string")
    last = spark.createDataFrame([(2, "accept"), (3, "reject")], "id int, decision string")
    coverage = spark.createDataFrame([(2, "b"), (1, "a"), (3, "a")], "ord int, message string")
    r = reviews.review_report(docs, said, last, "id", 6, coverage).first()
    assert (r.decisions, r.adjudications, r.reviewed, r.adjudicated, r.rejected, r.disputes, r.missing_decisions, r.retained, r.unresolved) == (5, 2, 1, 1, 2, 3, 1, 2, 2)
    assert r.violations == ["all 6 input records require a terminal review decision", "1 disputes require adjudication", "a", "b"] and not r.promotion_ready
    empty = reviews.review_report(docs.limit(0), said.limit(0), last.limit(0), "id", 0, coverage.limit(0)).first()
    assert empty.promotion_ready and empty.violations == [] and empty.unresolved == 0


def test_contracts_of_predictions_and_repairs(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("b", 3, None), ("c", None, float("nan")), ("d", 2, -0.1)], "id string, label int, seconds double")
    told = sorted(tuple(r) for r in metrics.prediction_faults(rows, "id", "label", "seconds").collect())
    assert [(i, m.split(": ")[1].split()[0]) for i, m in told] == [("b", "elapsed_seconds"), ("b", "predicted_label"), ("c", "elapsed_seconds"), ("c", "predicted_label"), ("d", "elapsed_seconds")]
    errors = spark.createDataFrame([(["x", "x"], False), (["x", "y"], None), (None, False), (["y"], True)], "s array<string>, hit boolean")
    assert {tuple(r) for r in metrics.subset_errors(errors, "s", "hit", ("x", "y", "z")).collect()} == {("x", 2), ("y", 1), ("z", 0)}
    run = spark.createDataFrame([("a", "valid"), ("b", "invalid_json"), ("c", "valid")], "id string, status string")
    fix = spark.createDataFrame([("b", "valid")], "id string, status string")
    assert decisions.only_invalid(run, fix, "id", "status", "b") == []
    assert decisions.only_invalid(run.withColumn("status", F.lit(None).cast("string")), fix.limit(0), "id", "status", "b") == ["expected only b invalid; got ['a', 'b'] and perhaps more", "repair run must contain one valid parsed row"]
