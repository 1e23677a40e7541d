"""Edge cases of single operators."""

import pytest
from pyspark.sql import functions as F
from sluicework.functions import text
from sluicework.operators import answers, decisions, metrics, parsing, sampling, triggers
from sluicework.operators.components import connected_components

GOOD = '{"label":"0","uncertainty_option_index":2,"evidence":"e","evidence_type":"elimination","uncertainty_signal":false,"protected_attribute_risk":false,"schema_version":"reasoner_output_v3"}'


BODIES = [
        (GOOD, "valid"),
        (GOOD.replace('"label":"0"', '"label":"0","label":"0"'), "invalid_json"),
        (GOOD.replace("2,", "NaN,", 1), "invalid_json"),
        (GOOD + " x", "invalid_json"),
        ("[1]", "invalid_schema"),
        (GOOD.replace('"evidence":"e",', ""), "invalid_schema"),
        (GOOD.replace('"label":"0"', '"label":0'), "invalid_label"),
        (GOOD.replace('"label":"0"', '"label":"3"'), "invalid_label"),
        (GOOD.replace('"evidence":"e"', '"evidence":" "'), "invalid_schema"),
        (GOOD.replace("elimination", "guess"), "invalid_schema"),
        (GOOD.replace("signal\":false", 'signal":"false"'), "invalid_schema"),
        (GOOD.replace("index\":2", 'index":2.0'), "invalid_schema"),
        (GOOD.replace("index\":2", 'index":true'), "invalid_schema"),
        (GOOD.replace("index\":2", 'index":3'), "invalid_schema"),
        (GOOD.replace("_v3", "_v2"), "invalid_schema"),
        (GOOD.replace("signal\":false", 'signal":true'), "invalid_schema"),
        (GOOD.replace('"label":"0"', '"label":"2"').replace("signal\":false", 'signal":true'), "invalid_schema"),
        (GOOD.replace("elimination", "insufficient_evidence"), "invalid_schema"),
        (GOOD.replace('"e"', '"\\ud800"'), "invalid_schema"),
        ("{}", "invalid_schema"),
        ("", "invalid_json"),
        ("[" * 200_000, "invalid_json"),
]


@pytest.fixture(scope="module")
def answers_parsed(spark):
    rows = [(i, parsing.MARKER + b) for i, (b, _) in enumerate(BODIES)]
    got = parsing.parse_outputs(spark.createDataFrame(rows, "id long, o string"), "id", "o", F.lit(True)).collect()
    assert all((r.parse_error is None) == (r.parse_status == "valid") and (r.parse_error or "sample ").startswith("sample ") for r in got)
    return {BODIES[r.id][0]: r.parse_status for r in got}


@pytest.mark.parametrize(("body", "status"), BODIES)
def test_strict_answer(answers_parsed, body, status):
    assert answers_parsed[body] == status


def test_parse_outputs_settles_lines(spark):
    rows = [(1, "x\n" + parsing.MARKER + GOOD + "\n\n", True), (2, " " + parsing.MARKER + GOOD, True), (3, parsing.MARKER + GOOD + "\nmore", True), (4, None, True), (5, parsing.MARKER + GOOD, False), (6, "", True), (7, parsing.MARKER + " " + GOOD, True)]
    out = parsing.parse_outputs(spark.createDataFrame(rows, "id long, o string, ok boolean"), "id", "o", F.col("ok"))
    assert {r.id: r.parse_status for r in out.collect()} == {1: "valid", 2: "missing_marker", 3: "missing_marker", 4: "source_failed", 5: "source_failed", 6: "missing_marker", 7: "valid"}


def test_answer_ladder(spark):
    options = ["Ann", "Bob", "Cannot be determined"]
    rows = [("Answer: **1", 1, "answer_pattern"), ("answer 0 then Answer-2", 2, "answer_pattern"), ("pick 1 or 0", 0, "digit_pattern"), ("it is BOB", 1, "option_text"), ("none", 2, "unknown_fallback"), ("answer\u00a0: 1, not 0", 1, "answer_pattern"), ("답은 answer\u3000- 2 이고 0", 2, "answer_pattern"), ("", 2, "unknown_fallback"), (None, 2, "unknown_fallback")]
    df = spark.createDataFrame([(r[0], options) for r in rows], "t string, o array<string>").select(answers.answer_ladder(F.col("t"), F.col("o")).alias("a"))
    assert [(r.a.label, r.a.method) for r in df.collect()] == [r[1:] for r in rows]


def test_unknown_index_prefers_the_shortest(spark):
    df = spark.createDataFrame([(["unknown here", "Unknown", "not sure"],), (["a", "b", "c"],), (["unknown", "unknown", "x"],)], "o array<string>")
    assert [r[0] for r in df.select(answers.unknown_index(F.col("o"))).collect()] == [1, -1, 0]


def test_grounding_and_negation(spark):
    rows = [("holding a book", True), ("no book", False), ("no badge or sign is visible", False), ("a phone; image does not show more", False), ("without a phone on the desk", True), ("nothing", False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string").select(triggers.grounded(text.normalised(F.col("t"))))
    assert [r[0] for r in df.collect()] == [r[1] for r in rows]


def test_majority_vote_ties(spark):
    rows = [([0, 1, 1, 0, 2], 0), ([2, 1, 1, 0, 0], 1), ([1], 1), ([], None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "v array<int>").select(decisions.majority_vote(F.col("v")))
    assert [r[0] for r in df.collect()] == [r[1] for r in rows]


def test_arbitration_truth_table(spark):
    """Every combination of the inputs takes the rung that the ladder names."""
    rows = [
        (label, status, after, defect, vs, rs)
        for label in (None, "0", "2")
        for status in (None, "skipped", "parse_failed", "verified")
        for after in ("0", "2")
        for defect in (True, False)
        for vs in ((False, True) if status == "verified" and defect and after == "0" else (False,))
        for rs in ((False, True) if label == "0" else (False,))
    ]

    def expected(label, status, after, defect, vs, rs):
        if status in (None, "skipped") or status != "verified":
            return label, "reasoner" if label else "error"
        if not defect:
            return label, "reasoner" if label else "error"
        if vs:
            return after, "reasoner" if label == after else "verifier"
        if after == "2" and not rs:
            return "2", "arbitration"
        return label, "reasoner" if label else "error"

    df = spark.createDataFrame(rows, "label string, status string, after string, defect boolean, vs boolean, rs boolean")
    got = df.select(decisions.arbitrate(*[F.col(c) for c in df.columns]).alias("a")).collect()
    assert [(r.a.label, r.a.stage) for r in got] == [expected(*r) for r in rows]


def test_nearest_rank_is_exact(spark):
    values = [(n, float(v)) for n in range(1, 60) for v in range(n)] + [(1, None)]
    got = metrics.nearest_rank(spark.createDataFrame(values, "g long, v double"), "g", "v", 0.95).collect()
    assert {r.g: r.value for r in got} == {n: float(-(-95 * n // 100) - 1) for n in range(1, 60)}


def test_empty_scores(spark):
    rows = spark.createDataFrame([], "hit int, amb boolean, s string")
    assert {r["name"]: r.value for r in metrics.balanced_accuracy(rows, "amb", "s").collect()} == {"accuracy": 0.0, "ambiguous": 0.0, "disambiguated": 0.0, "balanced_accuracy": 0.0}


def test_balanced_schedule(spark):
    rows = sampling.balanced_schedule(spark, 7).collect()
    assert len(rows) == 600 and sorted(r.place for r in rows) == list(range(1, 601))
    assert all((r.position == r.label) == (r.kind == "ambiguous") for r in rows)
    assert [tuple(r) for r in rows] == [tuple(r) for r in sampling.balanced_schedule(spark, 7).collect()]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (None, 4), (3, 1), *[(100 + i, 101 + i) for i in range(30)]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(31)}


def test_first_wins_keeps_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "A"), (4, "a"), (5, None)], "doc_id long, text string")
    got = sampling.first_wins(rows, F.sha2("text", 256), F.md5(F.lower("text")), "doc_id")
    assert got.columns == ["doc_id", "text", "reason"]
    want = {1: "accepted", 2: "accepted", 3: "near_duplicate", 4: "exact_duplicate", 5: "near_duplicate"}  # as first_value and = give in SQL
    assert sorted((r.doc_id, r.reason) for r in got.collect()) == sorted(want.items())


def test_null_status_is_no_valid_parse(spark):
    df = spark.createDataFrame([(None, "0"), ("valid", "0"), ("invalid_json", "0")], "s string, l string")
    none = F.array().cast("array<string>")
    got = [r[0] for r in df.select(triggers.triggers(F.col("s"), none, F.col("l"), F.lit(False), F.lit("elimination"), F.lit("stated fact"))).collect()]
    assert got == [["invalid_parse"], [], ["invalid_parse"]]


def test_verifier_outputs(spark):
    good = '{"label":"2","reason":"r","evidence_type":"insufficient_evidence","reasoner_defect_found":true,"objective_support":false}'
    rows = [(good, "valid"), (good.replace('"2"', '"1"'), "invalid_schema"), (good.replace('support":false', 'support":true'), "invalid_schema"), (good.replace('"r"', '"\\t"'), "invalid_schema"), (good.replace('"2"', "2"), "invalid_label"), (good[:-1], "invalid_json")]
    df = spark.createDataFrame([(i, f"x\n{parsing.VERIFIER_MARKER}{b}\n") for i, (b, _) in enumerate(rows)] + [(98, good), (99, None)], "id long, o string")
    got = {r.id: r for r in parsing.parse_verifications(df, "id", "o").collect()}
    assert [got[i].parse_status for i in range(len(rows))] == [s for _, s in rows] and got[98].parse_status == got[99].parse_status == "missing_marker"
    assert got[0].reasoner_defect_found is True and got[0].parse_error is None and got[1].label is None


def test_nearest_rank_of_ties(spark):
    values = [(1, float(v)) for v in [5] * 91 + [1] * 4 + [9] * 5] + [(2, 3.0)] * 1000
    got = metrics.nearest_rank(spark.createDataFrame(values, "g long, v double"), "g", "v", 0.95).collect()
    assert {r.g: r.value for r in got} == {1: 5.0, 2: 3.0}


def test_person_boxes_gather_fitting_groups_only(spark):
    from sluicework.operators import governance

    rows = [(g, i) for g, n in ((1, 1), (2, 2), (4, 4), (5, 5)) for i in range(n)] + [(None, 1), (None, 2)]
    kept, counters = governance.person_boxes(spark.createDataFrame(rows, "g long, i long"), (("one", F.col("i") == 9),), "g", ("i",))
    assert {r.g: len(r.boxes) for r in kept.collect()} == {2: 2, 4: 4, None: 2} and counters.count() == 1
