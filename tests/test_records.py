"""Records, answer lists, typed JSON, rules and paths on explicit cases, against plain Python where there is one."""

import hashlib
import json
import posixpath

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sluicework.functions import paths
from sluicework.functions.batches import pieces
from sluicework.operators import records, rules, typed
from sluicework.operators.images import image_format

GOOD = {
    "sample_id": "s1", "image_ref": "a/x.png", "context": "c", "question": "q", "answers": ["a", "b", "c"], "expected_label": 1, "uncertainty_option_index": 2, "expected_is_uncertainty": False,
    "subsets": ["ambiguous"], "provenance_type": "public", "source_uri_or_note": "mine", "license_or_permission": "CC0", "author_id": "a1", "review_status": "reviewed", "reviewer_id": "b1", "split": "selection",
}
GIF, PNG = b"GIF89a..", b"\x89PNG\r\n\x1a\n...."
FILES = [("/root/a/x.png", GIF), ("/root/empty.png", b""), ("/root/bad.png", b"nothing known"), ("/root/p.png", PNG)]
CASES = [
    ({}, []),
    ({"image_ref": "./a//b/../x.png", "image_sha256": hashlib.sha256(GIF).hexdigest()}, []),
    ({"image_ref": "p.png", "image_sha256": None, "randomization_seed": 7}, []),
    ({"sample_id": " ", "question": None, "context": 3}, ["sample_id must be a non-empty string", "context must be a non-empty string", "question must be a non-empty string"]),
    ({"answers": ["a", "", "c"]}, ["answers must contain exactly three non-empty strings"]),
    ({"answers": {"a": 1}, "extra": 1, "also": 2}, ["unknown fields: also, extra", "answers must contain exactly three non-empty strings"]),
    ({"expected_label": True, "uncertainty_option_index": 1.0}, ["expected_label and uncertainty_option_index must be 0, 1, or 2"]),
    ({"expected_is_uncertainty": True}, ["expected_is_uncertainty is inconsistent with label/index"]),
    ({"expected_is_uncertainty": 0}, ["expected_is_uncertainty is inconsistent with label/index"]),
    ({"subsets": ["ambiguous", "ambiguous"]}, ["subsets must be a non-empty unique list of supported values"]),
    ({"subsets": [["ambiguous"]]}, ["subsets must be a non-empty unique list of supported values"]),
    ({"provenance_type": ["public"]}, ["unsupported provenance_type"]),
    ({"source_uri_or_note": "from the LEADERBOARD"}, ["evaluation/test-derived provenance is forbidden"]),
    ({"reviewer_id": " "}, ["invalid review status or reviewer_id"]),
    ({"reviewer_id": None}, ["reviewed records require an independent reviewer"]),
    ({"reviewer_id": "a1", "provenance_type": "synthetic"}, ["reviewed records require an independent reviewer", "generated authors cannot self-review"]),
    ({"reviewer_id": None, "review_status": "pending"}, []),
    ({"split": 3}, ["split must be selection or sealed_holdout"]),
    ({"image_ref": "../x.png"}, ["image_ref escapes image root"]),
    ({"image_ref": "/etc/passwd", "split": ""}, ["split must be selection or sealed_holdout", "image_ref escapes image root"]),
    ({"image_ref": "b.png"}, ["image does not exist: b.png"]),
    ({"image_ref": "empty.png"}, ["image is empty"]),
    ({"image_ref": "bad.png"}, ["image cannot be decoded"]),
    ({"image_sha256": "00"}, ["image_sha256 does not match image bytes"]),
    ({"randomization_seed": 1.5}, ["randomization_seed must be an integer or null"]),
]


@pytest.fixture(scope="module")
def images(spark):
    content = F.col("content")
    df = spark.createDataFrame(FILES, "path string, content binary")
    return df.select("path", image_format(content).alias("format"), F.octet_length(content).alias("bytes"), F.sha2(content, 256).alias("sha256"))


def test_every_fault_of_a_line(spark, images):
    lines = [json.dumps(GOOD | change) for change, _ in CASES]
    want = [messages for _, messages in CASES]
    without = {k: v for k, v in GOOD.items() if k not in ("split", "author_id")}
    for line, messages in [
        (json.dumps(without | {"x": 1}), ["missing fields: author_id, split", "unknown fields: x"]),
        (None, ["blank lines are not allowed"]),
        (" \t", ["blank lines are not allowed"]),
        ("[]", ["record must be an object"]),
        ("null", ["record must be an object"]),
        ("{", ["Expecting property name enclosed in double quotes: line 1 column 2 (char 1)"]),
        (json.dumps(GOOD)[:-1] + ', "split": "x", "split": "selection"}', []),
    ]:
        lines.append(line)
        want.append(messages)
    lines += lines[:4]  # repeated lines are judged each
    want += want[:4]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "ordinal long, line string").withColumns({c: F.lit("x") for c in ("path", "bytes", "error", "fields", "at")})
    got = {r.ordinal: r for r in records.record_faults(df, images, "/root").collect()}
    assert len(got) == len(lines)
    for k, messages in enumerate(want, 1):
        assert [f.message for f in got[k].faults] == messages, lines[k - 1]
        assert got[k].error == ("; ".join(f"line {k}: {m}" for m in messages) or None)
    assert records.record_faults(df.limit(0), images, "/root").count() == 0


def test_batches_come_in_pieces_of_bounded_size():
    texts = ["a" * n for n in (3, 0, 9, 40, 1, 1)] + [None, "é" * 4, None]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x, pa.string())], names=["id", "t"]) for x in (texts, [], texts[:1])]
    got = [piece.column(1).to_pylist() for piece in pieces(batches, 10)]
    assert [t for piece in got for t in piece] == texts + texts[:1]
    assert all(len(piece) == 1 or sum(len((t or "").encode()) for t in piece) <= 10 for piece in got) and len(got) == 5


def test_forbidden_provenance_needs_both_fields(spark, images):
    """A marker in one of two fields is no fault where the other is missing: that breaks the first rule only."""
    marked = GOOD | {"source_uri_or_note": "from the LEADERBOARD"}
    lines = [{k: v for k, v in marked.items() if k != "image_ref"}, {k: v for k, v in GOOD.items() if k != "source_uri_or_note"} | {"image_ref": "test.csv"}, marked]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(lines)], "ordinal long, line string")
    got = {r.ordinal: [f.code for f in r.faults] for r in records.record_faults(df, images, "/root").collect()}
    assert got == {0: ["missing"], 1: ["missing", "image_missing"], 2: ["forbidden"]}


def test_answer_lists(spark):
    cases = [
        ('["a ", "\\u00a0b", "c"]', ["a", "b", "c"], None),
        ("[]", None, "must contain exactly 3 answers, found 0"),
        ("{}", None, "answers must be a JSON list"),
        ("3", None, "answers must be a JSON list"),
        ("", None, "has malformed answers JSON: Expecting value"),
        (None, None, "has malformed answers JSON: Expecting value"),
        ('["a", 1, ""]', None, "answer 2 must be a string"),
        ('["a", " ", 1]', None, "answer 2 is empty"),
        ('["a", "b", null]', None, "answer 3 must be a string"),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)] * 2, "id long, raw string")
    got = records.answer_lists(df, "id", "raw").collect()
    assert len(got) == 2 * len(cases)
    assert all((r.answers, r.error) == cases[r.id][1:] for r in got)


def test_typed_json_kinds(spark):
    texts = ['{"a": [1, "x", null, {"k": []}, " ", 1.0, true], "b": {"z": 1, "y": 2}, "c": NaN, "c": 5}', '{"a": 1, "a": 2}', "7", None, "{\"a\": \"\\ud800\"}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    loose = {r.id: r for r in typed.typed_json(df, "id", F.col("t")).collect()}
    assert [i.kind for i in loose[0].fields["a"]["items"]] == ["integer", "string", "null", "object", "blank", "number", "boolean"]
    assert (loose[0].fields["b"].text, loose[0].fields["c"].text, loose[1].fields["a"].text, loose[2].root.kind) == ('{"y":2,"z":1}', "5", "2", "integer")
    assert loose[3].root is None and loose[3].error is None and loose[4].fields["a"].kind == "broken"
    strict = {r.id: r for r in typed.typed_json(df, "id", F.col("t"), strict=True).collect()}
    assert strict[0].error and strict[1].error == "duplicate key: 'a'" and strict[2].root is None and strict[2].error is None


def test_rules_accumulate_or_stop(spark):
    df = spark.createDataFrame([(1,), (2,), (6,), (None,)], "n int")
    listed = [("even", "is even", F.col("n") % 2 == 0), ("three", F.concat(F.lit("holds three: "), "n"), F.col("n") % 3 == 0)]
    got = {r.n: (r.a, r.b) for r in df.select("n", rules.joined(rules.all_faults(listed), "x ").alias("a"), rules.joined(rules.all_faults(rules.ladder(listed))).alias("b")).collect()}
    assert got == {1: (None, None), 2: ("x is even", "is even"), 6: ("x is even; x holds three: 6", "is even"), None: (None, None)}


def test_paths_are_those_of_posix(spark):
    values = ["a/b", "./a//b/", "../x", "a/../../b", "/etc/../x", "/", "", ".", "..", "a/./../b/c/../..", "/../..", "a/...", None]
    df = spark.createDataFrame([(v,) for v in values], "p string")
    for r in df.select("p", paths.resolve("/data/root", F.col("p")).alias("r")).collect():
        assert r.r == posixpath.normpath(posixpath.join("/data/root", r.p or "")), r
    rows = spark.createDataFrame([("images/x", True), ("x", True), ("train/images/x", False), ("../train/images/x", True), ("/a", True), (" ", True), ("train/x", True)], "p string, known boolean")
    at = paths.image_path("/d", "train", "train/images", F.col("p"))
    fault = rules.joined(rules.all_faults(rules.ladder(paths.path_rules("/d", "train/images", F.col("p"), at, F.col("known")))))
    assert [(r.at, r.f) for r in rows.select(at.alias("at"), fault.alias("f")).collect()] == [
        ("/d/train/images/x", None),
        ("/d/train/x", "image_path is not under train/images: x"),
        ("/d/train/images/x", "image_path does not exist: train/images/x"),
        ("/d/train/images/x", "has escaping image_path: ../train/images/x"),
        ("/a", "has absolute image_path: /a"),
        ("/d/train", None),
        ("/d/train/train/x", "image_path is not under train/images: train/x"),
    ]
