"""Permissive numbers against Python's, gates, runs that stop at a count, and one ordered file with its hash."""

import csv
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F
from sluicework.functions import numbers
from sluicework.jobs import publish
from sluicework.operators import eligibility, sampling

TEXTS = [
    "1", " 1\t", " 1 ", "+1", "-0", "1_0", "1__0", "_1", "1_", "1.", ".5", ".", "1.5e3", "1e1_0", "1e", "e5", "nan", "-NaN", "inf", "Infinity", "infinit", "1e400", "1e-400", "0x1", "1.5f", "1d", "", " ",
    "٣", "１２.５", "1 0", "--1", "+-1", "1,5", "007", "-007", "1.0", "9" * 400, "true", "1_0.0_1e+0_1", "0_0", "\n2\n", "²",
]


def python(read, text):
    try:
        return read(text)
    except ValueError:
        return None


def test_numbers_are_those_of_python(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").select("t", numbers.permissive_float(F.col("t")).alias("f"), numbers.permissive_integer(F.col("t")).alias("i")).collect()
    for r in rows:
        f, i = (None, None) if r.t is None else (python(float, r.t), python(int, r.t))
        assert r.i == (None if i is None else str(i)), repr(r.t)
        assert (f is None) == (r.f is None) and (f is None or f == r.f or math.isnan(f) and math.isnan(r.f)), repr(r.t)
    many = spark.createDataFrame([("9" * 4301,)], "t string").select(numbers.permissive_integer(F.col("t")).alias("i")).first()
    assert many.i is None


def test_boxes_have_three_kinds_of_outcome(spark):
    cases = [
        (("0", "0", "0", "1", "0", "1"), "eligible"), (("1", "x", "x", None, "", ""), "group"), (("2", "0", "0", "1", "0", "1"), "malformed"), ((" 0_0 ", "1", "x", "", "", ""), "depiction"),
        (("0", None, "0", "1", "0", "1"), "malformed"), (("0", "0", "nan", "1", "0", "1"), "geometry"), (("0", "0", "0", "1", "0", "inf"), "geometry"), (("0", "0", "0.5", "0.5", "0", "1"), "geometry"),
        (("0", "0", "0", "0.1", "0", "0.05"), "small"), (("0", "0", "0", "1", "0", "1,0"), "malformed"),
    ]
    df = spark.createDataFrame([c[0] for c in cases], "g string, d string, a string, b string, c string, e string")
    out = numbers.box_outcome(F.col("g"), F.col("d"), tuple(F.col(x) for x in "abce"))
    assert [r.o for r in df.select(out.alias("o")).collect()] == [c[1] for c in cases]


def test_dates_are_canonical_days(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-2-9", "0000-01-01", "0001-01-01", "2024-13-01", " 2024-01-01", "2024-01-01x", "9999-12-31", "", None]
    got = [r.d and str(r.d) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(eligibility.iso_date(F.col("t")).alias("d")).collect()]
    assert got == ["2024-02-29", None, None, None, "0001-01-01", None, None, None, "9999-12-31", None, None]


def test_gates_come_in_three_steps(spark):
    good = {
        "commit": "a" * 40, "release_date": "2026-05-31", "remote_api_usage": "none", "snapshot_sha256": "0" * 64, "custom_code_hashes": {}, "preprocessing_metadata": {"a": "b"}, "adapter": "own",
        "local_files_only": True, "snapshot_hash": "0" * 64, "revision": None, "trust_remote_code": False, "gpu_name": " rtx   a6000", "total_vram_mib": 48000, "peak_vram_mib": 0,
    }
    cases = [
        ({}, []),
        ({"commit": "A" * 40, "release_date": "x", "adapter": "dummy"}, ["commit_unpinned"]),
        ({"release_date": "2026-06-01"}, ["cutoff_ineligible"]),
        ({"release_date": None}, ["manifest_invalid"]),
        ({"custom_code_hashes": {"a": None}}, ["custom_code_hash_invalid"]),
        ({"preprocessing_metadata": None}, ["serialization_evidence_missing"]),
        ({"adapter": "dummy", "local_files_only": None, "snapshot_hash": None, "revision": "b", "trust_remote_code": True, "gpu_name": None}, ["adapter_ineligible", "remote_api_forbidden", "snapshot_hash_mismatch", "commit_mismatch", "custom_code_evidence_missing"]),
        ({"gpu_name": "RTX A6000 Ada", "total_vram_mib": None, "peak_vram_mib": -1}, ["gpu_not_a6000", "vram_insufficient", "peak_vram_missing"]),
    ]
    schema = "commit string, release_date string, remote_api_usage string, snapshot_sha256 string, custom_code_hashes map<string,string>, preprocessing_metadata map<string,string>, adapter string, local_files_only boolean, snapshot_hash string, revision string, trust_remote_code boolean, gpu_name string, total_vram_mib int, peak_vram_mib int"
    df = spark.createDataFrame([good | change for change, _ in cases], schema)
    assert [[x.code for x in r.r] for r in df.select(eligibility.rejections().alias("r")).collect()] == [want for _, want in cases]


def test_a_run_stops_where_enough_are_accepted(spark):
    rows = [(k, None if k % 7 == 3 else f"d{k % 23}", f"n{k % 11}" if k % 5 else None, "lost" if k % 6 == 1 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "at int, digest string, near string, failed string").repartition(7)
    seen, accepted, want = {}, 0, []
    for at, digest, near, failed in rows:
        if failed is None and near not in seen:
            seen[near] = digest
            accepted += 1
            want.append((at, "accepted"))
        else:
            want.append((at, failed or ("exact_duplicate" if digest is not None and digest == seen[near] else "near_duplicate")))
        if accepted == 9:
            break
    got = sampling.accept_until(df, F.col("failed"), F.col("digest"), F.col("near"), "at", 9).orderBy("at").collect()
    assert [(r.at, r.reason) for r in got] == want
    with pytest.raises(ValueError, match="fewer than 500"):
        sampling.accept_until(df, F.col("failed"), F.col("digest"), F.col("near"), "at", 500)
    with pytest.raises(ValueError, match="fewer than 1"):
        sampling.accept_until(df.limit(0), F.col("failed"), F.col("digest"), F.col("near"), "at", 1)


def test_one_ordered_file_and_the_faults_of_a_run(spark, tmp_path):
    rows = [(k, f"s{k}", str(k % 3), 'a "b", \n c' if k % 4 == 0 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "at int, sample_id string, label string, note string").repartition(6)
    run = str(tmp_path / "run")
    said = publish.publish_csv(df, "at", ("sample_id", "label", "note"), f"{run}/predictions.csv")
    data = (tmp_path / "run" / "predictions.csv").read_bytes()
    assert said == {"rows": 200, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    with open(tmp_path / "run" / "predictions.csv", newline="") as f:
        assert list(csv.reader(f)) == [["sample_id", "label", "note"], *[[s, x, n or ""] for _, s, x, n in rows]]
    with pytest.raises(publish.PublishError, match="exists"):
        publish.publish_csv(df, "at", ("sample_id",), f"{run}/predictions.csv")
    names = ("predictions.csv", "summary.json", "submission.csv")
    assert publish.run_file_faults(spark, run, {}, None, names) == ["missing run artifacts: ['summary.json', 'submission.csv']"]
    (tmp_path / "run" / "submission.csv").write_bytes(data)
    (tmp_path / "run" / "summary.json").write_text(json.dumps({"sample_count": 200, "model": "m", "predictions_sha256": said["sha256"]}))
    official = tmp_path / "official.csv"
    official.write_text("sample_id,label\n" + "".join(f"s{k},\n" for k in range(200)))
    assert publish.run_file_faults(spark, run, {"sample_count": 200, "model": "m"}, str(official), names, names[::2]) == []
    official.write_text("sample_id,label\ns1,\ns0,\n")
    (tmp_path / "run" / "submission.csv").write_bytes(data + b"s0,7,\n")
    (tmp_path / "run" / ".predictions.csv.crc").unlink()  # the store's own sum of the file that is replaced here
    (tmp_path / "run" / "predictions.csv").write_bytes(data + b"s0,7,\n,1,\n")
    assert publish.run_file_faults(spark, run, {"sample_count": 201, "model": "x"}, str(official), names, names[::2]) == [
        "sample_count: expected 201, found 200",
        "model: expected 'x', found 'm'",
        "predictions rows: expected 201, found 202",
        "prediction sample IDs must be non-empty and unique",
        "prediction labels must be 0, 1, or 2",
        "prediction sample IDs/order differ from sample_submission.csv",
        "submission.csv differs from predictions.csv",
        "submission checksum differs from summary predictions checksum",
    ]
    empty = publish.publish_csv(df.limit(0), "at", ("sample_id", "label"), f"{run}/empty.csv")
    assert empty["rows"] == 0 and (tmp_path / "run" / "empty.csv").read_text() == "sample_id,label\n"
