"""CSV records with their defects against Python's csv reader."""

import csv
import io
import random
import re

from pyspark.sql import functions as F
from sluicework.sources import csv_scan


def put(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


def by_file(rows):
    out = {}
    for r in rows:
        out.setdefault(r.file.rsplit("/", 1)[1].removesuffix(".csv"), {})[r.number] = r
    return out


def test_records_are_those_of_the_csv_module(spark, tmp_path):
    rng = random.Random(4)
    pieces = ["a", "b c", '"x"', '"x\ny"', '"say ""hi"""', "", "ü", '"a,b"', '"\n\n"', 'in"side', '""']
    texts = {f"f{k}": "".join(",".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) * (rng.random() < 0.9) + rng.choice(["\n", "\r\n"]) for _ in range(30)) for k in range(12)}
    got = by_file(csv_scan.scan_csv(spark, put(tmp_path, **texts)).collect())
    for name, text in texts.items():
        want = list(csv.reader(io.StringIO(text, newline="")))
        assert [got[name][k].fields for k in range(1, len(want) + 1)] == want
        assert len(got[name]) == len(want) and not any(r.broken for r in got[name].values())


def test_a_file_is_scanned_block_by_block(spark, tmp_path):
    """Records, numbers and quotes are the same however a file falls into blocks, and no step gathers a whole file's lines."""
    rng = random.Random(7)
    text = "a,b\n" + "".join(rng.choice(['1,"x\ny"\n', '2,"\n\n""\n"\n', "3,4\n", "\n", '5,"a"b\n', '6,"' + "z\n" * 30 + '"\n']) for _ in range(150)) + '7,"open\n8\n'
    files = put(tmp_path, one=text, two='x"y\n' * 20)
    whole = sorted(tuple(r) for r in csv_scan.scan_csv(spark, files).collect())
    try:
        for size in ("16", "100", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            scan = csv_scan.scan_csv(spark, files)
            assert sorted(tuple(r) for r in scan.collect()) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(whole) > 150 and "hashpartitioning(file#" in (plan := scan._jdf.queryExecution().toString())
    assert re.search(r"hashpartitioning\(file#\d+L?, block#", plan)


def test_defects_are_kept_and_told(spark, tmp_path):
    files = put(tmp_path, bad='a,b\n1,2\n\n1\n1,2,3\n"x"y,2\n3,"4\n5\n', empty="", head="a,b\n", other="b,a\n1,2\n", bytes=b"a,b\n\xff,2\n")
    scan = csv_scan.scan_csv(spark, files)
    found = csv_scan.record_faults(scan, ("a", "b")).unionByName(csv_scan.header_faults(scan, ("a", "b"))).collect()
    told = sorted((r.file.rsplit("/", 1)[1], r.number, r.message) for r in found)
    assert told == [
        ("bad.csv", 3, "artifact contains blank row 3"),
        ("bad.csv", 4, "row 4 has 1 fields; expected 2"),
        ("bad.csv", 5, "row 5 has 3 fields; expected 2"),
        ("bad.csv", 6, "row 6 is malformed CSV"),
        ("bad.csv", 7, "row 7 is malformed CSV"),
        ("bytes.csv", 2, "row 2 is not valid UTF-8"),
        ("head.csv", 1, "artifact has no data rows"),
        ("other.csv", 1, "headers must be exactly: a, b"),
    ]


def test_everything_wrong_with_a_layout_file(spark, tmp_path):
    path = put(tmp_path, t='id,text,label,text\ns1,x,0\n\n s1 ,,7,y\n,z,,q,more\ns2,"a\nb",2,w\n')
    found = csv_scan.layout_faults(csv_scan.scan_csv(spark, path), "t.csv", ("id", "text", "label"), ("id", "label"), "id", ("0", "1", "2")).collect()
    assert [r.message for r in sorted(found, key=lambda r: (r.number, r.part))] == [
        "t.csv has duplicate columns: text",
        "t.csv row 3 has duplicate id: s1",
        "t.csv row 3 has invalid label: '7'",
        "t.csv row 4 has extra unnamed fields",
        "t.csv row 4 has empty required field: id",
        "t.csv row 4 has empty required field: label",
    ]
    path = put(tmp_path, t="id,x\n1,2\n")
    assert [r.message for r in csv_scan.layout_faults(csv_scan.scan_csv(spark, path), "t.csv", ("id", "label"), ("id",), "id").collect()] == ["t.csv missing required columns: label"]
    path = put(tmp_path, t="id,label\n")
    assert [r.message for r in csv_scan.layout_faults(csv_scan.scan_csv(spark, path), "t.csv", ("id", "label"), ("id",), "id").collect()] == ["t.csv has no data rows"]


def test_rows_as_maps(spark, tmp_path):
    path = put(tmp_path, t="a,b,a\n1,2,3\n\n4\n")
    rows = csv_scan.table_rows(csv_scan.scan_csv(spark, path)).orderBy("number").select("number", F.col("row"), "extra").collect()
    assert [(r.number, r.row, r.extra) for r in rows] == [(2, {"a": "3", "b": "2"}, False), (3, {}, False)]
