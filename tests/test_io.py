"""Sources, publication and the stream."""

import json

import pytest
from pyspark.sql import functions as F
from sluicework.jobs import publish
from sluicework.sources import tables
from sluicework.streaming.arrivals import append_to, parsed_stream
from test_operators import GOOD


def test_csv_rows_have_ordinals(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('sample_id,context,extra\ns1,"two\nlines",x\ns2," ",y\ns3,"a ""b""",z\n')
    rows = tables.read_rows(spark, str(path), ["sample_id", "context"])
    assert [(r.ordinal, r.sample_id, r.context) for r in rows.orderBy("ordinal").collect()] == [(2, "s1", "two\nlines"), (3, "s2", " "), (4, "s3", 'a "b"')]
    assert [tuple(r) for r in tables.empty_fields(rows, ["sample_id", "context"]).collect()] == [(3, "context")]
    with pytest.raises(ValueError, match="missing"):
        tables.read_rows(spark, str(path), ["sample_id", "label"])
    with pytest.raises(ValueError, match="header"):
        tables.read_rows(spark, str(path), ["sample_id", "context"], exact=True)


def test_repeated_columns_are_an_error(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("a,b,b\n1,2,3\n")
    with pytest.raises(ValueError, match="repeated \\['b'\\]"):
        tables.read_rows(spark, str(path), ["a", "b"])


def test_places_within_groups(spark):
    rows = [(k % 3, k) for k in range(50)] + [(None, 1), (0, 0)]
    got = tables.in_order(spark.createDataFrame(rows, "g long, t long").repartition(5), "g", "t").collect()
    groups = {g: sorted(t for x, t in rows if x == g) for g in (None, 0, 1, 2)}
    assert sorted((str(r.g), r.place, r.t) for r in got) == sorted((str(g), k + 1, t) for g, x in groups.items() for k, t in enumerate(x))


def test_ordinals_follow_rows(spark):
    df = tables.with_ordinal(spark.range(1000).repartition(7).sortWithinPartitions("id"))
    assert sorted(r.ordinal for r in df.collect()) == list(range(1, 1001))


def test_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("b", 2, 7)], "k string, o int, v int")
    assert sorted(tuple(r) for r in tables.last_per_key(df, "k", "o").collect()) == [("a", 3, 6), ("b", 2, 7)]


def test_publish_is_all_or_nothing(spark, tmp_path):
    df, target = spark.range(5), str(tmp_path / "out")
    with pytest.raises(publish.PublishError):
        publish.publish({"a": df}, target, valid=lambda _: False)
    assert list(tmp_path.iterdir()) == []
    said = publish.publish({"a": df, "b": df.limit(0)}, target)
    assert said["a"]["rows"] == 5 and spark.read.parquet(f"{target}/a").count() == 5
    assert json.loads(spark.read.text(f"{target}/manifest").first()[0]) == said
    with pytest.raises(publish.PublishError, match="exists"):
        publish.publish({"a": df}, target)


def test_remaining(spark):
    assert [r.id for r in publish.remaining(spark.range(4), spark.range(3), "id").collect()] == [3]


def test_stream_parses_each_id_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "x\nFINAL_ANSWER_JSON:" + GOOD
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"sample_id": i, "raw_output": line if i else "none", "status": "generated", "ts": "2024-01-01T00:00:00Z"}) for i in range(k, 3)))
    query = append_to(parsed_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.sample_id, r.parse_status) for r in rows) == [(0, "missing_marker"), (1, "valid"), (2, "valid")]


def test_places_of_large_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(tables, "GROUP_ROWS", 20)
    rows = [(None if k % 3 == 0 else k % 40, k * 7 % 301, "x") for k in range(300)]
    df = spark.createDataFrame(rows, "g long, t long, first string").withColumns({c: F.lit("y") for c in ("row", "at", "part", "before", "of", "n", "group", "large")}).repartition(6)
    got = tables.in_order(df, "g", "t").collect()
    groups = {}
    for g, t, _ in rows:
        groups.setdefault(g, []).append(t)
    want = sorted((str(g), t, k + 1) for g, ts in groups.items() for k, t in enumerate(sorted(ts)))
    assert sorted((str(r.g), r.t, r.place) for r in got) == want and set(got[0].asDict()) == {*df.columns, "place"}
    assert tables.in_order(df.limit(0), "g", "t").count() == 0
