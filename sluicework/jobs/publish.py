"""Publication that never overwrites: stage, validate by reading again, rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.operators.integrity import ordered_mismatches
from sluicework.scratch import Scratch
from sluicework.sources.csv_scan import scan_csv, table_rows
from sluicework.sources.tables import with_ordinal


class PublishError(Exception):
    """The target exists, or what was staged does not hold."""


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def manifest(rows: DataFrame) -> dict:
    """Rows, columns and an order-free hash of all values."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    n, total = rows.agg(F.count("*"), F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)"))).first()
    return {"columns": sorted(rows.columns), "rows": n, "hash": str(total or 0)}


def publish(outputs: dict[str, DataFrame], path: str, valid: Callable[[dict[str, DataFrame]], bool] = lambda _: True) -> dict:
    """Write all ``outputs`` under ``path`` together, or nothing.

    They are written to a folder beside it, read again, checked (the same rows, and ``valid``), and the folder is renamed in
    one step, with a manifest. An existing target is an error; a failed run leaves no trace.
    """
    spark = next(iter(outputs.values())).sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise PublishError(f"{path} exists")
    staging = f"{path.rstrip('/')}.partial-{uuid.uuid4().hex}"
    _, staged = _fs(spark, staging)
    try:
        said = {}
        for name, df in outputs.items():
            said[name] = manifest(df)
            df.write.mode("errorifexists").parquet(f"{staging}/{name}")
        back = {name: spark.read.parquet(f"{staging}/{name}") for name in outputs}
        if any(manifest(back[n]) != said[n] for n in outputs) or not valid(back):
            raise PublishError(f"{path}: what was staged does not hold")
        spark.createDataFrame([(json.dumps(said, sort_keys=True, separators=(",", ":")),)], "value string").coalesce(1).write.text(f"{staging}/manifest")
        if fs.exists(target) or not fs.rename(staged, target):
            raise PublishError(f"{path} exists")
        return said
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)


def ordered_csv(rows: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """(place, line): the lines of one CSV file, the header first, in order of ``order``, which must tell rows apart. Values
    with commas, quotes or line ends are quoted; null is empty. Rows are sorted in ranges, so lines may be written side by side."""

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    ranged = rows.withColumn("line", F.concat_ws(",", *[cell(c) for c in columns])).select(order, "line").repartitionByRange(order).sortWithinPartitions(order)
    body = with_ordinal(ranged).select(F.col("ordinal").alias("place"), "line")
    head = rows.sparkSession.createDataFrame([(0, ",".join(columns))], "place long, line string")
    return head.unionByName(body)


def publish_csv(rows: DataFrame, order: str, columns: Sequence[str], path: str) -> dict[str, object]:
    """Write one CSV file at ``path``, which must not exist, and tell its rows, bytes and SHA-256.

    The file's lines are written in ranges and put behind each other by the store; the hash is that of the written bytes, read
    again part by part. Nothing passes through the driver but a buffer. A failed run leaves no file.
    """
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise PublishError(f"{path} exists")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staging = f"{path}.partial-{uuid.uuid4().hex}"
    _, staged = _fs(spark, staging)
    scratch = Scratch(spark, "csv")
    try:
        lines = scratch.table(ordered_csv(rows, order, columns), "lines")
        lines.repartitionByRange("place").sortWithinPartitions("place").select("line").write.text(scratch.path("parts"))
        parts = sorted(str(s.getPath().toString()) for s in fs.listStatus(_fs(spark, scratch.path("parts"))[1]) if s.getPath().getName().startswith("part-"))
        out = fs.create(staged)
        for part in parts:  # one for each range
            source = fs.open(_fs(spark, part)[1])
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
        out.close()
        said = {"rows": lines.count() - 1, **file_facts(spark, staging)}
        if fs.exists(target) or not fs.rename(staged, target):
            raise PublishError(f"{path} exists")
        return said
    finally:
        scratch.drop()
        if fs.exists(staged):
            fs.delete(staged, True)


def file_facts(spark: SparkSession, path: str) -> dict[str, object]:
    """Bytes and SHA-256 of a file as it lies there, read by the store's own stream."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        raise PublishError(f"{path} does not exist")
    stream = fs.open(target)
    try:
        digest = spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
    return {"bytes": fs.getFileStatus(target).getLen(), "sha256": digest}


def run_file_faults(spark: SparkSession, run: str, profile: dict[str, object], official: str | None, required: Sequence[str], same: tuple[str, str] | None = None) -> list[str]:
    """Everything wrong with the files of a finished run against a profile: required files that are missing (then only these);
    fields of summary.json that differ; ids empty or repeated, labels unknown, another order than ``official`` (a CSV path); two
    files that must be equal byte by byte, and their hash in the summary.

    Counts and orders are Spark's; what reaches the driver is one row each.
    """
    there = {n: _fs(spark, f"{run}/{n}") for n in required}
    missing = [n for n, (fs, at) in there.items() if not fs.exists(at)]
    if missing:
        return [f"missing run artifacts: {missing}"]
    summary = json.loads("\n".join(r["value"] for r in spark.read.text(f"{run}/summary.json").collect()))  # one small file of the run
    errors = [f"{k}: expected {v!r}, found {summary.get(k)!r}" for k, v in profile.items() if summary.get(k) != v]
    rows = table_rows(scan_csv(spark, f"{run}/predictions.csv")).select("number", F.coalesce(F.col("row")["sample_id"], F.lit("")).alias("id"), F.col("row")["label"].alias("label"))
    n, distinct, empty, odd = rows.agg(F.count("*"), F.count_distinct("id"), F.count_if(F.col("id") == ""), F.count_if(~F.coalesce(F.col("label").isin("0", "1", "2"), F.lit(False)))).first()
    wanted = profile.get("sample_count")
    if wanted is not None and n != wanted:
        errors.append(f"predictions rows: expected {wanted}, found {n}")
    if distinct != n or empty:
        errors.append("prediction sample IDs must be non-empty and unique")
    if odd:
        errors.append("prediction labels must be 0, 1, or 2")
    if official is not None:
        theirs = table_rows(scan_csv(spark, official)).select("number", F.coalesce(F.col("row")["sample_id"], F.lit("")).alias("id"))
        if not ordered_mismatches(theirs, rows.select("number", "id"), "number", "id").isEmpty():
            errors.append("prediction sample IDs/order differ from sample_submission.csv")
    if same is not None:
        one, two = (file_facts(spark, f"{run}/{x}") for x in same)
        if one != two:
            errors.append(f"{same[1]} differs from {same[0]}")
        if two["sha256"] != summary.get("predictions_sha256"):
            errors.append("submission checksum differs from summary predictions checksum")
    return errors


def remaining(batches: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Batches that an earlier run has not finished."""
    return batches.join(done.select(key).distinct(), key, "left_anti")
