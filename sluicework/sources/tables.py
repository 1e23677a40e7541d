"""Strict scans of CSV and JSONL files: typed rows, explicit ordinals, violations as data."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluicework.scratch import cut


#: Rows of a group that one task may number.
GROUP_ROWS = 1_000_000


def with_ordinal(df: DataFrame, first: int = 1) -> DataFrame:
    """``df`` with ``ordinal``: the place of each row in the order of its files and of the rows within them. A column of that name is
    replaced; no other name can clash.

    Rows are numbered within their partition and written with their numbers, so that the input is evaluated once, whatever
    order it might have the next time; partitions are then offset by the counts before them, one for each.
    """
    kept = [c for c in df.columns if c != "ordinal"]
    marked = cut(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.monotonically_increasing_id().alias("at"))).withColumn("part", F.shiftrightunsigned("at", 33))
    counts = marked.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + first
    return marked.join(F.broadcast(offsets), "part").select("row.*", place.alias("ordinal"))


def in_order(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``place``: the place of each row within its group, from 1; a null group is one.

    Groups are counted first. Those of up to ``GROUP_ROWS`` rows are numbered within one task each; the rows of larger ones
    are dealt in ranges of group and order, so that a group of very many rows is spread over tasks.
    """
    small = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")
    large = df.groupBy(F.col(group).alias("large")).agg(F.count("*").alias("rows")).filter(F.col("rows") > GROUP_ROWS).select("large")
    large = cut(large)  # as many as the rows make room for
    if large.isEmpty():
        return df.withColumn("place", small)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(group).alias("of"))
    same, keys = F.col("of").eqNullSafe(F.col("large")), ["of", *[f"row.{c}" for c in order]]
    placed = with_ordinal(rows.join(large, same, "left_semi").repartitionByRange(*keys).sortWithinPartitions(*keys))
    firsts = placed.groupBy(F.col("of").alias("group")).agg(F.min("ordinal").alias("first"))
    spread = placed.join(firsts, F.col("of").eqNullSafe(F.col("group"))).select("row.*", (F.col("ordinal") - F.col("first") + 1).alias("place"))
    return spread.unionByName(rows.join(large, same, "left_anti").select("row.*").withColumn("place", small))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The names in the first record of a CSV file, as they stand there: repeated ones are not renamed."""
    first = spark.read.options(header=False, multiLine=True, quote='"', escape='"').csv(path).first()
    return [] if first is None else [x or "" for x in first]


def read_rows(spark: SparkSession, path: str, required: Sequence[str], exact: bool = False) -> DataFrame:
    """A CSV file as text columns with an ordinal that starts at 2, as the header is record 1.

    All ``required`` columns must be there, once each; with ``exact`` they must be the whole header in this order.
    """
    names = header_of(spark, path)
    missing = [c for c in required if c not in names]
    repeated = sorted({c for c in names if names.count(c) > 1})
    if missing or repeated or (exact and names != list(required)):
        raise ValueError(f"header of {path}: missing {missing}, repeated {repeated}, found {names}")
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False).schema(", ".join(f"`{c}` string" for c in names)).csv(path)
    return with_ordinal(rows, first=2)


def empty_fields(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """(ordinal, field) of every required field that is null or blank; all of them, not only the first."""
    blank = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)^\s*$"), F.lit(c)) for c in required]))
    return rows.select("ordinal", F.explode(blank).alias("field"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL file as (ordinal, line)."""
    return with_ordinal(spark.read.text(path).withColumnRenamed("value", "line"))


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last by ``order``; a partial aggregate, so repeated keys are reduced before they move."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below ``root``, by its path from there; empty files included.

    Spark's readers skip empty files, so what its index of files names and the scan did not give has empty content. That index
    holds every name on the driver in any case; contents never get there.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    scheme = "^[a-z]+:/+"

    def below(path: Column) -> Column:
        return F.substring(F.regexp_replace(path, scheme, ""), len(re.sub(scheme, "", base).rstrip("/")) + 2, 1 << 20)

    read = files.select(below(F.col("path")).alias("path"), "content")
    named = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "file string").select(below(F.col("file")).alias("path"))
    empty = named.join(files.select(below(F.col("path")).alias("path")), "path", "left_anti")
    return read.unionByName(empty.withColumn("content", F.lit(b"")))
