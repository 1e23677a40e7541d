"""Order, identity and contract checks on id sequences and finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_mismatches(left: DataFrame, right: DataFrame, ordinal: str, row_id: str) -> DataFrame:
    """(ordinal, left_id, right_id) of the places where two sequences differ, a missing row included."""
    a = left.select(F.col(ordinal), F.col(row_id).alias("left_id"))
    b = right.select(F.col(ordinal), F.col(row_id).alias("right_id"))
    return a.join(b, ordinal, "full_outer").filter(~F.col("left_id").eqNullSafe(F.col("right_id")))


def first_mismatch(left: DataFrame, right: DataFrame, ordinal: str, row_id: str) -> DataFrame:
    """One row: both lengths, the number of differing places and the first of them (null if there is none)."""
    both = left.select(F.col(ordinal), F.col(row_id).alias("a")).join(right.select(F.col(ordinal), F.col(row_id).alias("b")), ordinal, "full_outer")
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count_if(differs).alias("n_differ"), F.min(F.when(differs, F.col(ordinal))).alias("first"))


def id_difference(expected: DataFrame, actual: DataFrame, row_id: str) -> DataFrame:
    """(side, id): ids that are missing from, or extra in, the actual rows."""
    e, a = expected.select(row_id).distinct(), actual.select(row_id).distinct()
    missing = e.join(a, row_id, "left_anti").select(F.lit("missing").alias("side"), row_id)
    return missing.unionByName(a.join(e, row_id, "left_anti").select(F.lit("extra").alias("side"), row_id))


def duplicate_ids(rows: DataFrame, row_id: str) -> DataFrame:
    return rows.groupBy(row_id).agg(F.count("*").alias("n")).filter("n > 1")


def run_violations(rows: DataFrame, row_id: str, label: str, expected_rows: int, labels=(0, 1, 2)) -> DataFrame:
    """(rule, n) of the rules that a finished run breaks: size, duplicate or null ids, labels outside the domain."""
    one = rows.groupBy(row_id).agg(F.count("*").alias("k"), F.count_if(F.col(label).isNull() | ~F.col(label).isin(*labels)).alias("bad"))
    sums = one.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k") - 1)), F.lit(0)).alias("dup"), F.coalesce(F.sum(F.when(F.col(row_id).isNull(), F.col("k"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    found = F.array(
        F.struct(F.lit("row_count").alias("rule"), F.abs(F.col("rows") - expected_rows).alias("n")),
        F.struct(F.lit("duplicate_id").alias("rule"), F.col("dup").alias("n")),
        F.struct(F.lit("null_id").alias("rule"), F.col("nulls").alias("n")),
        F.struct(F.lit("label_domain").alias("rule"), F.col("bad").alias("n")),
    )
    return sums.select(F.inline(found)).filter("n > 0")
