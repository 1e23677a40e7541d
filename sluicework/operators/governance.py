"""Building, auditing and reviewing a governed corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failure(rules: Sequence[tuple[str, Column]]) -> Column:
    """Code of the first rule whose test is true; null if none is. A null test is false."""
    return F.coalesce(*[F.when(test, F.lit(code)) for code, test in rules])


def person_boxes(boxes: DataFrame, rules: Sequence[tuple[str, Column]], group: str, order: Sequence[str], least: int = 2, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(kept groups, counters): rows that break a rule are counted under the first they break, groups are kept if ``least`` to
    ``most`` rows remain, and their rows are listed in order. Groups are counted before any
    is listed, so that none of another size is ever gathered; counters are partial sums."""
    judged = boxes.withColumn("failure", first_failure(rules))
    counters = judged.groupBy(F.coalesce("failure", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))
    eligible = judged.filter("failure is null").select(group, *order)
    fitting = eligible.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n")).filter(F.col("_n").between(least, most))
    kept = eligible.join(fitting, F.col(group).eqNullSafe(F.col("_group"))).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("boxes"))
    return kept, counters


def attribution_join(candidates: DataFrame, attribution: DataFrame, on: str, order: str, accepted: Column) -> DataFrame:
    """Candidates with the last accepted attribution row of their key; a later rejected row does not undo an earlier one."""
    rest = [c for c in attribution.columns if c != on]
    last = attribution.filter(accepted).groupBy(on).agg(F.max_by(F.struct(*rest), order).alias("_a"), F.count("*").alias("n_accepted"))
    return candidates.join(last, on).select(*candidates.columns, *[F.col(f"_a.{c}").alias(c) for c in rest if c not in candidates.columns], "n_accepted")


def audit_counts(records: DataFrame, columns: dict[str, Column], arrays: dict[str, Column]) -> DataFrame:
    """Long table (counter, name, n): one counter per column, and one per array of distinct names; a single pass."""
    pairs = [F.array(F.struct(F.lit(k).alias("counter"), c.cast("string").alias("name"))) for k, c in columns.items()]
    pairs += [_named(k, a) for k, a in arrays.items()]
    return records.select(F.inline(F.concat(*pairs))).groupBy("counter", "name").agg(F.count("*").alias("n"))


def _named(counter: str, names: Column) -> Column:
    return F.transform(F.array_distinct(names), lambda x: F.struct(F.lit(counter).alias("counter"), x.cast("string").alias("name")))


def violations(counts: DataFrame, total: str, rules: Sequence[tuple[str, str, float, str]]) -> DataFrame:
    """(ord, message) of the threshold rules that audit counts break, in the order of the rules.

    A rule is (counter, name, least, message); a least below 1 is a share of the counter named ``total``. Names that were
    never counted count 0.
    """
    spark = counts.sparkSession
    table = spark.createDataFrame([(k, c, n, float(x), m) for k, (c, n, x, m) in enumerate(rules)], "ord int, counter string, name string, least double, message string")
    whole = counts.filter(F.col("counter") == total).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    joined = table.join(counts, ["counter", "name"], "left").join(F.broadcast(whole), F.lit(True))
    n = F.coalesce("n", F.lit(0)).cast("double")
    share = F.when(F.col("whole") > 0, n / F.col("whole")).otherwise(0.0)
    broken = F.when(F.col("least") < 1, share < F.col("least")).otherwise(n < F.col("least"))
    return joined.filter(broken).select("ord", "message")


def route_reviews(records: DataFrame, reviews: DataFrame, adjudications: DataFrame, on: str) -> DataFrame:
    """Records with ``outcome``: pending without a review; reviewed or rejected as the review says; a dispute stays open
    until an adjudication accepts or rejects it."""
    joined = records.join(reviews.withColumnRenamed("decision", "_review"), on, "left").join(adjudications.withColumnRenamed("decision", "_final"), on, "left")
    outcome = (
        F.when(F.col("_review").isNull(), "pending")
        .when(F.col("_review") != "dispute", F.col("_review"))
        .when(F.col("_final").isNull(), "dispute_open")
        .when(F.col("_final") == "accept", "adjudicated")
        .otherwise("dispute_rejected")
    )
    return joined.withColumn("outcome", outcome)


def unknown_ids(decisions: DataFrame, records: DataFrame, on: str) -> DataFrame:
    """Decisions on records that do not exist."""
    return decisions.join(records, on, "left_anti")
