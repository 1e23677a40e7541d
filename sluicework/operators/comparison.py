"""How the runs of several models differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def disagreement_matrix(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """(left, right, rows, disagree) of every pair of models: one pass, one sum per pair, no self-join."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    sums = rows.agg(F.count("*").alias("n"), *[F.sum((F.col(a) != F.col(b)).cast("long")).alias(f"{a}|{b}") for a, b in pairs])
    out = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col("n").alias("rows"), F.coalesce(F.col(f"`{a}|{b}`"), F.lit(0)).cast("long").alias("disagree")) for a, b in pairs])
    return sums.select(F.inline(out))


def risk_sets(rows: DataFrame, base: str, others: Sequence[str], unknown: str, agree: int = 3) -> DataFrame:
    """One row of counts: all agree; base alone against all others, which agree; at least ``agree`` others share one label
    against the base; base uncertain while ``agree`` others choose one person."""
    labels = F.array(*[F.col(m) for m in others])
    against = F.filter(labels, lambda x: x != F.col(base))
    most = F.array_max(F.transform(F.array_distinct(against), lambda v: F.size(F.filter(against, lambda x: x == v))))
    persons = F.filter(labels, lambda x: x != F.col(unknown))
    most_person = F.array_max(F.transform(F.array_distinct(persons), lambda v: F.size(F.filter(persons, lambda x: x == v))))
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.size(against) == 0).alias("all_agree"),
        F.count_if((F.size(against) == len(others)) & (F.size(F.array_distinct(labels)) == 1)).alias("base_alone"),
        F.count_if(F.coalesce(most, F.lit(0)) >= agree).alias("outvoted"),
        F.count_if((F.col(base) == F.col(unknown)) & (F.coalesce(most_person, F.lit(0)) >= agree)).alias("uncertain_against_person"),
    )


def transitions(rows: DataFrame, base: str, models: Sequence[str], unknown: str) -> DataFrame:
    """(model, kind, n): how labels move from the base to each model, between uncertainty and persons."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("label")) for m in models])
    flat = rows.select(F.col(base).alias("b"), F.col(unknown).alias("u"), F.inline(pairs))
    kind = (
        F.when(F.col("b") == F.col("label"), "same")
        .when(F.col("b") == F.col("u"), "unknown_to_person")
        .when(F.col("label") == F.col("u"), "person_to_unknown")
        .otherwise("person_to_other")
    )
    return flat.groupBy("model", kind.alias("kind")).agg(F.count("*").alias("n"))
