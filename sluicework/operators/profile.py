"""What values a corpus holds, group by group: most frequent values, overlapping buckets and their pairs."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework.functions.text import normalised


def words(text: Column) -> Column:
    """The normalised words of a text; none of a null or empty one."""
    return F.filter(F.split(F.coalesce(normalised(text), F.lit("")), " "), lambda w: w != "")


def phrases(word_list: Column, n: int) -> Column:
    """Every run of ``n`` consecutive words, as one string; repeated ones as often as they stand there."""
    found = word_list
    for k in range(1, n):
        left = F.size(word_list) - k
        found = F.zip_with(F.slice(found, F.lit(1), left), F.slice(word_list, F.lit(k + 1), left), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(word_list) >= n, found).otherwise(F.array().cast("array<string>"))


def prefix(word_list: Column, n: int) -> Column:
    """The first ``n`` words as an array of one string; empty if there are fewer."""
    return F.when(F.size(word_list) >= n, F.array(F.array_join(F.slice(word_list, 1, n), " "))).otherwise(F.array().cast("array<string>"))


def top_values(rows: DataFrame, group: str, facets: Mapping[str, Column], k: int) -> DataFrame:
    """(facet, group, rank, value, n): the ``k`` most frequent values of each facet in each group, ties by value.

    A facet is an array of strings; every element counts, null ones do not, and a null array holds none. All facets are counted
    in one pass, before anything moves. Each task keeps the first ``k`` of its own counted values for each group (Spark limits
    the rank before it shuffles), so that what meets in one task is k values a task, however many there are. A null
    group is a group. Repeated rows count each.
    """

    named = F.array(*[F.struct(F.lit(name).alias("facet"), values.alias("values")) for name, values in facets.items()])
    counted = rows.select(F.col(group), F.inline(named)).select("facet", group, F.explode("values").alias("value")).filter(F.col("value").isNotNull())
    counted = counted.groupBy("facet", group, "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("facet", group).orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("facet", group, "rank", "value", "n")


def bucket_mask(buckets: Mapping[str, Column]) -> Column:
    """One bit for each bucket that a row falls into; a null test is no."""
    bits = [F.when(test, F.lit(1 << at)).otherwise(F.lit(0)) for at, test in enumerate(buckets.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask.cast("long")


def bucket_pairs(masked: DataFrame, group: str, mask: str, names: list[str]) -> DataFrame:
    """(group, left, right, n_left, n_right, n_both) of every pair of overlapping buckets, zero counts included.

    Rows are counted by their whole mask first: at most 2 ** buckets rows a group are left, whatever the table's size, and
    only these are looked at bit by bit. No row is expanded into its pairs.
    """
    if not 0 < len(names) <= 20:
        raise ValueError("from 1 to 20 buckets")
    counted = masked.groupBy(group, F.col(mask).alias("mask")).agg(F.count("*").alias("n"))
    pairs = [(a, b) for a, b in combinations(range(len(names)), 2)]

    def held(*bits: int) -> Column:
        wanted = sum(1 << b for b in bits)
        return F.sum(F.when(F.col("mask").bitwiseAND(F.lit(wanted)) == wanted, F.col("n")).otherwise(0))

    sums = counted.groupBy(group).agg(*[held(k).alias(f"one{k}") for k in range(len(names))], *[held(a, b).alias(f"both{a}_{b}") for a, b in pairs])
    found = F.array(*[F.struct(F.lit(names[a]).alias("left"), F.lit(names[b]).alias("right"), F.col(f"one{a}").alias("n_left"), F.col(f"one{b}").alias("n_right"), F.col(f"both{a}_{b}").alias("n_both")) for a, b in pairs])
    return sums.select(group, F.inline(found))
