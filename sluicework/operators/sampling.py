"""Deterministic samples, schedules and first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluicework.functions.text import selection_key
from sluicework.scratch import cut


def hash_sample(df: DataFrame, count: int, seed: int, source: Column, row_id: Column) -> DataFrame:
    """The ``count`` rows of least selection key; the same rows whatever the order or partitions of the input."""
    return df.withColumn("key", selection_key(seed, source, row_id)).orderBy("key", row_id).limit(count)


def stratified_holdout(df: DataFrame, stratum: str, row_id: str, targets: dict[str, int], seed: int) -> DataFrame:
    """``df`` with ``split``: of each stratum, the target number of rows of least key are sealed, the rest are for selection.

    The ranks up to the largest target are all that is needed, so each task passes on no more than that many rows a stratum.
    """
    most = max(targets.values(), default=0)
    keyed = df.withColumn("_key", selection_key(seed, F.concat(F.lit("holdout:"), F.col(stratum)), F.col(row_id)))
    ranked = keyed.select(stratum, row_id, "_key").withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_key", row_id))).filter(F.col("_rank") <= most)
    wanted = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(n)) for s, n in targets.items()], F.lit(0))
    sealed = ranked.filter(F.col("_rank") <= wanted).select(row_id, F.lit("sealed_holdout").alias("split"))
    return keyed.drop("_key").join(sealed, row_id, "left").withColumn("split", F.coalesce("split", F.lit("selection")))


def first_wins(df: DataFrame, digest: Column, near: Column, order: str) -> DataFrame:
    """``df`` with ``reason``: accepted for the first row of each ``near`` key by ``order``; the others are an exact duplicate
    if their digest is that of the first, else a near one. Null is a key like any other; as in SQL, a null digest equals none.
    Counted per key first, so a key with very many rows is no burden."""
    rows = df.withColumn("_digest", digest).withColumn("_near", near)
    firsts = rows.groupBy(F.col("_near").alias("_key")).agg(F.min(F.struct(F.col(order).alias("o"), F.col("_digest").alias("d"))).alias("_first"))
    reason = F.when(F.col(order) == F.col("_first.o"), "accepted").when(F.col("_digest") == F.col("_first.d"), "exact_duplicate").otherwise("near_duplicate")
    return rows.join(firsts, F.col("_near").eqNullSafe(F.col("_key"))).withColumn("reason", reason).drop("_near", "_digest", "_key", "_first")


def accept_until(df: DataFrame, failed: Column, digest: Column, near: Column, order: str, count: int) -> DataFrame:
    """The rows that a run in order of ``order`` looks at until it has accepted ``count``, with ``reason``: that of ``failed`` if
    not null, else accepted, exact_duplicate or near_duplicate as in ``first_wins``. Fewer than ``count`` are an error.

    ``order`` must tell rows apart. Where the run ends follows from a prefix count over ranges: accepted rows are counted by
    range, one number each, then places are counted within the one range where the sum passes ``count``. Neither rows nor places
    of the rest are gathered anywhere.
    """
    if count < 1:
        raise ValueError("count must be at least 1")
    rows = cut(df.withColumn("reason", failed))
    good = first_wins(rows.filter(F.col("reason").isNull()).drop("reason"), digest, near, order)
    marked = cut(good.unionByName(rows.filter(F.col("reason").isNotNull())))
    accepted = marked.filter("reason = 'accepted'").select(order)
    ranged = cut(accepted.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    passes = sizes.withColumn("before", before).filter((F.col("before") < count) & (F.col("before") + F.col("n") >= count))
    inside = ranged.join(F.broadcast(passes), "_range").withColumn("_place", F.col("before") + F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    last = inside.filter(F.col("_place") == count).select(F.col(order).alias("_last"))
    if last.isEmpty():
        raise ValueError(f"fewer than {count} rows were accepted")
    return marked.join(F.broadcast(last), F.col(order) <= F.col("_last")).drop("_last")


def balanced_schedule(spark: SparkSession, seed: int, ambiguous_each: int = 40, resolvable_each: int = 80) -> DataFrame:
    """(place, kind, position, label) of generated records: each uncertainty position for ambiguous ones, each pair of a
    position and a person label for resolvable ones, in the order of their selection keys."""
    pairs = [("ambiguous", p, p, ambiguous_each) for p in range(3)] + [("resolvable", p, x, resolvable_each) for p in range(3) for x in range(3) if x != p]
    plan = spark.createDataFrame([(k, *x) for k, x in enumerate(pairs)], "ord int, kind string, position int, label int, times int")
    rows = plan.select("*", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    rows = rows.withColumn("key", selection_key(seed, F.col("kind"), F.concat_ws("-", "position", "label", "copy")))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("key", "ord", "copy"))).select("place", "kind", "position", "label")
