"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.scratch import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v: link neighbours to the least node of their star.

    Large: neighbours above the centre. Small: those below it, and the centre. The least node is a partial aggregate; the
    join back can be split by adaptive execution, so that a node with very many neighbours weighs on no single task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        linked = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter("u > v").distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node of the edges; a component is named by its least node.

    Large-star and small-star steps alternate until nothing changes, each round written to the shared folder: about log n
    rounds, and only two numbers reach the driver in each. Self-loops and nulls are left out; repeated edges count once.
    """
    a, b = F.col(left), F.col(right)
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.table(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "0")
    seen, rounds = None, 0
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen, rounds = state, rounds + 1
        now = scratch.table(_stars(_stars(now, True), False), str(rounds))
        scratch.drop(str(rounds - 1))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
