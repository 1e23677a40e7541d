"""Scores of predictions: accuracies with zero-filled groups, recalls, exact ranks and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scored(key: DataFrame, predictions: DataFrame, on: str, expected: str, predicted: str) -> DataFrame:
    """Key rows that have a prediction, with ``hit``; rows without one are left out of every denominator."""
    return key.join(predictions, on).withColumn("hit", (F.col(expected) == F.col(predicted)).cast("int"))


def missing_predictions(key: DataFrame, predictions: DataFrame, on: str) -> DataFrame:
    return key.join(predictions, on, "left_anti").select(on)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is empty."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def balanced_accuracy(rows: DataFrame, ambiguous: str, subset: str) -> DataFrame:
    """Long table (metric, name, n, correct, value) from scored rows.

    One pass aggregates by subset and ambiguity; the few groups then give accuracy, the accuracies of ambiguous and
    disambiguated rows, their mean (balanced), and one row per subset.
    """
    groups = rows.groupBy(F.col(subset).alias("name"), F.col(ambiguous).alias("amb")).agg(F.count("*").alias("n"), F.sum("hit").alias("correct"))
    by_subset = groups.groupBy("name").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct")).select(F.lit("subset").alias("metric"), "name", "n", "correct", ratio(F.col("correct"), F.col("n")).alias("value"))

    def total(test: Column, column: str) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0))

    amb, dis, every = F.col("amb"), ~F.col("amb"), F.lit(True)
    sums = groups.agg(*[total(t, c).alias(f"{c}_{k}") for k, t in (("amb", amb), ("dis", dis), ("all", every)) for c in ("n", "correct")])
    share = {k: ratio(F.col(f"correct_{k}"), F.col(f"n_{k}")) for k in ("amb", "dis", "all")}
    overall = F.array(
        F.struct(F.lit("accuracy").alias("name"), F.col("n_all").alias("n"), F.col("correct_all").alias("correct"), share["all"].alias("value")),
        F.struct(F.lit("ambiguous").alias("name"), F.col("n_amb").alias("n"), F.col("correct_amb").alias("correct"), share["amb"].alias("value")),
        F.struct(F.lit("disambiguated").alias("name"), F.col("n_dis").alias("n"), F.col("correct_dis").alias("correct"), share["dis"].alias("value")),
        F.struct(F.lit("balanced_accuracy").alias("name"), F.col("n_all").alias("n"), F.col("correct_all").alias("correct"), ((share["amb"] + share["dis"]) / 2).alias("value")),
    )
    return sums.select(F.inline(overall)).select(F.lit("overall").alias("metric"), "name", "n", "correct", "value").unionByName(by_subset)


def accuracy_by(rows: DataFrame, group: Column, names: Sequence) -> DataFrame:
    """(name, n, correct, accuracy) for every one of ``names``, empty groups with accuracy 0.0."""
    spark = rows.sparkSession
    dimension = spark.createDataFrame([(n,) for n in names], ["name"])
    found = rows.groupBy(group.alias("name")).agg(F.count("*").alias("n"), F.sum("hit").alias("correct"))
    n, c = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("correct", F.lit(0)).cast("long")
    return dimension.join(found, "name", "left").select("name", n.alias("n"), c.alias("correct"), ratio(c, n).alias("accuracy"))


def macro_label_recall(rows: DataFrame, expected: str, labels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Mean over the labels of the recall of each; a label without rows has recall 0.0."""
    return accuracy_by(rows, F.col(expected).cast("long"), list(labels)).agg(F.sum("n").alias("n"), F.avg("accuracy").alias("macro_label_recall"))


def nearest_rank(df: DataFrame, group: str, value: str, share: float, accuracy: int = 10_000) -> DataFrame:
    """(group, n, value at place ceil(share * n) in ascending order), exactly, without sorting any group as a whole.

    An approximate quantile sketch brackets the place, in one row a group. Of all other rows only those within the bracket are
    counted by value, those below it by group alone, both before anything moves; a running sum then ranks a group's counted
    values. A value that fills much of a group is one row. Null values are left out; a null group is a group.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    slack = 3 / accuracy
    ends = F.percentile_approx("v", [max(0.0, share - slack), min(1.0, share + slack)], accuracy)
    bounds = rows.groupBy(F.col("g").alias("of")).agg(F.count("*").alias("n"), ends.alias("e")).select("of", "n", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))
    near = rows.join(bounds, F.col("g").eqNullSafe(F.col("of"))).filter("v <= hi")
    counted = near.groupBy("g", "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))  # null: below
    upto = F.sum("c").over(Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    place = F.ceil(F.lit(share).cast("decimal(10,6)") * F.col("n"))
    return counted.withColumn("r", upto).filter((F.col("r") >= place) & (F.col("r") - F.col("c") < place)).select(F.col("g").alias(group), "n", F.col("v").alias("value"))


def accuracy_by_subset(rows: DataFrame, subsets: str, names: Sequence[str]) -> DataFrame:
    """``accuracy_by`` for rows that belong to several subsets (an array): a row counts once in each."""
    return accuracy_by(rows.select("hit", F.explode(F.array_distinct(subsets)).alias("subset")), F.col("subset"), names)


def failure_rates(rows: DataFrame, parse_valid: str, image_loaded: str, unresolved: str) -> DataFrame:
    """One row of shares: parses and images that failed, and what stayed unresolved. An unknown value is a parse that is
    valid, an image that is loaded, a row that is resolved."""
    tests = {
        "parse_failure_rate": ~F.coalesce(parse_valid, F.lit(True)),
        "image_load_failure_rate": ~F.coalesce(image_loaded, F.lit(True)),
        "unresolved_rate": F.coalesce(unresolved, F.lit(False)),
    }
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()])
    return counts.select("n", *[ratio(F.col(k), F.col("n")).alias(k) for k in tests])


def selection_errors(rows: DataFrame, expected: str, predicted: str, unknown: Column) -> DataFrame:
    """Counts of wrong rows that chose uncertainty over a person, and a person over uncertainty."""
    picked_unknown = F.col(predicted) == unknown
    wants_unknown = F.col(expected) == unknown
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(picked_unknown & ~wants_unknown).alias("unknown_over"),
        F.count_if(~picked_unknown & wants_unknown).alias("person_over"),
    )


def run_summary(rows: DataFrame, status: str, seconds: str, project_to: int = 8500) -> DataFrame:
    """Counts by outcome, mean seconds and the seconds that ``project_to`` rows would take."""
    generated = F.col(status) != "source_failed"
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(generated).alias("generated"),
        F.count_if(~generated).alias("failed"),
        F.count_if(F.col(status) == "valid").alias("parse_valid"),
        F.count_if(generated & (F.col(status) != "valid")).alias("parse_invalid"),
        F.sum(seconds).alias("seconds"),
    ).withColumn("projected", ratio(F.col("seconds"), F.col("n")) * project_to)


def prediction_faults(predictions: DataFrame, row_id: str, label: str, seconds: str) -> DataFrame:
    """(id, message) of every prediction that breaks the contract of evaluation, both rules: a label of 0, 1 or 2; seconds that
    are there, a number, and not negative."""
    good = F.coalesce(F.col(label).isin(0, 1, 2), F.lit(False))
    time = F.coalesce((F.col(seconds) >= 0) & ~F.isnan(F.col(seconds).cast("double")), F.lit(False))
    name = F.col(row_id).cast("string")
    found = F.array_compact(F.array(F.when(~good, F.concat(name, F.lit(": predicted_label must be 0, 1, or 2"))), F.when(~time, F.concat(name, F.lit(": elapsed_seconds must be non-negative")))))
    return predictions.select(row_id, F.explode(found).alias("message"))


def subset_errors(rows: DataFrame, subsets: str, hit: str, names: Sequence[str]) -> DataFrame:
    """(name, errors): wrong rows of each named subset (``subsets`` is an array), 0 where it has none."""
    wrong = rows.filter(~F.coalesce(F.col(hit).cast("boolean"), F.lit(False))).select(F.explode(F.array_distinct(subsets)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    dimension = rows.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return dimension.join(wrong, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("errors"))
