"""Queries on scores: accuracies, recalls, ranks and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.jobs.inputs import RUNS_SQL, SCORED_SQL, answer_key, predictions, runs, table
from sluicework.operators import metrics

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "zz")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scored(answer_key(spark, sf_dir), predictions(spark, sf_dir), "doc_id", "expected", "predicted")


def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.balanced_accuracy(_scored(spark, sf_dir), "ambiguous", "subset")


def missing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.missing_predictions(answer_key(spark, sf_dir), predictions(spark, sf_dir), "doc_id")


def subset_accuracy_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.accuracy_by(_scored(spark, sf_dir), F.col("subset"), LANGUAGES)
    worst = found.agg(F.lit("(worst)").alias("name"), F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.min("accuracy").alias("accuracy"))
    return found.unionByName(worst)


def macro_label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).cast("long").alias("expected"), (F.col("vec_id") % 3).alias("predicted"))
    return metrics.macro_label_recall(rows.withColumn("hit", (F.col("expected") == F.col("predicted")).cast("int")), "expected")


def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", 0.95)


def selection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.selection_errors(runs(spark, sf_dir), "m0", "m2", F.col("u"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("case when doc_id % 13 = 0 then 'source_failed' when n_chars % 6 = 0 then 'invalid_json' else 'valid' end")
    rows = table(spark, sf_dir, "documents").select(status.alias("status"), (F.col("n_chars") % 97).alias("seconds"))
    return metrics.run_summary(rows, "status", "seconds")


def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("lang", "m2").agg(F.count("*").alias("n"))


QUERIES = (balanced_accuracy, missing_predictions, subset_accuracy_zero_filled, macro_label_recall, nearest_rank_p95, selection_errors, run_summary, label_histogram)
ORACLE = {
    "balanced_accuracy": f"""with {SCORED_SQL},
tot as (select count(*) as n, coalesce(sum(hit), 0) as c, count(*) filter (ambiguous) as na, coalesce(sum(hit) filter (ambiguous), 0) as ca,
  count(*) filter (not ambiguous) as nd, coalesce(sum(hit) filter (not ambiguous), 0) as cd from scored),
share as (select *, case when n > 0 then cast(c as double) / n else 0.0 end as s, case when na > 0 then cast(ca as double) / na else 0.0 end as sa,
  case when nd > 0 then cast(cd as double) / nd else 0.0 end as sd from tot)
select 'overall' as metric, 'accuracy' as name, cast(n as bigint) as n, cast(c as bigint) as correct, s as value from share
union all select 'overall', 'ambiguous', cast(na as bigint), cast(ca as bigint), sa from share
union all select 'overall', 'disambiguated', cast(nd as bigint), cast(cd as bigint), sd from share
union all select 'overall', 'balanced_accuracy', cast(n as bigint), cast(c as bigint), (sa + sd) / 2 from share
union all select 'subset', subset, count(*), cast(sum(hit) as bigint), cast(sum(hit) as double) / count(*) from scored group by subset""",
    "missing_predictions": f"with {SCORED_SQL} select doc_id from key where doc_id not in (select doc_id from pred)",
    "subset_accuracy_zero_filled": f"""with {SCORED_SQL},
dim as (select unnest(['{"', '".join(LANGUAGES)}']) as name),
got as (select name, count(doc_id) as n, cast(coalesce(sum(hit), 0) as bigint) as correct from dim left join scored on subset = name group by name),
acc as (select *, case when n > 0 then cast(correct as double) / n else 0.0 end as accuracy from got)
select name, n, correct, accuracy from acc union all select '(worst)', cast(sum(n) as bigint), cast(sum(correct) as bigint), min(accuracy) from acc""",
    "macro_label_recall": """with r as (select cast(label % 3 as bigint) as expected, case when label % 3 = vec_id % 3 then 1 else 0 end as hit from embeddings),
dim as (select unnest([0, 1, 2]) as name),
acc as (select name, count(expected) as n, case when count(expected) > 0 then cast(sum(hit) as double) / count(expected) else 0.0 end as a from dim left join r on expected = name group by name)
select cast(sum(n) as bigint) as n, avg(a) as macro_label_recall from acc""",
    "nearest_rank_p95": """with r as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, n, value from r where r = cast(ceil(cast(0.95 as decimal(10, 6)) * n) as bigint)""",
    "selection_errors": f"""with r as ({RUNS_SQL}) select count(*) as n, count(*) filter (m2 = u and m0 <> u) as unknown_over, count(*) filter (m2 <> u and m0 = u) as person_over from r""",
    "run_summary": """with r as (select case when doc_id % 13 = 0 then 'source_failed' when n_chars % 6 = 0 then 'invalid_json' else 'valid' end as status, n_chars % 97 as seconds from documents)
select count(*) as n, count(*) filter (status <> 'source_failed') as generated, count(*) filter (status = 'source_failed') as failed, count(*) filter (status = 'valid') as parse_valid,
count(*) filter (status = 'invalid_json') as parse_invalid, cast(sum(seconds) as bigint) as seconds, cast(sum(seconds) as double) / count(*) * 8500 as projected from r""",
    "label_histogram": f"with r as ({RUNS_SQL}) select lang, m2, count(*) as n from r group by lang, m2",
}
