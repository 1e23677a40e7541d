"""Model runs over the given tables, by expressions that Spark and the SQL of the queries evaluate alike.

The tables hold no model outputs, so labels, votes and answer texts are derived from documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ("m0", "m1", "m2", "m3", "m4")
#: Labels 0 to 2 of five models; the same text is valid in both engines.
LABELS = {
    "m0": "doc_id % 3",
    "m1": "(doc_id + n_chars % 2) % 3",
    "m2": "(doc_id * 7 + n_chars) % 3",
    "m3": "case when doc_id % 5 = 0 then 2 else doc_id % 3 end",
    "m4": "case when n_chars % 4 = 0 then (doc_id + 1) % 3 else doc_id % 3 end",
    "u": "(doc_id + n_chars) % 3",
}
RUNS_SQL = "select doc_id, n_chars, lang, source, " + ", ".join(f"cast({e} as bigint) as {m}" for m, e in LABELS.items()) + " from documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, lang, source, a label of each model, and the place u of the uncertainty option."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "n_chars", "lang", "source", *[F.expr(f"cast({e} as bigint)").alias(m) for m, e in LABELS.items()])


def answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected (quality), ambiguous (toxic), subset (language) of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("expected"), (F.col("toxic") == 1).alias("ambiguous"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("subset")), "doc_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, predicted, for the documents that have a page."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    docs = table(spark, sf_dir, "documents").join(pages, "doc_id", "left_semi")
    return docs.select("doc_id", F.expr("cast(case when n_chars % 5 = 0 then 0 when n_chars % 11 = 0 then 2 else 1 end as bigint)").alias("predicted"))


SCORED_SQL = """
key as (select l.doc_id, cast(quality as bigint) as expected, toxic = 1 as ambiguous, d.lang as subset from labels l join documents d on l.doc_id = d.doc_id),
pred as (select doc_id, cast(case when n_chars % 5 = 0 then 0 when n_chars % 11 = 0 then 2 else 1 end as bigint) as predicted from documents where doc_id in (select page_id from pages)),
scored as (select k.*, p.predicted, case when expected = predicted then 1 else 0 end as hit from key k join pred p on k.doc_id = p.doc_id)"""


def draw(k: int, m: int) -> str:
    """The ``k``-th number below ``m`` of a document, as SQL that ``to_spark`` and ``to_duck`` finish."""
    return f"(((doc_id * 7919 + {k} * 104729) % 1000003) DIV {k + 1} % {m})"


def to_spark(sql: str) -> str:
    return sql


def to_duck(sql: str) -> str:
    """The same expressions as DuckDB writes them."""
    return sql.replace(" DIV ", " // ").replace(" as string)", " as varchar)")
