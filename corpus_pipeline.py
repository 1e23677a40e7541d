"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs`` under the
same names, whatever these are, and need doc_id, text, source and lang of them. Every stage gives an empty table for an empty
one and treats repeated rows as documents of their own, except that near-duplicate detection leaves one row for each document.
A null text counts as an empty one: the quality rules reject it; a stage that gets it nevertheless lets it pass, and packing
gives it its end token. Where there is a column n_chars, it is set anew when a text changes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm.decontaminate import drop_contaminated
from sluicework.llm.near_dup import drop_near_duplicates
from sluicework.llm.packing import pack_documents
from sluicework.llm.quality import keep_quality as keep_quality_rows
from sluicework.llm.secrets import redact_secrets
from sluicework.llm.text import table
from sluicework.scratch import Scratch


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those of null, empty or few words among them; of the others, lines that break a
    rule. Repeated rows are judged one by one."""
    return _counted(keep_quality_rows(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: that of the least id, as one row. Texts without a word, null ones
    included, are no copies of each other; rows with a null id stay."""
    return drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go; null and empty texts hold none. An empty benchmark
    leaves all."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced by a mark; every row stays. A null source or language counts as one unknown owner or
    repository."""
    return _counted(redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, in the columns of ``pack_documents``; a null or empty text is its end token
    alone."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", hide_secrets),
    ("packing", pack),
]

#: Several stages are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
