"""The registered queries of this subpackage and their SQL.

Each query applies its operator, with production parameters, to its whole table, and derives the digest columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm.bpe import round_trip_documents
from sluicework.llm.codes import vector_codes
from sluicework.llm.decontaminate import find_contamination
from sluicework.llm.languages import identify_language, learn_languages
from sluicework.llm.licenses import license_scan
from sluicework.llm.near_dup import near_duplicates
from sluicework.llm.negatives import hard_negatives
from sluicework.llm.packing import pack_documents
from sluicework.llm.quality import quality_rules
from sluicework.llm.secrets import digest, secret_spans
from sluicework.llm.text import table
from sluicework.llm.token_counts import token_counts
from sluicework.llm.token_files import read_token_files, write_token_files
from sluicework.llm.urls import judge_urls
from sluicework.scratch import Scratch

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))

    def count(spans: str, test) -> Column:
        return F.size(F.filter(spans, test)).cast("long")

    def of_kind(kind: str):
        return lambda s: s["kind"] == kind

    return found.select(
        "doc_id",
        *[count("base", of_kind(k)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
        count("spans", lambda s: s["live"]).alias("n_live"),
        count("spans", lambda s: ~s["live"]).alias("n_copied"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("/", s["n_owners"], s["n_repos"])), ",").alias("owners_repos"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    judged = judge_urls(table(spark, sf_dir, "pages"), labels)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.col("mined_rule").isNotNull().alias("mined"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = learn_languages(docs.filter(~F.col("held_out")))
    return identify_language(docs, model, keep=("doc_id", "held_out"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op6").path("files")
    write_token_files(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    base = F.transform("places", lambda p: p["label"])
    block = F.transform(F.filter("blocks", lambda b: b["best"]), lambda b: b["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, block))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))).alias("score"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost_share", 6).alias("lost_share"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = round_trip_documents(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_near_duplicates, op2_packing, op3_secret_scan, op4_url_filter, op5_language_id, op6_token_files, op7_token_counts, op8_license_scan, op9_quality_rules, op10_decontaminate,
            op11_hard_negatives, op12_vector_codes, op13_bpe_round_trip,
        )
    }


def oracle_sql() -> dict[str, str]:
    from sluicework.llm import sql

    return {k: v for k, v in vars(sql).items() if k.startswith("op")}
