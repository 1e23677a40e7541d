"""Constraints on artifacts of JSON lines, as data: every line with the first rule it breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.operators.parsing import decoded_json, first_fault

#: What a raw record may have come to.
STATUSES = ("generated", "image_failed", "prompt_failed", "inference_failed")


def record_faults(lines: DataFrame, versions: Sequence[str], statuses: Sequence[str] = STATUSES) -> DataFrame:
    """(ordinal, fault) of every line of ``lines`` (ordinal, line) that breaks a rule, the first one it breaks.

    A line is one strict JSON object with a run id, a sample id, a prompt version among ``versions``, a status, and an output
    only if it was generated. The whole artifact has one run id and one version, those of its first line, and each sample
    once: a later line of the same sample breaks the rule. Firsts are partial aggregates that are joined back.
    """
    found = decoded_json(lines, "ordinal", F.col("line"))
    text = F.col("texts")

    def lacks(key: str):
        return ~F.coalesce(F.col("kinds")[key] == "string", F.lit(False))

    blank = lines.select("ordinal", F.coalesce(F.col("line"), F.lit("")).rlike(r"(?U)^\s*$").alias("blank"))
    rows = found.join(blank, "ordinal").withColumns({k: text[k] for k in ("run_id", "sample_id", "prompt_version")})
    firsts = rows.filter("sample_id is not null").groupBy("sample_id").agg(F.min("ordinal").alias("first"))
    head = F.broadcast(rows.agg(F.min_by("run_id", "ordinal").alias("run_0"), F.min_by("prompt_version", "ordinal").alias("version_0")))  # one row
    rows = rows.join(firsts, "sample_id", "left").join(head, F.lit(True), "left")
    generated = text["status"] == "generated"
    rules = [
        ("blank line", F.col("blank")),
        ("invalid JSON", F.col("error").isNotNull()),
        ("must be a JSON object", F.col("kinds").isNull()),
        ("invalid run_id", lacks("run_id")),
        ("invalid sample_id", lacks("sample_id")),
        ("invalid prompt_version", lacks("prompt_version") | ~text["prompt_version"].isin(*versions)),
        ("mixes prompt_version values", F.col("prompt_version") != F.col("version_0")),
        ("mixes run_id values", F.col("run_id") != F.col("run_0")),
        ("duplicate sample_id", F.col("ordinal") > F.col("first")),
        ("invalid status", lacks("status") | ~text["status"].isin(*statuses)),
        ("failure row must contain null raw_output", ~generated & F.col("kinds")["raw_output"].isin("string", "blank")),
    ]
    judged = rows.select("ordinal", first_fault([("fault", name, test) for name, test in rules])["error"].alias("fault"))
    return judged.filter("fault is not null")
