"""The outcome of the second pass for every sample, and the contract of its records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.operators.parsing import first_fault
from sluicework.operators.triggers import DECISIVE, PERSONS, TRIGGERS

#: What an image may be, and what a verifier's output may be.
IMAGE_STATUSES = ("loaded", "missing", "unreadable", "corrupt")
PARSE_STATUSES = ("valid", "missing_marker", "invalid_json", "invalid_schema", "invalid_label")
#: Fields that a row without verification leaves null, and those that a failed one does.
VERDICT = ("after_label", "verifier_reason", "verifier_evidence_type", "reasoner_defect_found", "objective_support")
SKIPPED_NULL = ("raw_verifier_output", *VERDICT, "image_status", "verifier_parse_status", "error_type", "error_message")


def outcome(required: Column, image_status: Column, image_error: Column, prompt_error: Column, inference_error: Column, parse_status: Column, parse_error: Column) -> Column:
    """struct(status, error_type, error_message): how far the verification of a sample came. Steps follow each other, so the
    first that failed is the outcome; a null error is none."""

    def out(status: str, kind: str | None, error: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(kind).cast("string").alias("error_type"), error.alias("error_message"))

    nothing = F.lit(None).cast("string")
    return (
        F.when(~F.coalesce(required, F.lit(False)), out("skipped_not_triggered", None, nothing))
        .when(~image_status.eqNullSafe(F.lit("loaded")), out("image_failed", "ImageLoadError", image_error))
        .when(prompt_error.isNotNull(), out("prompt_failed", "ConfigurationError", prompt_error))
        .when(inference_error.isNotNull(), out("inference_failed", "InferenceError", inference_error))
        .when(~parse_status.eqNullSafe(F.lit("valid")), out("parse_failed", "ParseError", parse_error))
        .otherwise(out("verified", None, nothing))
    )


def ordered_triggers(found: Column, conflict: Column) -> Column:
    """Triggers in canonical order, each once, with the conflict of both passes if there is one."""
    every = F.when(F.coalesce(conflict, F.lit(False)), F.concat(found, F.array(F.lit("reasoner_verifier_conflict")))).otherwise(found)
    return F.filter(F.array(*[F.lit(t) for t in TRIGGERS]), lambda t: F.array_contains(every, t))


def contract_violation() -> Column:
    """The first rule that a verification record breaks (columns by the names of its fields), null if none: skipped rows hold
    nothing, verified rows everything, failed rows an error and no verdict."""
    c = F.col
    skipped, verified = c("status") == "skipped_not_triggered", c("status") == "verified"
    failed = ~skipped & ~verified

    def some(names) -> Column:
        return F.greatest(*[c(n).isNotNull() for n in names])

    person = c("after_label").isin(*PERSONS)
    rules = [
        (skipped, "requires_verification is invalid for skipped row", c("requires_verification")),
        (skipped, "triggers must be empty", F.size("triggers") > 0),
        (skipped, "skipped fields must be null", some(SKIPPED_NULL)),
        (~skipped, "requires_verification must be true", ~c("requires_verification")),
        (verified, "raw_verifier_output must be non-empty", F.coalesce(c("raw_verifier_output"), F.lit("")) == ""),
        *[(verified, f"{n} is required", c(n).isNull()) for n in VERDICT[:3]],
        (verified, "verifier support booleans are required", c("reasoner_defect_found").isNull() | c("objective_support").isNull()),
        (verified, "image_status is invalid", ~c("image_status").eqNullSafe(F.lit("loaded"))),
        (verified, "verifier_parse_status is invalid", ~c("verifier_parse_status").eqNullSafe(F.lit("valid"))),
        (verified, "verified rows must not include errors", some(("error_type", "error_message"))),
        (verified, "person after_label requires objective support", person & ~(c("objective_support") & c("verifier_evidence_type").isin(*DECISIVE))),
        (verified, "label 2 requires insufficient evidence", (c("after_label") == "2") & (c("objective_support") | (c("verifier_evidence_type") != "insufficient_evidence"))),
        (failed, "after_label must be null", c("after_label").isNotNull()),
        (failed, "failed verifier fields must be null", some(VERDICT[1:])),
        (failed, "image_status is invalid", ~c("image_status").isin(*IMAGE_STATUSES)),
        (failed, "verifier_parse_status is invalid", ~c("verifier_parse_status").isin(*PARSE_STATUSES)),
        (failed, "error_type and error_message are required", c("error_type").isNull() | c("error_message").isNull()),
    ]
    return first_fault([("violation", text, when & test) for when, text, test in rules])["error"]
