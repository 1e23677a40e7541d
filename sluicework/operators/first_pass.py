"""The first pass over samples: what becomes of each, what the second may be given, and the sources it draws on.

Texts and lists are fixed values of the contracts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.text import strip
from sluicework.operators.parsing import EVIDENCE_TYPES, VERSION
from sluicework.operators.revalidation import LABELS, RISK_FLAGS
from sluicework.operators.rules import Rule
from sluicework.sources.tables import with_ordinal

#: Relations of a caption that can be seen.
RELATIONS = (
    "above", "at the edge of", "at the left side of", "at the right side of", "behind", "below", "beneath", "connected to", "contains", "facing", "facing away from", "in", "in front of", "inside", "left of",
    "on", "on top of", "parallel to", "right of", "touching", "under",
)


def first_pass(image_status: Column, image_error: Column, image: Column, prompt_error: Column, prompt: Column, inference_error: Column, output: Column) -> Column:
    """struct(status, error_type, error_message, raw_output, prompt_sha256, image_sha256, image_bytes) of a sample.

    Steps follow each other: image, prompt, inference; the first that fails is the status. An image that failed has no prompt's
    hash, nor has a prompt that failed; image bytes and hash are there wherever the image is. A failed image without a message
    tells its status.
    """
    loaded = image_status.eqNullSafe(F.lit("loaded"))
    prompted = loaded & prompt_error.isNull()
    done = prompted & inference_error.isNull()

    def failed(image_part: Column | None, prompt_part: Column | None, inference_part: Column | None) -> Column:
        return F.when(~loaded, image_part).when(~prompted, prompt_part).when(~done, inference_part)

    kinds = [F.lit(x) for x in ("ImageLoadError", "ConfigurationError", "InferenceError")]
    said = F.coalesce(F.nullif(image_error, F.lit("")), F.concat(F.lit("image load failed with status: "), F.coalesce(image_status, F.lit("None"))))
    return F.struct(
        F.coalesce(failed(F.lit("image_failed"), F.lit("prompt_failed"), F.lit("inference_failed")), F.lit("generated")).alias("status"),
        failed(*kinds).alias("error_type"),
        failed(said, prompt_error, inference_error).alias("error_message"),
        F.when(done, output).alias("raw_output"),
        F.when(prompted, F.sha2(prompt, 256)).alias("prompt_sha256"),
        F.sha2(image, 256).alias("image_sha256"),
        F.octet_length(image).cast("long").alias("image_bytes"),
    )


def trigger_input_rules() -> list[Rule]:
    """What a parsed row must be before triggers are looked for, in order: columns by the names of its fields. Rows of the
    newer schema, whoever made them, are not for the older second pass."""
    c = F.col
    name, valid = c("sample_id"), c("parse_status") == "valid"

    def row(text: str) -> Column:
        return F.concat(F.lit("valid parsed row "), name, F.lit(f" {text}"))

    return [
        ("lineage", "legacy Verifier is not compatible with Reasoner v3 lineage", (c("schema_version") == VERSION) | c("uncertainty_option_index").isNotNull()),
        *[("identity", f"{k} must be a non-empty string", strip(F.coalesce(c(k), F.lit(""))) == "") for k in ("run_id", "sample_id")],
        ("flags", F.concat(F.lit("unsupported Reasoner risk_flags for sample "), name), c("risk_flags").isNull() | F.exists("risk_flags", lambda f: ~F.coalesce(f.isin(*RISK_FLAGS), F.lit(False)))),
        ("label", row("is missing a valid label"), valid & ~F.coalesce(c("parsed_label").isin(*LABELS), F.lit(False))),
        ("evidence", row("is missing evidence"), valid & (strip(F.coalesce(c("evidence_summary"), F.lit(""))) == "")),
        ("type", row("has unsupported evidence_type"), valid & ~F.coalesce(c("evidence_type").isin(*EVIDENCE_TYPES), F.lit(False))),
        ("signal", row("has invalid uncertainty_signal"), valid & c("uncertainty_signal").isNull()),
    ]


def relation_captions(rows: DataFrame, order: str, caption: str, relation: str, image: str, label: str) -> DataFrame:
    """(order, reason) of every caption: no_person (``person`` is no word between blanks), relation (not one that can be seen),
    duplicate (no image, or one that an eligible caption before has), malformed (the label is not 0 or 1), eligible.

    ``order`` must tell rows apart. Firsts are aggregated by image and joined back, so an image that very many captions share is
    no burden.
    """
    words = F.split(F.regexp_replace(F.lower(F.col(caption)), r"(?U)\s+", " "), " ")
    person = F.coalesce(F.array_contains(words, "person"), F.lit(False))
    seen = F.coalesce(F.col(relation).isin(*RELATIONS), F.lit(False))
    good = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    staged = rows.select(F.col(order).alias("o"), F.col(image).alias("image"), person.alias("person"), seen.alias("seen"), good.alias("good"))
    firsts = staged.filter("person and seen and good and image is not null").groupBy(F.col("image").alias("of")).agg(F.min("o").alias("first"))
    joined = staged.join(firsts, F.col("image") == F.col("of"), "left")
    again = F.col("image").isNull() | F.coalesce(F.col("o") > F.col("first"), F.lit(False))
    reason = F.when(~F.col("person"), "no_person").when(~F.col("seen"), "relation").when(again, "duplicate").when(~F.col("good"), "malformed").otherwise("eligible")
    return joined.select(F.col("o").alias(order), reason.alias("reason"))


def zipped(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """Sequences side by side: one row for each place, with every part's columns in a struct (p0, p1, ...), and the place from 1.

    Each part comes with the column that orders it, which must tell its rows apart. Parts of different lengths are an error.
    Each is numbered over ranges, then joined by place: no part is gathered in one task.
    """
    numbered = []
    for k, (df, order) in enumerate(parts):
        ranged = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"p{k}")).repartitionByRange(F.col(f"p{k}.{order}")).sortWithinPartitions(F.col(f"p{k}.{order}"))
        numbered.append(with_ordinal(ranged))
    sizes = [n.count() for n in numbered]
    if len(set(sizes)) > 1:
        raise ValueError(f"sequences of different lengths: {sizes}")
    joined = numbered[0]
    for more in numbered[1:]:
        joined = joined.join(more, "ordinal")
    return joined.withColumnRenamed("ordinal", "place")
