"""Validity of governed records: a line of JSON each, with every fault it has; answer lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions import paths
from sluicework.functions.text import strip
from sluicework.operators.rules import Rule, all_faults, joined, ladder
from sluicework.operators.typed import has, items_of, kind_of, text_of, typed_json

#: Fixed values of the record contract.
TEXT_FIELDS = ("sample_id", "image_ref", "context", "question", "source_uri_or_note", "license_or_permission", "author_id")
REQUIRED = (*TEXT_FIELDS, "answers", "expected_label", "uncertainty_option_index", "expected_is_uncertainty", "subsets", "provenance_type", "review_status", "reviewer_id", "split")
OPTIONAL = ("randomization_seed", "image_sha256")
SUBSETS = ("ambiguous", "disambiguated_text", "visual_grounded", "elimination", "stereotype_trap", "expression_trap", "role_or_function", "parsing_stress")
PROVENANCES = ("public", "self_authored", "self_collected", "synthetic", "generated_allowed")
REVIEW_STATUSES = ("pending", "reviewed", "adjudicated", "rejected")
SPLITS = ("selection", "sealed_holdout")
FORBIDDEN_PROVENANCE = ("data/raw/open/test", "test.csv", "public disagreement", "leaderboard", "inferred test answer")


def _one_of(key: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(text_of(key).isin(*values) & kind_of(key).isin("string", "blank"), F.lit(False))


def _small(key: str) -> Column:
    return F.coalesce((kind_of(key) == "integer") & text_of(key).isin("0", "1", "2"), F.lit(False))


def _fields_of(names: tuple[str, ...], missing: bool) -> Column:
    """Sorted names that are missing, or that are there and unknown, as one text."""
    known, given = F.array(*[F.lit(n) for n in sorted(names)]), F.map_keys("fields")
    return F.array_join(F.array_except(known, given) if missing else F.array_sort(F.array_except(given, known)), ", ")


def record_rules(image_root: str) -> list[Rule]:
    """The rules on a decoded record, in order. A field that is missing breaks the first rule only. ``image_at``, ``format``,
    ``bytes`` and ``sha256`` describe its image."""
    missing, unknown = _fields_of(REQUIRED, True), _fields_of((*REQUIRED, *OPTIONAL), False)
    blank = [(f"{name}_text", f"{name} must be a non-empty string", has(name) & (kind_of(name) != "string")) for name in TEXT_FIELDS]
    answers = (kind_of("answers") == "list") & (F.size(items_of("answers")) == 3) & F.forall(items_of("answers"), lambda a: a["kind"] == "string")
    label, place, unsure = _small("expected_label"), _small("uncertainty_option_index"), kind_of("expected_is_uncertainty") == "boolean"
    chose = (text_of("expected_label") == text_of("uncertainty_option_index")).cast("string")
    listed = F.transform(items_of("subsets"), lambda s: F.when(s["kind"] == "string", s["text"]))
    subsets = (kind_of("subsets") == "list") & (F.size(listed) > 0) & F.forall(listed, lambda s: F.coalesce(s.isin(*SUBSETS), F.lit(False))) & (F.size(F.array_distinct(listed)) == F.size(listed))
    origin = F.lower(F.concat_ws(" ", text_of("source_uri_or_note"), text_of("image_ref")))
    marked = F.lit(False)
    for marker in FORBIDDEN_PROVENANCE:
        marked = marked | F.contains(origin, F.lit(marker))
    forbidden = has("source_uri_or_note") & has("image_ref") & marked
    reviewer, done = kind_of("reviewer_id"), _one_of("review_status", ("reviewed", "adjudicated"))
    same = F.coalesce((reviewer == "string") & (text_of("reviewer_id") == text_of("author_id")) & (kind_of("author_id") == "string"), F.lit(False))
    image = kind_of("image_ref") == "string"
    inside, held = paths.is_under(F.col("image_at"), image_root), F.col("bytes").isNotNull()
    sha, seed = kind_of("image_sha256"), kind_of("randomization_seed")

    def given(name: str, fits: Column) -> Column:
        return has(name) & ~F.coalesce(fits, F.lit(False))

    return [
        ("missing", F.concat(F.lit("missing fields: "), missing), missing != ""),
        ("unknown", F.concat(F.lit("unknown fields: "), unknown), unknown != ""),
        *blank,
        ("answers", "answers must contain exactly three non-empty strings", given("answers", answers)),
        ("labels", "expected_label and uncertainty_option_index must be 0, 1, or 2", given("expected_label", label) | given("uncertainty_option_index", place)),
        ("is_uncertainty", "expected_is_uncertainty is inconsistent with label/index", given("expected_is_uncertainty", unsure & (~label | ~place | (text_of("expected_is_uncertainty") == chose)))),
        ("subsets", "subsets must be a non-empty unique list of supported values", given("subsets", subsets)),
        ("provenance", "unsupported provenance_type", given("provenance_type", _one_of("provenance_type", PROVENANCES))),
        ("forbidden", "evaluation/test-derived provenance is forbidden", forbidden),
        ("review", "invalid review status or reviewer_id", given("review_status", _one_of("review_status", REVIEW_STATUSES)) | given("reviewer_id", reviewer.isin("string", "null"))),
        ("reviewer", "reviewed records require an independent reviewer", done & has("reviewer_id") & (same | (reviewer == "null"))),
        ("self_review", "generated authors cannot self-review", done & same & _one_of("provenance_type", ("synthetic", "generated_allowed"))),
        ("split", "split must be selection or sealed_holdout", given("split", _one_of("split", SPLITS))),
        *ladder(
            [
                ("image_escapes", "image_ref escapes image root", image & ~inside),
                ("image_missing", F.concat(F.lit("image does not exist: "), text_of("image_ref")), image & ~held),
                ("image_empty", "image is empty", image & (F.col("bytes") == 0)),
                ("image_corrupt", "image cannot be decoded", image & F.col("format").isNull()),
                ("image_hash", "image_sha256 does not match image bytes", image & has("image_sha256") & (sha != "null") & ~F.coalesce((sha == "string") & (text_of("image_sha256") == F.col("sha256")), F.lit(False))),
            ]
        ),
        ("seed", "randomization_seed must be an integer or null", has("randomization_seed") & ~seed.isin("integer", "null")),
    ]


def record_faults(lines: DataFrame, images: DataFrame, image_root: str, ordinal: str = "ordinal", line: str = "line") -> DataFrame:
    """(ordinal, faults, error) of every line: array<struct<code, message>> of all its faults, and their texts with the line's number.

    ``images`` holds path (absolute, resolved), format, bytes and sha256, one row for each file. A null line counts as blank.
    Blank lines, texts that are no JSON and values that are no object have that one fault. Repeated lines are judged each. The
    first fault is the one that a check which stops at the first would report.
    """
    body = F.coalesce(F.col(line), F.lit(""))
    found = typed_json(lines.select(F.struct(F.col(ordinal).alias("ordinal"), (strip(body) == "").alias("blank")).alias("at"), F.when(strip(body) != "", body).alias("body")), "at", F.col("body"))
    ref = F.when(kind_of("image_ref") == "string", paths.resolve(image_root, text_of("image_ref")))
    known = images.select(F.col("path").alias("image_path"), "format", "bytes", "sha256")
    found = found.withColumn("image_at", ref).join(known, F.col("image_at") == F.col("image_path"), "left")
    whole = [
        ("blank", "blank lines are not allowed", F.col("at.blank")),
        ("json", F.col("error"), F.col("error").isNotNull()),
        ("object", "record must be an object", F.col("root.kind") != "object"),
    ]
    faults = F.when(F.col("fields").isNull(), all_faults(whole)).otherwise(all_faults(record_rules(image_root)))
    number = F.col("at.ordinal")
    return found.select(number.alias(ordinal), faults.alias("faults")).withColumn("error", joined(F.col("faults"), F.concat(F.lit("line "), F.col(ordinal).cast("string"), F.lit(": "))))


def answer_lists(rows: DataFrame, row_id: str, raw: str) -> DataFrame:
    """(id, answers, error): three stripped answers from a JSON list, or what is wrong with it. Null counts as empty text, which is
    no JSON. Answers are judged in order: a string first, then not empty."""
    found = typed_json(rows, row_id, F.coalesce(F.col(raw), F.lit("")))
    items = F.col("root.items")
    each = [
        rule
        for k in range(3)
        for rule in (
            (f"answer_{k + 1}", f"answer {k + 1} must be a string", ~F.get(items, F.lit(k))["kind"].isin("string", "blank", "broken")),
            (f"answer_{k + 1}", f"answer {k + 1} is empty", F.get(items, F.lit(k))["kind"] == "blank"),
        )
    ]
    rules = ladder([
        ("json", F.concat(F.lit("has malformed answers JSON: "), "reason"), F.col("error").isNotNull()),
        ("list", "answers must be a JSON list", items.isNull()),
        ("count", F.concat(F.lit("must contain exactly 3 answers, found "), F.size(items).cast("string")), F.size(items) != 3),
        *each,
    ])
    faults = all_faults(rules)
    return found.select(row_id, F.when(F.size(faults) == 0, F.transform(items, lambda a: strip(a["text"]))).alias("answers"), joined(faults).alias("error"))
