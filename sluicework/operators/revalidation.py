"""Artifacts read again: every value of a row with its type, and every fault, not only the first.

The texts of faults are fixed values of the contracts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.text import strip
from sluicework.operators.parsing import EVIDENCE_TYPES, VERSION
from sluicework.operators.rules import Rule, all_faults, joined, ladder
from sluicework.operators.triggers import TRIGGERS
from sluicework.operators.typed import items_of, kind_of, text_of, typed_json
from sluicework.operators.verification import IMAGE_STATUSES, PARSE_STATUSES, contract_violation

#: The fields of a verification record, in order, and the outcomes of a verification.
VERIFICATION_FIELDS = (
    "run_id", "sample_id", "prompt_version", "triggers", "requires_verification", "before_label", "raw_verifier_output", "after_label", "verifier_reason", "verifier_evidence_type",
    "reasoner_defect_found", "objective_support", "image_status", "verifier_parse_status", "generation_metadata", "model_load_metadata", "elapsed_seconds", "status", "error_type", "error_message",
)
STATUSES = ("verified", "skipped_not_triggered", "image_failed", "prompt_failed", "inference_failed", "parse_failed")
LABELS = ("0", "1", "2")
#: The header of parsed answers, and what their columns may hold.
ANSWER_COLUMNS = ("run_id", "sample_id", "parsed_label", "uncertainty_option_index", "evidence_summary", "evidence_type", "uncertainty_signal", "risk_flags", "schema_version", "parse_status", "parse_error")
ANSWER_STATUSES = ("valid", "source_failed", "missing_marker", "invalid_json", "invalid_schema", "invalid_label")
RISK_FLAGS = ("invalid_parse", "protected_attribute_risk")


def _false(test: Column) -> Column:
    """Whether a test does not hold; null does not."""
    return ~F.coalesce(test, F.lit(False))


def _or_null(key: str, test: Column) -> Column:
    return (kind_of(key) == "null") | test


def _trimmed(key: str) -> Column:
    """A string that is not blank and has no white space at its ends."""
    return (kind_of(key) == "string") & (strip(text_of(key)) == text_of(key))


def _among(key: str, values: tuple[str, ...]) -> Column:
    return (kind_of(key) == "string") & text_of(key).isin(*values)


def _trigger_rules() -> list[Rule]:
    names = F.transform(items_of("triggers"), lambda i: i["text"])
    strings = (kind_of("triggers") == "list") & F.forall(items_of("triggers"), lambda i: i["kind"].isin("string", "blank"))
    canonical = F.filter(F.array(*[F.lit(t) for t in TRIGGERS]), lambda t: F.array_contains(names, t))
    return ladder([
        ("triggers", "triggers must be a JSON string array", _false(strings)),
        ("triggers", "triggers contains duplicate", F.size(F.array_distinct(names)) != F.size(names)),
        ("triggers", "triggers contains unsupported values", F.size(F.array_except(names, F.array(*[F.lit(t) for t in TRIGGERS]))) > 0),
        ("triggers", "triggers must use deterministic ordering", ~names.eqNullSafe(canonical)),
    ])


def _field_rules() -> list[Rule]:
    """The rules on single fields, in the order of the fields."""
    seconds = text_of("elapsed_seconds").try_cast("double")
    number = kind_of("elapsed_seconds").isin("integer", "number")
    text, boolean = "{} must be a non-empty string", "{} must be a boolean"
    single: dict[str, tuple[str, Column]] = {k: (text, _trimmed(k)) for k in ("run_id", "sample_id", "prompt_version")}
    single["requires_verification"] = (boolean, kind_of("requires_verification") == "boolean")
    single |= {k: (text, _or_null(k, _trimmed(k))) for k in ("raw_verifier_output", "verifier_reason", "error_type", "error_message")}
    single |= {k: ("{} must be exactly 0, 1, or 2", _or_null(k, _among(k, LABELS))) for k in ("before_label", "after_label")}
    single |= {k: (boolean, _or_null(k, kind_of(k) == "boolean")) for k in ("reasoner_defect_found", "objective_support")}
    single |= {k: ("{} is invalid", _or_null(k, _among(k, v))) for k, v in (("image_status", IMAGE_STATUSES), ("verifier_parse_status", PARSE_STATUSES))}
    single |= {k: ("{} must be an object or null", kind_of(k).isin("object", "null")) for k in ("generation_metadata", "model_load_metadata")}
    single["verifier_evidence_type"] = ("{} is unsupported", _or_null("verifier_evidence_type", _among("verifier_evidence_type", EVIDENCE_TYPES)))
    single["status"] = ("{} is invalid", _among("status", STATUSES))
    rules: list[Rule] = []
    for k in VERIFICATION_FIELDS:
        if k == "triggers":
            rules += _trigger_rules()
        elif k == "elapsed_seconds":
            bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
            rules += ladder([(k, f"{k} must be a number", _false(number)), (k, f"{k} must be non-negative", number & bad)])
        else:
            message, fits = single[k]
            rules.append((k, message.format(k), _false(fits)))
    return rules


def _typed_record() -> list[Column]:
    """The fields of a sound record, each of its own type; objects stay as compact JSON."""
    found = []
    for k in VERIFICATION_FIELDS:
        if k == "triggers":
            value = F.transform(items_of(k), lambda i: i["text"])
        elif k == "elapsed_seconds":
            value = text_of(k).try_cast("double")
        elif k in ("requires_verification", "reasoner_defect_found", "objective_support"):
            value = F.when(kind_of(k) == "boolean", text_of(k) == "true")
        else:
            value = F.when(kind_of(k) != "null", text_of(k))
        found.append(value.alias(k))
    return found


def read_verifications(lines: DataFrame, run_id: str, ordinal: str = "ordinal", line: str = "line") -> DataFrame:
    """(ordinal, record, faults, error): the typed record of every line of a verification artifact, and all its faults in order.

    A line that is blank, no strict JSON, no object, or has not exactly the twenty fields, has that fault alone and a null
    record. Rules that compare fields apply where every field alone is sound. Then come another run's id, and a sample that an
    earlier line has. ``error`` is the first fault with the line's number, null for a sound line. Null lines are blank.
    """
    body = F.coalesce(F.col(line), F.lit(""))
    blank = strip(body) == ""
    staged = lines.select(F.struct(F.col(ordinal).alias("ordinal"), blank.alias("blank")).alias("at"), F.when(~blank, body).alias("body"))
    found = typed_json(staged, "at", F.col("body"), strict=True)
    said = F.regexp_replace(F.regexp_replace("error", "^duplicate key: ", "duplicate JSON key "), "^non-standard JSON constant: ", "unsupported JSON constant ")
    given, wanted = F.array_sort(F.map_keys("fields")), F.array(*[F.lit(k) for k in sorted(VERIFICATION_FIELDS)])
    whole = ladder([
        ("blank", "blank", F.col("at.blank")),
        ("json", F.concat(F.lit("is malformed JSON: "), said), F.col("error").isNotNull()),
        ("object", "must be a JSON object", F.col("fields").isNull()),
        ("fields", "fields must be exactly: " + ", ".join(VERIFICATION_FIELDS), given != wanted),
    ])
    found = found.withColumn("whole", all_faults(whole))
    shaped = F.size("whole") == 0
    found = found.select("at", "whole", F.when(shaped, F.struct(*_typed_record())).alias("record"), F.when(shaped, all_faults(_field_rules())).otherwise(F.array().cast("array<struct<code:string,message:string>>")).alias("single"))
    rows = found.select("at", "whole", "record", "single", "record.*")
    broken = F.when(F.col("record").isNotNull() & (F.size("single") == 0), contract_violation())
    rows = rows.select(F.col("at.ordinal").alias("o"), "whole", "record", "single", F.col("record.run_id").alias("run"), F.col("record.sample_id").alias("sample"), broken.alias("contract"))
    first = rows.filter(F.col("sample").isNotNull()).groupBy("sample").agg(F.min("o").alias("first"))
    rows = rows.join(first, "sample", "left")
    more = all_faults([
        ("contract", F.col("contract"), F.col("contract").isNotNull()),
        ("run", "run_id does not match expected run_id", F.col("run") != run_id),
        ("duplicate", F.concat(F.lit("duplicate sample_id: "), "sample"), F.col("o") > F.col("first")),
    ])
    faults = F.concat("whole", "single", more)
    head, number = F.try_element_at(faults, F.lit(1)), F.col("o").cast("string")
    error = (
        F.when(head["code"] == "blank", F.concat(F.lit("verification artifact contains blank logical record "), number))
        .when(head["code"] == "duplicate", F.concat(F.lit("verification artifact has "), head["message"]))
        .otherwise(F.concat(F.lit("verification row "), number, F.lit(" "), head["message"]))
    )
    return rows.select(F.col("o").alias(ordinal), "record", faults.alias("faults"), error.alias("error"))


def canonical_list(texts: Column) -> Column:
    """The one JSON text of a list of plain strings: no blanks, in order."""
    return F.concat(F.lit("["), F.array_join(F.transform(texts, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ","), F.lit("]"))


def _flag_rules() -> list[Rule]:
    """Flags are a JSON list of known names, each once, and written in the one canonical way."""
    items, names = F.col("root.items"), F.transform("root.items", lambda i: i["text"])
    known = F.forall(items, lambda i: (i["kind"] == "string") & i["text"].isin(*RISK_FLAGS))
    return ladder([
        ("flags", F.concat(F.lit("risk_flags is invalid JSON: "), "flags_error"), F.col("flags_error").isNotNull()),
        ("flags", "has invalid risk_flags", _false(known)),
        ("flags", "has duplicate risk_flags", F.size(F.array_distinct(names)) != F.size(names)),
        ("flags", "risk_flags must use deterministic JSON encoding", F.col("row")["risk_flags"] != canonical_list(names)),
    ])


def reread_answers(rows: DataFrame, run_id: str, number: str = "number", row: str = "row") -> DataFrame:
    """(number, faults, error) of every row of a parsed answer artifact: ``row`` maps column to text, absent or null being empty.

    A row that failed carries an error and nothing else, a valid one carries everything and no error; flags are canonical and
    say the same as the status. Each repeated sample but the first is a fault. All faults in order; ``error`` is the first.
    """
    flags = F.coalesce(F.col(row)["risk_flags"], F.lit(""))
    at = F.struct(F.col(number).alias("number"), F.map_filter(row, lambda k, v: v.isNotNull()).alias("row"))
    found = typed_json(rows.select(at.alias("at"), flags.alias("flags")), "at", F.col("flags"))
    found = found.select(F.col("at.number").alias("n"), F.col("at.row").alias("row"), "root", F.col("error").alias("flags_error"))

    def v(name: str) -> Column:
        return F.coalesce(F.col("row")[name], F.lit(""))

    first = found.filter(strip(v("sample_id")) != "").groupBy(v("sample_id").alias("sample")).agg(F.min("n").alias("first"))
    found = found.join(first, v("sample_id") == F.col("sample"), "left")
    flagged = F.coalesce(F.exists("root.items", lambda i: (i["kind"] == "string") & (i["text"] == "invalid_parse")), F.lit(False))
    status, sound = v("parse_status"), F.col("flags_error").isNull() & F.col("root.items").isNotNull()
    failed = (status != "valid") | flagged
    chose = v("parsed_label") == v("uncertainty_option_index")
    carried = F.lit(False)
    for k in ("parsed_label", "evidence_summary", "evidence_type", "uncertainty_signal", "uncertainty_option_index", "schema_version"):
        carried = carried | (v(k) != "")
    domains = {"parsed_label": LABELS, "evidence_summary": None, "evidence_type": EVIDENCE_TYPES, "uncertainty_signal": ("true", "false"), "uncertainty_option_index": LABELS, "schema_version": (VERSION,)}
    valid: list[Rule] = [(k, f"has invalid {k}", ~failed & ((strip(v(k)) == "") if values is None else ~v(k).isin(*values))) for k, values in domains.items()]
    unsure = v("evidence_type") == "insufficient_evidence"
    in_domain = v("parsed_label").isin(*LABELS) & v("uncertainty_option_index").isin(*LABELS)
    rules: list[Rule] = [
        ("run_id", "run_id must be a non-empty string", strip(v("run_id")) == ""),
        ("sample_id", "sample_id must be a non-empty string", strip(v("sample_id")) == ""),
        ("run", F.concat(F.lit("run_id '"), v("run_id"), F.lit(f"' does not match expected run_id '{run_id}'")), (strip(v("run_id")) != "") & (v("run_id") != run_id)),
        ("duplicate", F.concat(F.lit("duplicate sample_id: "), v("sample_id")), F.col("n") > F.col("first")),
        ("status", "has invalid parse_status", ~status.isin(*ANSWER_STATUSES)),
        *_flag_rules(),
        ("unflagged", "non-valid state requires invalid_parse", sound & (status != "valid") & ~flagged),
        ("flagged", "valid state must not carry invalid_parse", (status == "valid") & flagged),
        ("no_error", "non-valid state requires parse_error", failed & (strip(v("parse_error")) == "")),
        ("carried", "invalid state must not carry valid fields", failed & carried),
        *valid,
        ("uncertainty", "has inconsistent uncertainty", ~failed & in_domain & v("uncertainty_signal").isin("true", "false") & ((v("uncertainty_signal") == "true") != chose)),
        ("evidence", "has inconsistent evidence_type", ~failed & in_domain & v("evidence_type").isin(*EVIDENCE_TYPES) & (chose != unsure)),
        ("has_error", "valid state has parse_error", ~failed & (v("parse_error") != "")),
    ]
    out = found.select(F.col("n").alias(number), all_faults(rules).alias("faults"))
    head, at_row = F.try_element_at("faults", F.lit(1)), F.col(number).cast("string")
    alone = head["code"].isin("run_id", "sample_id")
    error = F.when(alone, head["message"]).when(head["code"] == "duplicate", F.concat(F.lit("parsed Reasoner artifact has "), head["message"])).otherwise(F.concat(F.lit("parsed Reasoner row "), at_row, F.lit(" "), head["message"]))
    return out.withColumn("error", error)


def all_messages(faults: Column) -> Column:
    """Every fault's text, joined; null without one."""
    return joined(faults)
