"""Strict parsing of the answer line that ends a model's output."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.batches import pieces
from sluicework.functions.text import strip

#: Fixed values of the output contract.
MARKER = "FINAL_ANSWER_JSON:"
VERSION = "reasoner_output_v3"
EVIDENCE_TYPES = ("stated_text_fact", "objective_visible_evidence", "elimination", "insufficient_evidence")
KEYS_V2 = ("label", "evidence", "evidence_type", "uncertainty_signal", "protected_attribute_risk")
KEYS_V3 = (*KEYS_V2, "uncertainty_option_index", "schema_version")
#: What ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def last_line(text: Column) -> Column:
    """The last line that is not blank; null without one."""
    return F.try_element_at(F.filter(F.split(text, LINE_ENDS), lambda x: x.rlike(r"(?U)\S")), F.lit(-1))


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        keys = [k for k, _ in pairs]
        raise ValueError(f"duplicate key: {next(k for at, k in enumerate(keys) if k in keys[:at])!r}")
    return out


def _no_constant(name: str):
    raise ValueError(f"non-standard JSON constant: {name}")


def strict_object(text: str) -> tuple[str | None, dict | None]:
    """(error, object): one JSON value and nothing else, without repeated keys, NaN or infinities; the object is None if the
    value is none."""
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        return str(e), None
    return None, value if isinstance(value, dict) else None


def _plain(text: str) -> str:
    return text.encode("utf-8", "backslashreplace").decode()


def value_kind(value) -> tuple[str, str]:
    """Kind and text of a JSON value: a string, or a blank one, a boolean, an integer, or anything else."""
    if isinstance(value, str) and _plain(value) == value:
        return ("string" if value.strip() else "blank"), value
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    return ("integer", str(value)) if isinstance(value, int) else ("other", "")


_TEXTS = pa.map_(pa.string(), pa.string())


def decoded(rows: DataFrame, row_id: str, output: str, marker: str) -> DataFrame:
    """``decoded_json`` of what stands behind ``marker`` at the start of the last line of ``output``."""
    line = last_line(F.coalesce(F.col(output), F.lit("")))
    return decoded_json(rows, row_id, F.when(F.startswith(line, F.lit(marker)), F.substring(line, len(marker) + 1, 2**31 - 1)))


def decoded_json(rows: DataFrame, row_id: str, body: Column) -> DataFrame:
    """``row_id``, whether there is a body (``marked``), the ``error`` if it is no strict JSON, and the ``kinds`` and ``texts`` of
    its keys, null if it is no object.

    The JSON goes through Python, in Arrow batches, because no built-in function rejects repeated keys, trailing text and
    numbers for strings at once. The rules on the values are column expressions.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            errors, kinds, texts = [], [], []
            for text in batch.column(1).to_pylist():
                error, found = strict_object(text) if text is not None else (None, None)
                pairs = None if found is None else [(_plain(k), *value_kind(v)) for k, v in found.items()]
                errors.append(None if error is None else _plain(error))
                kinds.append(pairs and [(k, kind) for k, kind, _ in pairs] if pairs != [] else [])
                texts.append(pairs and [(k, value) for k, _, value in pairs] if pairs != [] else [])
            marked = pa.array([x is not None for x in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), marked, pa.array(errors, pa.string()), pa.array(kinds, _TEXTS), pa.array(texts, _TEXTS)], names=[row_id, "marked", "error", "kinds", "texts"])

    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(row_id, body.alias("body")).mapInArrow(decode, f"`{row_id}` {kind}, marked boolean, error string, kinds map<string,string>, texts map<string,string>")


def _is(key: str, kind: str, *values: str) -> Column:
    """Whether the value of a key is of a kind, and one of some values."""
    fits = F.coalesce(F.col("kinds")[key] == kind, F.lit(False))
    return fits & F.col("texts")[key].isin(*values) if values else fits


def _key_faults(required: Sequence[str]) -> Column:
    """What is missing and what is too much, or null."""
    wanted = F.array(*[F.lit(k) for k in sorted(required)])
    given = F.map_keys("kinds")
    missing, extra = F.array_except(wanted, given), F.array_sort(F.array_except(given, wanted))
    parts = [F.when(F.size(x) > 0, F.concat(F.lit(f"{name} fields: "), F.array_join(x, ", "))) for name, x in (("missing", missing), ("extra", extra))]
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def first_fault(rules: Sequence[tuple[str, Column | str, Column]]) -> Column:
    """struct(status, error) of the first rule that fails, in order; null if none does. A null test is false."""
    return F.coalesce(*[F.when(test, F.struct(F.lit(status).alias("status"), (F.lit(error) if isinstance(error, str) else error).alias("error"))) for status, error, test in rules])


_TYPES = f"evidence_type must be one of: {', '.join(EVIDENCE_TYPES)}"


def answer_rules(v3: bool) -> list[tuple[str, Column | str, Column]]:
    """The rules on a decoded answer, in order; messages are fixed values of the contract."""
    faults = _key_faults(KEYS_V3 if v3 else KEYS_V2)
    text = F.col("texts")
    chose = text["label"] == text["uncertainty_option_index"]
    unsure, decisive = text["uncertainty_signal"] == "true", text["evidence_type"] != "insufficient_evidence"
    rules = [
        ("missing_marker", f"final non-empty line must start with {MARKER}", ~F.col("marked")),
        ("invalid_json", F.concat(F.lit("final answer JSON is invalid: "), "error"), F.col("error").isNotNull()),
        ("invalid_schema", "final answer must be a JSON object", F.col("kinds").isNull()),
        ("invalid_schema", faults, faults.isNotNull()),
        ("invalid_label", "label must be exactly one of: 0, 1, 2", ~_is("label", "string", "0", "1", "2")),
        ("invalid_schema", "evidence must be a non-empty string", ~_is("evidence", "string")),
        ("invalid_schema", _TYPES, ~_is("evidence_type", "string", *EVIDENCE_TYPES)),
        *[("invalid_schema", f"{k} must be a JSON boolean", ~_is(k, "boolean")) for k in ("uncertainty_signal", "protected_attribute_risk")],
    ]
    if v3:
        rules += [
            ("invalid_schema", "uncertainty_option_index must be a JSON integer from 0 through 2", ~_is("uncertainty_option_index", "integer", "0", "1", "2")),
            ("invalid_schema", f"schema_version must be exactly {VERSION}", ~_is("schema_version", "string", VERSION)),
            ("invalid_schema", "uncertainty_signal must equal label == uncertainty_option_index", unsure != chose),
            ("invalid_schema", "uncertainty selection requires insufficient_evidence", chose & decisive),
            ("invalid_schema", "decisive selection requires decisive evidence", ~chose & ~decisive),
        ]
    return rules


def source_failure(status: Column, error_type: Column, error_message: Column) -> Column:
    """What a source that failed says of itself: its status, then the parts of its error that are not blank."""
    parts = [F.nullif(strip(c), F.lit("")) for c in (error_type, error_message)]
    return F.concat_ws(": ", F.concat(F.lit("raw Reasoner status is "), status), *parts)


def parse_outputs(rows: DataFrame, row_id: str, output: str, source_ok: Column, v3: bool = True, failure: Column | None = None) -> DataFrame:
    """(id, parse_status, fields, parse_error) of every model output.

    A source that failed, or gave no output, is settled without looking at it; ``failure`` says why. Errors name the sample;
    fields are null unless the status is valid.
    """
    said = F.when(~F.coalesce(source_ok, F.lit(False)), F.lit("raw Reasoner failed") if failure is None else failure)
    failed = ~F.coalesce(source_ok, F.lit(False)) | F.col(output).isNull()
    staged = rows.select(F.struct(F.col(row_id).alias("id"), failed.alias("failed"), said.alias("said")).alias("source"), F.when(~failed, F.col(output)).alias("output"))
    found = decoded(staged, "source", "output", MARKER)
    fault = first_fault(answer_rules(v3))
    schema = F.when(fault["status"] == "invalid_schema", F.lit("final answer schema is invalid: ")).otherwise(F.lit(""))
    failed, name = F.col("source.failed"), F.concat(F.lit("sample "), F.col("source.id").cast("string"), F.lit(" "))
    valid = ~failed & fault.isNull()

    def field(key: str, kind: str, alias: str) -> Column:
        return F.when(valid, F.col("texts")[key]).cast(kind).alias(alias)

    return found.select(
        F.col("source.id").alias(row_id),
        F.when(failed, "source_failed").otherwise(F.coalesce(fault["status"], F.lit("valid"))).alias("parse_status"),
        field("label", "string", "label"),
        field("evidence", "string", "evidence"),
        field("evidence_type", "string", "evidence_type"),
        field("uncertainty_signal", "boolean", "uncertainty_signal"),
        field("protected_attribute_risk", "boolean", "protected_attribute_risk"),
        field("uncertainty_option_index", "int", "option_index"),
        F.when(failed, F.concat(name, F.coalesce("source.said", F.lit("generated row is missing string raw_output")))).otherwise(F.concat(name, schema, fault["error"])).alias("parse_error"),
    )


#: Fixed values of the verifier's contract.
VERIFIER_MARKER = "FINAL_VERIFICATION_JSON:"
VERIFIER_KEYS = ("label", "reason", "evidence_type", "reasoner_defect_found", "objective_support")


def verifier_rules() -> list[tuple[str, Column | str, Column]]:
    """The rules on a decoded verification, in order; messages are fixed values of the contract."""
    faults = _key_faults(VERIFIER_KEYS)
    text = F.col("texts")
    decisive, supported = text["evidence_type"] != "insufficient_evidence", text["objective_support"] == "true"
    return [
        ("missing_marker", f"final non-empty line must start with {VERIFIER_MARKER}", ~F.col("marked")),
        ("invalid_json", F.concat(F.lit("Verifier JSON is invalid: "), "error"), F.col("error").isNotNull()),
        ("invalid_schema", "Verifier answer must be an object", F.col("kinds").isNull()),
        ("invalid_schema", faults, faults.isNotNull()),
        ("invalid_label", "label must be exactly 0, 1, or 2", ~_is("label", "string", "0", "1", "2")),
        ("invalid_schema", "reason must be a non-empty string", ~_is("reason", "string")),
        ("invalid_schema", _TYPES, ~_is("evidence_type", "string", *EVIDENCE_TYPES)),
        *[("invalid_schema", f"{k} must be a JSON boolean", ~_is(k, "boolean")) for k in ("reasoner_defect_found", "objective_support")],
        ("invalid_schema", "label 2 requires insufficient evidence without objective support", (text["label"] == "2") & (decisive | supported)),
        ("invalid_schema", "person labels require decisive evidence and objective support", (text["label"] != "2") & (~decisive | ~supported)),
    ]


def parse_verifications(rows: DataFrame, row_id: str, output: str) -> DataFrame:
    """(id, parse_status, label, reason, evidence_type, reasoner_defect_found, objective_support, parse_error) of every verifier
    output; null counts as empty. Fields are null unless the status is valid."""
    found = decoded(rows, row_id, output, VERIFIER_MARKER)
    fault = first_fault(verifier_rules())
    fields = [F.when(fault.isNull(), F.col("texts")[k]).cast(t).alias(k) for k, t in zip(VERIFIER_KEYS, ("string",) * 3 + ("boolean",) * 2, strict=True)]
    return found.select(row_id, F.coalesce(fault["status"], F.lit("valid")).alias("parse_status"), *fields, fault["error"].alias("parse_error"))


def first_object(rows: DataFrame, row_id: str, output: str) -> DataFrame:
    """(id, found): the first JSON object in every output, as compact JSON with sorted keys, null without one.

    For outputs with wrapping text: the search begins behind the last marker, or at the start without one, and tries every
    brace in turn. Python in Arrow batches, as nothing built in decodes a prefix.
    """

    def search(text: str | None) -> str | None:
        text = (text or "").rpartition(MARKER)[2]
        at = text.find("{")
        while at >= 0:
            try:
                value, _ = json.JSONDecoder().raw_decode(text, at)
                return _plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            except (ValueError, RecursionError):
                at = text.find("{", at + 1)
        return None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(search, batch.column(1).to_pylist())), pa.string())], names=[row_id, "found"])

    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(row_id, output).mapInArrow(find, f"`{row_id}` {kind}, found string")
