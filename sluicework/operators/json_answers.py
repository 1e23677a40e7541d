"""Labels out of a final JSON line, with a diagnostic fallback and warnings where the contract is not kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.text import strip
from sluicework.operators.answers import DIGIT, unknown_index
from sluicework.operators.parsing import last_line
from sluicework.operators.typed import kind_of, text_of, typed_json

#: Fixed value: where the JSON stands in the last line.
FINAL = r"(?sU)FINAL_ANSWER_JSON\s*:\s*(\{.*\})\s*$"


def _shown(key: str) -> Column:
    """A value as messages write it: strings quoted, None, True and False; lists and objects as compact JSON."""
    kind, text = kind_of(key), text_of(key)
    return F.when(kind.isNull() | (kind == "null"), "None").when(kind.isin("string", "blank"), F.concat(F.lit("'"), text, F.lit("'"))).when(kind == "boolean", F.initcap(text)).otherwise(text)


def _truthy(key: str) -> Column:
    """Whether a value counts as true: not empty, not zero."""
    kind, text = kind_of(key), text_of(key)
    return F.when(kind.isin("integer", "number"), F.coalesce(text.try_cast("double") != 0, F.lit(True))).when(kind == "boolean", text == "true").otherwise(~text.isin("", "[]", "{}"))


def final_answers(rows: DataFrame, row_id: str, output: str, options: str) -> DataFrame:
    """(id, label, method, error) of every output with its options.

    The last line that is not blank should hold the JSON. Methods: empty; final_json; final_json_contract_warning, where the
    label counts but the option index is not that of the uncertainty option, or the signal says otherwise; invalid_label;
    json_decode_error; digit_fallback, the last lone digit of an output without the JSON, for diagnosis only; parse_failed. A
    label may be a whole number; true is none. Null output is empty. Repeated rows give a row each.
    """
    text = F.coalesce(F.col(output), F.lit(""))
    body = F.nullif(F.regexp_extract(strip(F.coalesce(last_line(text), F.lit(""))), FINAL, 1), F.lit(""))
    digit = F.try_element_at(F.regexp_extract_all(text, F.lit(DIGIT), F.lit(1)), F.lit(-1))
    known = F.struct(F.col(row_id).alias("id"), (text == "").alias("empty"), digit.alias("digit"), unknown_index(F.col(options)).alias("unknown"))
    found = typed_json(rows.select(known.alias("at"), body.alias("body")), "at", F.col("body"))
    kind = kind_of("label")
    label = F.when(kind.isin("string", "integer") & text_of("label").isin("0", "1", "2"), text_of("label")).cast("int")
    said = F.when(kind == "boolean", F.concat(F.lit("'"), _shown("label"), F.lit("'"))).when(kind == "integer", F.concat(F.lit("'"), text_of("label"), F.lit("'"))).otherwise(_shown("label"))
    index = F.when(kind_of("uncertainty_option_index") == "boolean", text_of("uncertainty_option_index").try_cast("boolean").cast("double")).when(kind_of("uncertainty_option_index").isin("integer", "number"), text_of("uncertainty_option_index").try_cast("double"))
    unknown = F.col("at.unknown")
    other = ~index.eqNullSafe(unknown.cast("double"))
    signal = kind_of("uncertainty_signal")
    mismatch = signal.isNotNull() & (signal != "null") & (_truthy("uncertainty_signal") != (label == unknown))
    warnings = F.array_join(F.array_compact(F.array(
        F.when(other, F.concat(F.lit("uncertainty_option_index "), _shown("uncertainty_option_index"), F.lit(" != expected "), unknown.cast("string"))),
        F.when(mismatch, F.lit("uncertainty_signal mismatch")),
    )), "; ")

    def out(method: str, label: Column | None, error: Column | None) -> Column:
        nothing = F.lit(None)
        return F.struct((nothing.cast("int") if label is None else label).alias("label"), F.lit(method).alias("method"), (nothing.cast("string") if error is None else error).alias("error"))

    missing = F.lit("missing FINAL_ANSWER_JSON")
    result = (
        F.when(F.col("at.empty"), out("empty", None, F.lit("empty response")))
        .when(F.col("error").isNotNull(), out("json_decode_error", None, F.col("error")))
        .when(F.col("fields").isNull() & F.col("at.digit").isNotNull(), out("digit_fallback", F.col("at.digit").cast("int"), missing))
        .when(F.col("fields").isNull(), out("parse_failed", None, missing))
        .when(label.isNull(), out("invalid_label", None, F.concat(F.lit("invalid label: "), said)))
        .when(warnings == "", out("final_json", label, None))
        .otherwise(out("final_json_contract_warning", label, warnings))
    )
    return found.select(F.col("at.id").alias(row_id), result.alias("r")).select(row_id, "r.*")
