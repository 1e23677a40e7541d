"""JSON with its types: what each key holds, lists and nulls included."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.batches import pieces
from sluicework.operators.parsing import strict_object

_ITEM = pa.struct([("kind", pa.string()), ("text", pa.string())])
_VALUE = pa.struct([("kind", pa.string()), ("text", pa.string()), ("items", pa.list_(_ITEM))])
_ITEM_TYPE = "struct<kind:string,text:string>"
_VALUE_TYPE = f"struct<kind:string,text:string,items:array<{_ITEM_TYPE}>>"


def _safe(text: str) -> str:
    return text.encode("utf-8", "backslashreplace").decode()


def _item(value) -> dict:
    """Kind and text of a value: string, blank (a string of white space only), broken (a string that is no Unicode text),
    boolean, integer, number, null, list or object; the text of the last two is compact JSON with sorted keys."""
    if isinstance(value, str):
        kind = "broken" if _safe(value) != value else "string" if value.strip() else "blank"
        return {"kind": kind, "text": _safe(value)}
    if value is None:
        return {"kind": "null", "text": None}
    if isinstance(value, bool):
        return {"kind": "boolean", "text": str(value).lower()}
    if isinstance(value, (int, float)):
        return {"kind": "integer" if isinstance(value, int) else "number", "text": repr(value)}
    kind = "list" if isinstance(value, list) else "object"
    return {"kind": kind, "text": _safe(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))}


def _value(value) -> dict:
    return _item(value) | {"items": [_item(x) for x in value] if isinstance(value, list) else None}


def _loose(text: str):
    """(error, reason, value) of plain JSON: the last of repeated keys counts, NaN and infinities are numbers."""
    try:
        return None, None, json.loads(text)
    except json.JSONDecodeError as e:
        return str(e), e.msg, None
    except (ValueError, RecursionError) as e:
        return str(e), str(e), None


def typed_json(rows: DataFrame, row_id: str, body: Column, strict: bool = False) -> DataFrame:
    """(``row_id``, error, reason, root, fields): the ``root`` value's kind, text and items, and for an object the same of each key.

    A text that is no JSON has an ``error`` (with the place) and a ``reason`` (without it), and a null root; a null body has all null.
    With ``strict``, repeated keys, NaN and infinities are errors, and only objects have a root. Decoding runs in Python, in
    Arrow batches, as nothing built in tells 1 from "1" and 1.0; whatever is asked of the values is a column expression.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            errors, reasons, roots, fields = [], [], [], []
            for text in batch.column(1).to_pylist():
                error = reason = found = None
                if text is not None and strict:
                    error, found = strict_object(text)
                    reason = error
                elif text is not None:
                    error, reason, found = _loose(text)
                known = text is not None and error is None and not (strict and found is None)
                errors.append(None if error is None else _safe(error))
                reasons.append(None if reason is None else _safe(reason))
                roots.append(_value(found) if known else None)
                fields.append([(_safe(k), _value(v)) for k, v in found.items()] if isinstance(found, dict) else None)
            columns = [batch.column(0), pa.array(errors, pa.string()), pa.array(reasons, pa.string()), pa.array(roots, _VALUE), pa.array(fields, pa.map_(pa.string(), _VALUE))]
            yield pa.RecordBatch.from_arrays(columns, names=[row_id, "error", "reason", "root", "fields"])

    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(row_id, body.alias("body")).mapInArrow(decode, f"`{row_id}` {kind}, error string, reason string, root {_VALUE_TYPE}, fields map<string,{_VALUE_TYPE}>")


def kind_of(key: str) -> Column:
    """The kind of a key's value; null if the key is not there."""
    return F.col("fields")[key]["kind"]


def text_of(key: str) -> Column:
    return F.col("fields")[key]["text"]


def items_of(key: str) -> Column:
    return F.col("fields")[key]["items"]


def has(key: str) -> Column:
    return F.coalesce(F.map_contains_key("fields", key), F.lit(False))
