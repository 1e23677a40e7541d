"""Text normalisers and phrase tests as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    """Lower case (with ß as ss), runs of anything but letters, digits and underscores to one space, trimmed; an underscore
    counts as a space."""
    lowered = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", " "))


def has_phrase(normal: Column, phrase: str) -> Column:
    """Whether normalised text holds a normalised phrase between word borders."""
    return F.contains(F.concat(F.lit(" "), normal, F.lit(" ")), F.lit(f" {phrase} "))


def has_any(normal: Column, phrases: Iterable[str]) -> Column:
    """Whether normalised text holds one of several normalised phrases; one pattern for all."""
    return F.concat(F.lit(" "), normal, F.lit(" ")).rlike(f" (?:{'|'.join(phrases)}) ")


def reason_snippet(text: Column, length: int = 200) -> Column:
    """What stands after the last "Reasoning:" and before the first "Answer:" that follows, at most ``length`` characters."""
    return F.substring(strip(F.substring_index(F.substring_index(text, "Reasoning:", -1), "Answer:", 1)), 1, length)


def preview(text: Column, length: int = 200) -> Column:
    """The start of a text on one line."""
    return F.substring(F.replace(strip(text), F.lit("\n"), F.lit(" ")), 1, length)


def selection_key(seed: int, source: Column, row_id: Column) -> Column:
    """Hex SHA-256 of seed:source:id, by which deterministic samples are ordered."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), source, row_id.cast("string")), 256)
