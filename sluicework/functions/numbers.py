"""Numeric text as a permissive reader takes it: padding, underscores between digits, digits of all scripts, nan and inf."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions.text import strip

_DIGITS = "[0-9]++(?:_[0-9]++)*+"  # possessive, so that long ones take no stack
INTEGER = f"^[+-]?{_DIGITS}$"
FLOAT = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
SPECIAL = r"(?i)^[+-]?(?:nan|inf|infinity)$"
#: Digits of an integer beyond which it is no number.
MOST_DIGITS = 4300


@lru_cache(maxsize=1)
def _other_digits() -> tuple[str, str]:
    """Every decimal digit beyond ASCII, and the ASCII digit of the same value."""
    found = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def _plain(text: Column) -> Column:
    """Without padding, with ASCII digits."""
    return F.translate(strip(text), *_other_digits())


def permissive_float(text: Column) -> Column:
    """The number a text stands for, as a double: nan and infinities included, out of range being infinite or 0. Null if it is
    none, or null."""
    plain = _plain(text)
    sign = F.when(F.startswith(plain, F.lit("-")), -1.0).otherwise(1.0)
    special = F.when(F.lower(plain).endswith("nan"), F.lit(float("nan"))).otherwise(sign * float("inf"))
    return F.when(plain.rlike(FLOAT), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double")).when(plain.rlike(SPECIAL), special)


def permissive_integer(text: Column) -> Column:
    """The whole number a text stands for, without leading zeros, as text, as it may have any length. Null if it is none."""
    plain = _plain(text)
    digits = F.regexp_replace(plain, "[^0-9]", "")
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    negative = F.startswith(plain, F.lit("-")) & (short != "0")
    return F.when(plain.rlike(INTEGER) & (F.length(digits) <= MOST_DIGITS), F.concat(F.when(negative, "-").otherwise(""), short))


def box_outcome(group: Column, depiction: Column, corners: tuple[Column, Column, Column, Column], least: float = 0.01) -> Column:
    """What becomes of an annotated box from the texts of its fields: eligible; excluded as group, depiction, geometry or small;
    or malformed, where a text that had to be read is no number.

    Flags must be 0 or 1. Fields are read in order, so an excluded box may have anything behind. Corners are x from and to, y
    from and to; nan fails the geometry.
    """
    flags = [permissive_integer(c) for c in (group, depiction)]
    bad = [~F.coalesce(f.isin("0", "1"), F.lit(False)) for f in flags]
    x0, x1, y0, y1 = (permissive_float(c) for c in corners)
    missing = x0.isNull() | x1.isNull() | y0.isNull() | y1.isNull()
    nan = F.isnan(x0) | F.isnan(x1) | F.isnan(y0) | F.isnan(y1)
    inside = ~nan & (x0 >= 0) & (x0 < x1) & (x1 <= 1) & (y0 >= 0) & (y0 < y1) & (y1 <= 1)
    return (
        F.when(bad[0], "malformed").when(flags[0] == "1", "group").when(bad[1], "malformed").when(flags[1] == "1", "depiction")
        .when(missing, "malformed").when(~inside, "geometry").when((x1 - x0) * (y1 - y0) < least, "small").otherwise("eligible")
    )
