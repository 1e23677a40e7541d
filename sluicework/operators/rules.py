"""Rules on rows: every one that fails, not only the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (code, message, test): a row breaks the rule if the test is true; a null test is false.
Rule = tuple[str, Column | str, Column]


def all_faults(rules: Sequence[Rule]) -> Column:
    """array<struct<code, message>> of the rules that a row breaks, in order; empty if it breaks none."""
    found = [F.when(test, F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))) for code, message, test in rules]
    return F.array_compact(F.array(*found))


def ladder(rules: Sequence[Rule]) -> list[Rule]:
    """The same rules, each of which only counts if none before it in the list is broken."""
    out: list[Rule] = []
    broken = F.lit(False)
    for code, message, test in rules:
        test = F.coalesce(test, F.lit(False))
        out.append((code, message, test & ~broken))
        broken = broken | test
    return out


def joined(faults: Column, before: Column | str = "") -> Column:
    """The messages of a row's faults as one text, each with ``before`` in front; null without a fault."""
    head = F.lit(before) if isinstance(before, str) else before
    return F.nullif(F.array_join(F.transform(faults, lambda f: F.concat(head, f["message"])), "; "), F.lit(""))
