"""Prompt texts as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbered(options: Column) -> Column:
    """The options, one a line, each behind its number from 0."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(i.cast("string"), F.lit(". "), o)), "\n")


def shown(value: Column) -> Column:
    """A value as text: null is spelt out, booleans are lower case."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def user_text(context: Column, question: Column, options: Column) -> Column:
    """Context, question and options, then what is asked (a fixed value)."""
    asked = "Which option is correct? Remember: if there is no explicit evidence, choose the uncertainty option."
    return F.concat(F.lit("Context: "), context, F.lit("\nQuestion: "), question, F.lit("\nOptions:\n"), numbered(options), F.lit(f"\n\n{asked}"))


def placeholders(template: str) -> list[str]:
    """The named placeholders of a template, in order of their first use. Others than plain ``{name}`` are an error; ``{{`` and ``}}``
    are braces."""
    found: list[str] = []
    try:
        parts = list(Formatter().parse(template))
    except ValueError as e:
        raise ValueError(f"template has invalid braces: {e}") from e
    for _, name, spec, conversion in parts:
        if name is None:
            continue
        if not name.isidentifier() or spec or conversion:
            raise ValueError(f"template has an unsupported placeholder: {name!r}")
        if name not in found:
            found.append(name)
    return found


def render(template: str, values: Mapping[str, Column]) -> Column:
    """A template with each placeholder replaced by a column's text. The template must have exactly the placeholders that are
    given, no more and no less. Values are put in as they are: braces in them mean nothing, null is spelt out."""
    named = placeholders(template)
    missing, unknown = sorted(set(values) - set(named)), sorted(set(named) - set(values))
    if missing:
        raise ValueError(f"template lacks placeholders: {', '.join(missing)}")
    if unknown:
        raise ValueError(f"template has unknown placeholders: {', '.join(unknown)}")
    pieces: list[Column] = []
    for text, name, _, _ in Formatter().parse(template):
        pieces += [F.lit(text)] if text else []
        pieces += [shown(values[name])] if name is not None else []
    return F.concat(*pieces, F.lit(""))
