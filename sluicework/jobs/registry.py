"""All queries over the reference's own operators, with their SQL."""

from __future__ import annotations

from sluicework.jobs import artifacts, files, first_passes, gates, governed, outputs, profiles, records, replies, rereads, reviews, scoring, verification

QUERIES: dict = {f.__name__: f for module in (scoring, outputs, verification, governed, reviews, artifacts, profiles, records, files, rereads, gates, replies, first_passes) for f in module.QUERIES}
ORACLE: dict[str, str] = {**scoring.ORACLE, **outputs.ORACLE, **verification.ORACLE, **governed.ORACLE, **reviews.ORACLE, **artifacts.ORACLE, **profiles.ORACLE, **records.ORACLE, **files.ORACLE, **rereads.ORACLE, **gates.ORACLE, **replies.ORACLE, **first_passes.ORACLE}
