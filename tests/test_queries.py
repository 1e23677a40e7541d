"""Every query over the reference's operators gives what its SQL gives."""

import pytest
from harness import differences
from sluicework.jobs.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, tiny, duck, name):
    assert differences(QUERIES[name](spark, tiny), duck, ORACLE[name]) == ""


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 4
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize(
    ("name", "column", "kinds"),
    [
        ("needs_verify", "verify", 2), ("trap_merge", "swapped", 2), ("selective_merge", "reason", 4), ("answer_ladder", "method", 5), ("answer_ladder", "u", 4), ("parse_outputs", "parse_status", 6),
        ("risk_triggers", "triggers", 20), ("image_scan", "status", 4), ("image_structure", "fault", 13), ("csv_defects", "code", 3), ("image_paths", "code", 5), ("answer_lists", "error", 8),
        ("record_faults", "codes", 60), ("box_texts", "outcome", 6), ("candidate_gates", "rejections", 40), ("acquisition", "reason", 3), ("bucket_pairs", "n_both", 10),
    ],
)
def test_queries_have_rows_of_every_kind(spark, tiny, name, column, kinds):
    """A green row says something only where the rules hold for some rows and fail for others."""
    rows = QUERIES[name](spark, tiny).groupBy(column).count().collect()
    assert len(rows) >= kinds and max(r["count"] for r in rows) < sum(r["count"] for r in rows)
