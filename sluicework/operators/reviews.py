"""Review and adjudication of governed records: rules, updates and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.operators.parsing import first_fault

#: The evidence that each subset of records may rest on.
SUBSET_EVIDENCE = {
    "ambiguous": ("insufficient_evidence",),
    "disambiguated_text": ("stated_text_fact",),
    "visual_grounded": ("objective_visual_evidence",),
    "elimination": ("valid_elimination",),
    "stereotype_trap": ("stated_text_fact",),
    "expression_trap": ("stated_text_fact",),
    "role_or_function": ("stated_text_fact",),
    "parsing_stress": ("stated_text_fact", "valid_elimination"),
}


def evidence_rules(label: Column, uncertain_at: Column, subsets: Column, basis: Column) -> list[tuple[Column, Column | str]]:
    """(test, message) of the rules that bind a label to its evidence, in order."""
    unsure, none, ambiguous = label == uncertain_at, basis == "insufficient_evidence", F.array_contains(subsets, "ambiguous")
    allowed = F.create_map(*[x for k, v in SUBSET_EVIDENCE.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    wrong = F.filter(subsets, lambda s: ~F.coalesce(F.array_contains(allowed[s], basis), F.lit(False)))
    return [
        (unsure & ~(none & ambiguous), "uncertainty label requires ambiguous/insufficient evidence"),
        (~unsure & (none | ambiguous), "resolvable label has inconsistent evidence"),
        (~unsure & (F.size(wrong) > 0), F.concat(F.lit("evidence_basis is incompatible with subsets "), F.array_join(wrong, ", "))),
    ]


def _first(rules: list[tuple[Column, Column | str]]) -> Column:
    return first_fault([("violation", text, test) for test, text in rules])["error"]


def review_violation(record: Column, review: Column) -> Column:
    """The first rule that a review breaks against its record (both structs), null if none."""
    done = review["decision"] == "reviewed"
    return _first(
        [
            (review["reviewer_id"].eqNullSafe(record["author_id"]), "independent reviewer must differ from author"),
            (review["proposed_label"] != record["expected_label"], "proposed_label does not match dataset"),
            (done & (review["independent_label"] != review["proposed_label"]), "reviewed decision requires matching independent_label"),
            (done & ~review["checks_pass"], "reviewed decision requires all quality checks"),
            *[(done & test, text) for test, text in evidence_rules(review["independent_label"], record["uncertainty_option_index"], record["subsets"], review["evidence_basis"])],
        ]
    )


def adjudication_violation(record: Column, review: Column, final: Column) -> Column:
    """The first rule that an adjudication breaks against its record and review, null if none."""
    done = final["decision"] == "adjudicated"
    return _first(
        [
            (final["adjudicator_id"].eqNullSafe(record["author_id"]), "adjudicator must differ from author"),
            (final["adjudicator_id"].eqNullSafe(review["reviewer_id"]), "adjudicator must differ from reviewer"),
            (done & ~final["checks_pass"], "adjudicated decision requires all quality checks"),
            *[(done & test, text) for test, text in evidence_rules(final["final_label"], record["uncertainty_option_index"], final["final_subsets"], final["evidence_basis"])],
        ]
    )


def updated_records(joined: DataFrame) -> DataFrame:
    """Records after review (columns sample_id, record, review, final): an adjudication's label and subsets replace the
    record's, uncertainty is derived anew, and the last to decide is the reviewer. Rejected and undecided records go."""
    by_final = (F.col("review.decision") == "adjudication_required") & (F.col("final.decision") == "adjudicated")
    by_review = F.col("review.decision") == "reviewed"
    label = F.when(by_final, F.col("final.final_label")).otherwise(F.col("record.expected_label"))
    return joined.filter(by_review | by_final).select(
        "sample_id",
        label.alias("expected_label"),
        (label == F.col("record.uncertainty_option_index")).alias("expected_is_uncertainty"),
        F.when(by_final, F.col("final.final_subsets")).otherwise(F.col("record.subsets")).alias("subsets"),
        F.when(by_final, "adjudicated").otherwise("reviewed").alias("review_status"),
        F.when(by_final, F.col("final.adjudicator_id")).otherwise(F.col("review.reviewer_id")).alias("reviewer_id"),
    )


def review_history(joined: DataFrame) -> DataFrame:
    """(sample_id, step, event_type, actor_id, decision, before_label, after_label, before_subsets, after_subsets): a row for each
    review and, where one had to follow, each adjudication. What a decision did not accept has no state after it."""
    record, review, final = (F.col(c) for c in ("record", "review", "final"))

    def event(step: int, kind: str, actor: Column, decision: Column, accepted: Column, label: Column, subsets: Column) -> Column:
        return F.struct(
            F.lit(step).alias("step"), F.lit(kind).alias("event_type"), actor.alias("actor_id"), decision.alias("decision"), record["expected_label"].alias("before_label"),
            F.when(accepted, label).alias("after_label"), record["subsets"].alias("before_subsets"), F.when(accepted, subsets).alias("after_subsets"),
        )

    first = event(1, "review", review["reviewer_id"], review["decision"], review["decision"] == "reviewed", record["expected_label"], record["subsets"])
    second = event(2, "adjudication", final["adjudicator_id"], final["decision"], final["decision"] == "adjudicated", final["final_label"], final["final_subsets"])
    events = F.when(final.isNotNull() & (review["decision"] == "adjudication_required"), F.array(first, second)).otherwise(F.array(first))
    return joined.filter(review.isNotNull()).select("sample_id", F.inline(events))


def review_report(records: DataFrame, decisions: DataFrame, adjudications: DataFrame, on: str, expected: int, coverage: DataFrame) -> DataFrame:
    """One row on a round of reviews: how many records, decisions, adjudications, reviewed, adjudicated, rejected, disputes, records
    without a decision, retained and unresolved ones; violations in order, each once; whether there is none.

    ``decisions`` hold the id and decision (reviewed, rejected, adjudication_required), ``adjudications`` the id and decision
    (accept, reject), one row an id; ids that ``records`` lack do not count as reviews of any. ``coverage`` are further
    violations (ord, message), a bounded list. Counts are partial sums over one join; nothing is gathered but the messages.
    """
    said, last = decisions.select(F.col(on), F.col("decision").alias("_said")), adjudications.select(F.col(on), F.col("decision").alias("_last"))
    rows = records.select(on).join(said, on, "left").join(last, on, "left")
    dispute = F.coalesce(F.col("_said") == "adjudication_required", F.lit(False))
    settled = dispute & F.col("_last").isNotNull()
    kept = (F.col("_said") == "reviewed", settled & (F.col("_last") == "accept"))
    counts = rows.agg(
        F.count("*").alias("input_records"),
        F.count("_said").alias("decisions"),
        F.count_if(kept[0]).alias("reviewed"),
        F.count_if(kept[1]).alias("adjudicated"),
        F.count_if((F.col("_said") == "rejected") | (settled & (F.col("_last") == "reject"))).alias("rejected"),
        F.count_if(dispute).alias("disputes"),
        F.count_if(dispute & ~settled).alias("open_disputes"),
    )
    more = adjudications.agg(F.count("*").alias("adjudications"))
    listed = coverage.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda v: v["message"]).alias("_coverage"))  # a bounded list
    one = counts.join(F.broadcast(more), F.lit(True)).join(F.broadcast(listed), F.lit(True))  # one row each
    missing = F.col("input_records") - F.col("decisions")
    own = F.array_compact(F.array(
        F.when(F.col("input_records") != expected, F.lit(f"review input must contain exactly {expected} records")),
        F.when(missing != 0, F.lit(f"all {expected} input records require a terminal review decision")),
        F.when(F.col("open_disputes") > 0, F.concat(F.col("open_disputes").cast("string"), F.lit(" disputes require adjudication"))),
    ))
    violations = F.array_distinct(F.concat(own, "_coverage"))
    names = ("input_records", "decisions", "adjudications", "reviewed", "adjudicated", "rejected", "disputes")
    return one.select(*names, missing.alias("missing_decisions"), (F.col("reviewed") + F.col("adjudicated")).alias("retained"), (missing + F.col("open_disputes")).alias("unresolved"), violations.alias("violations"), (F.size(violations) == 0).alias("promotion_ready"))
