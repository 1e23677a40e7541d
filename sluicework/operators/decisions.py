"""Which label counts: arbitration, multi-pass stages, merges and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.operators.answers import ANONYMOUS_GROUP, unknown_index
from sluicework.operators.triggers import DECISIVE, PERSONS

#: What a question says that asks for a tendency.
LIKELY = r"(?i)\b(more likely|less likely|likely to|likely just|likely the|seen as|tends to|generally)\b"
KEEP = "verifier_no_usable_support_keep_reasoner"


def verifier_supports_person(status: Column, after: Column, defect: Column, objective: Column, evidence_type: Column, reason: Column) -> Column:
    test = (status == "verified") & after.isin(*PERSONS) & defect & objective & evidence_type.isin(*DECISIVE) & (F.trim(reason) != "")
    return F.coalesce(test, F.lit(False))


def reasoner_supports_person(label: Column, uncertain: Column, evidence_type: Column) -> Column:
    return F.coalesce(label.isin(*PERSONS) & ~uncertain & evidence_type.isin(*DECISIVE), F.lit(False))


def arbitrate(label: Column, status: Column, after: Column, defect: Column, verifier_support: Column, reasoner_support: Column) -> Column:
    """struct(label, stage, reason); first rung that fits. ``label`` is null unless the first answer is valid, ``status`` null
    without verification. Rows that nothing decides get the stage "error"."""

    def out(value: Column, stage: str, reason: str) -> Column:
        return F.struct(value.alias("label"), F.lit(stage).alias("stage"), F.lit(reason).alias("reason"))

    def kept(reason: str) -> Column:
        return F.when(label.isNull(), out(label, "error", "no_valid_label")).otherwise(out(label, "reasoner", reason))

    sound = ~F.coalesce(defect, F.lit(True))
    return (
        F.when(status.isNull() | (status == "skipped"), kept("validated_reasoner_output"))
        .when(status != "verified", kept(KEEP))
        .when(sound & label.isNotNull(), out(label, "reasoner", "verifier_no_concrete_defect_keep_reasoner"))
        .when(sound, out(label, "error", "no_valid_label"))
        .when(verifier_support & label.eqNullSafe(after), out(label, "reasoner", "verifier_reaffirmed_reasoner_with_objective_support"))
        .when(verifier_support, out(after, "verifier", "verifier_concrete_defect_with_objective_support"))
        .when((after == "2") & ~reasoner_support, out(after, "arbitration", "both_outputs_lack_objective_support"))
        .otherwise(kept(KEEP))
    )


def majority_vote(votes: Column) -> Column:
    """Most frequent vote; of several, the first vote if it is among them, else the one seen first. Null without votes."""
    tally = F.transform(
        F.array_distinct(votes),
        lambda v: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), (v == votes[0]).cast("int").alias("greedy"), (-F.array_position(votes, v)).alias("place"), v.alias("v")),
    )
    return F.array_max(tally)["v"]


def three_pass(first: Column, verify: Column, second: Column, third: Column, unknown: Column) -> Column:
    """struct(label, verified, flipped, guarded, reverted): the second pass answers rows to verify; where it moved away from
    uncertainty, the third, a guard, may move back."""
    after = F.when(verify, second).otherwise(first)
    guarded = verify & (unknown >= 0) & (first == unknown) & (after != unknown)
    last = F.when(guarded, third).otherwise(after)
    return F.struct(last.alias("label"), verify.alias("verified"), (verify & (after != first)).alias("flipped"), guarded.alias("guarded"), (guarded & (last == first)).alias("reverted"))


def selective_merge(base: Column, candidate: Column, unknown: Column, context: Column, raw: Column, image_words: str) -> Column:
    """struct(label, reason): the candidate's answer where it corrects an anonymous-group trap or cites the image, else the
    base's; a missing candidate is the base."""
    cand = F.coalesce(candidate, base)
    trap = (cand == unknown) & context.rlike(ANONYMOUS_GROUP)
    cites = F.coalesce(raw, F.lit("")).rlike(image_words)

    def out(label: Column, reason: str) -> Column:
        return F.struct(label.alias("label"), F.lit(reason).alias("reason"))

    return F.when(cand == base, out(base, "same")).when(trap, out(cand, "trap")).when(cites, out(cand, "image")).otherwise(out(base, "keep"))


def trap_merge(base: Column, candidate: Column, unknown: Column, context: Column, question: Column, likely: str) -> Column:
    """The candidate's label where it turns to uncertainty on an anonymous group and the question asks what is likely, else
    the base's; a missing candidate changes nothing."""
    turns = (candidate != base) & (candidate == unknown) & context.rlike(ANONYMOUS_GROUP) & question.rlike(likely)
    return F.when(F.coalesce(turns, F.lit(False)), candidate).otherwise(base)


def merge_traps(base: DataFrame, candidate: DataFrame, items: DataFrame, on: str, likely: str = LIKELY) -> DataFrame:
    """(id, label, swapped) of every row of ``base`` (id, label): that of ``candidate`` where ``trap_merge`` takes it.

    ``items`` hold context, question and options of each id; the uncertainty option's place follows from them. A row without
    a candidate keeps its label; one without an item is an error of the inputs and gets none, null.
    """
    chosen = candidate.select(F.col(on), F.col("label").alias("_candidate"))
    known = items.select(F.col(on), F.struct(unknown_index(F.col("options")).alias("u"), "context", "question").alias("_item"))
    rows = base.select(on, F.col("label").alias("_base")).join(chosen, on, "left").join(known, on, "left")
    item = F.col("_item")
    label = F.when(item.isNotNull(), trap_merge(F.col("_base"), F.col("_candidate"), item["u"], item["context"], item["question"], likely))
    return rows.select(on, label.alias("label"), (label != F.col("_base")).alias("swapped"))


def repair_merge(source: DataFrame, repair: DataFrame, on: str, status: str, origin: tuple[str, str]) -> DataFrame:
    """``source`` with its invalid rows replaced by the valid rows of ``repair``, and ``origin_run_id``, the run that each row is
    from. Rows that no repair has stay invalid; repairs of valid rows are not taken."""
    fixed = repair.filter(F.col(status) == "valid").select(F.col(on).alias("_on"), F.struct(*[c for c in source.columns if c != on]).alias("_fixed"))
    joined = source.join(fixed, F.col(on) == F.col("_on"), "left")
    taken = F.col("_on").isNotNull() & ~F.col(status).eqNullSafe(F.lit("valid"))
    rest = [F.when(taken, F.col(f"_fixed.{c}")).otherwise(F.col(c)).alias(c) for c in source.columns if c != on]
    return joined.select(on, *rest, F.when(taken, origin[1]).otherwise(origin[0]).alias("origin_run_id"))


def only_invalid(source: DataFrame, repair: DataFrame, on: str, status: str, row_id) -> list[str]:
    """Why one row may not be repaired: it must be the only invalid one of its run, and the repair one valid row of that id.
    At most two ids of each side reach the driver."""
    bad = [r[0] for r in source.filter(~F.col(status).eqNullSafe(F.lit("valid"))).select(on).limit(2).collect()]
    fixes = [(r[0], r[1]) for r in repair.select(on, status).limit(2).collect()]
    faults = []
    if bad != [row_id]:
        faults.append(f"expected only {row_id} invalid; got {bad}{' and perhaps more' if len(bad) == 2 else ''}")
    if fixes != [(row_id, "valid")]:
        faults.append("repair run must contain one valid parsed row")
    return faults


def retry_override(base: DataFrame, retries: DataFrame, on: str) -> DataFrame:
    """``base`` with the columns of ``retries`` in place of its own wherever a retry has the id; ``origin`` tells which."""
    given = retries.withColumn("_retry", F.lit(True))
    joined = base.alias("b").join(given.alias("r"), on, "left")
    swapped = F.col("_retry").isNotNull()
    columns = [F.when(swapped, F.col(f"r.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in base.columns if c != on and c in retries.columns]
    rest = [F.col(f"b.{c}") for c in base.columns if c != on and c not in retries.columns]
    return joined.select(on, *columns, *rest, F.when(swapped, F.lit("retry")).otherwise(F.lit("base")).alias("origin"))
