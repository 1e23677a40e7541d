"""Queries on model outputs: answers, parses, triggers and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions.text import normalised, preview, reason_snippet
from sluicework.jobs import verification as made
from sluicework.jobs.inputs import RUNS_SQL, draw, runs, table, to_duck, to_spark
from sluicework.operators import answers, decisions, parsing, triggers

_DIGIT = f"cast({draw(501, 3)} as string)"
#: Answers: whole texts, with what a model says before, within or behind them; some empty or null.
ANSWER_TEXT = f"""case {draw(502, 12)} when 0 then concat('Reasoning: first. Reasoning: ', text, ' Answer: **', {_DIGIT}) when 1 then concat('I pick 0 or ', {_DIGIT}, ' here. ', text)
 when 2 then concat(text, ' It was SRC', substr(source, 4), ' surely') when 3 then text when 4 then '' when 5 then concat('answer - 1 and later ANSWER ', {_DIGIT}, '. ', text) when 6 then null
 when 7 then concat('see THE ONE FROM ', lang, ' ', text) when 8 then concat(text, ' answer', chr(10), ':', {_DIGIT}, ' 7') when 9 then concat('x1 2x 11 ', text) else concat(text, ' Answer: ', source) end"""
_UNKNOWNS = ("Not enough information", "Cannot answer", "Can't be determined", "Undetermined", "Not known", "Unknown", "No answer at all", "Not determinable", "I can't tell", "Not sure", "Can not be determined", "Somebody else", "The second one")
#: Three options; those that say it cannot be known stand in any place, in one, two or none of them.
OPTION = {
    "a": f"case {draw(503, 5)} when 0 then 'Cannot be known' else concat('The one from ', lang) end",
    "b": f"case {draw(504, 9)} when 0 then 'It is unknown to me' else source end",
    "c": f"case {draw(505, len(_UNKNOWNS))} " + " ".join(f"when {k} then '{x.replace(chr(39), chr(39) * 2)}'" for k, x in enumerate(_UNKNOWNS)) + " end",
}
#: Evidence: a whole text, with a phrase before or behind it.
_PHRASE = f"""case {draw(506, 11)} when 0 then 'Person is holding a BOOK' when 1 then 'the posture, and clothing' when 2 then 'no badge or sign is visible' when 3 then 'The context_states it; older person' when 4 then ''
 when 5 then 'without a phone on the desk' when 6 then 'The image does not show a tool' when 7 then 'looks like a teacher, by age' when 8 then 'stated: a uniform' when 9 then 'not a uniform, but by accent' else 'a microphone' end"""
EVIDENCE = f"case when {draw(507, 2)} = 0 then concat({_PHRASE}, '. ', coalesce(text, '')) else concat(coalesce(text, ''), ' ', {_PHRASE}) end"
#: Contexts: a whole text with a person named, placed, or of an anonymous group; the same for what says where an answer comes from.
CONTEXT = f"""case {draw(508, 8)} when 0 then concat(text, ' An Elder person spoke.') when 1 then concat('A Self-Made person came. ', text) when 2 then concat('Then Maria said nothing. ', text) when 3 then concat(text, ' Ask the woman on the left.')
 when 4 then concat(text, ' an elder person spoke.') when 5 then concat('An Elder woman. ', text) else text end"""
TURN = f"case turn % 5 when 0 then concat(text, ' An Elder person spoke.') when 1 then concat('Then Maria said nothing. ', text) else text end"
RAW = f"case {draw(509, 4)} when 0 then concat(text, ' as shown') when 1 then concat('In the PHOTO: ', text) when 2 then null else text end"
IMAGE_WORDS = r"(?i)\b(image|photo|picture|shown|visible)\b"
KIND = "case n_chars % 4 when 0 then 'stated_text_fact' when 1 then 'objective_visible_evidence' when 2 then 'elimination' else 'insufficient_evidence' end"


def _spark(sql: str):
    return F.expr(to_spark(sql))


def _options():
    return F.array(*[_spark(o) for o in OPTION.values()])


def answer_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _spark(ANSWER_TEXT).alias("answer"), _options().alias("options"))
    found = docs.select("doc_id", answers.answer_ladder(F.col("answer"), F.col("options")).alias("a"), answers.unknown_index(F.col("options")).alias("u"), reason_snippet(F.col("answer")).alias("reason"))
    return found.select("doc_id", F.col("a.label").alias("label"), F.col("a.method").alias("method"), "u", "reason")


def answer_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_ladder(spark, sf_dir).groupBy("method", "label").agg(F.count("*").alias("n"))


def parse_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of the older contract, with whole texts as evidence and every part of the body varied."""
    output = _spark(made._output(parsing.MARKER, made.ANSWER))
    docs = table(spark, sf_dir, "documents").select("doc_id", output.alias("output"), (F.col("doc_id") % 17 != 0).alias("ok"))
    return parsing.parse_outputs(docs, "doc_id", "output", F.col("ok"), v3=False).drop("option_index", "parse_error")


def parse_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_outputs(spark, sf_dir).groupBy("parse_status").agg(F.count("*").alias("n"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", normalised(_spark(EVIDENCE)).alias("normal"))
    status = F.expr("case when doc_id % 11 = 0 then 'invalid_schema' else 'valid' end")
    flags = F.when(F.col("n_chars") % 6 == 0, F.array(F.lit("protected_attribute_risk"))).otherwise(F.array().cast("array<string>"))
    label = (F.col("n_chars") % 3).cast("string")
    return docs.select("doc_id", label.alias("label"), triggers.triggers(status, flags, label, F.col("doc_id") % 5 == 0, _spark(KIND), F.col("normal")).alias("found"))


def risk_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir)
    second = F.when(F.col("doc_id") % 3 == 0, F.expr("cast(doc_id % 2 as string)"))
    first = F.when(~F.array_contains("found", "invalid_parse"), F.col("label"))
    return rows.select("doc_id", F.array_join(triggers.with_conflict(F.col("found"), first, second), ",").alias("triggers"))


def trigger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.trigger_counts(_evidence(spark, sf_dir), "found")


def needs_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as contexts, of documents and of the turns of conversations, with or without someone in them."""
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("long").alias("turn"), _spark(CONTEXT).alias("text"), _options().alias("options"), (F.col("n_chars") % 3).alias("label"))
    turns = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id"))
    options = F.array(F.col("role"), F.lit("Not sure"), F.concat(F.lit("turn "), F.col("turn").cast("string")))
    turns = turns.select(F.lit("turn").alias("kind"), "doc_id", "turn", _spark(TURN).alias("text"), options.alias("options"), (F.col("turn") % 3).alias("label"))
    return docs.unionByName(turns).select("kind", "doc_id", "turn", answers.needs_verify(F.col("text"), F.col("options"), F.col("label")).alias("verify"))


def arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    label = F.when(F.col("doc_id") % 10 != 0, F.col("m0").cast("string"))
    status = F.expr("case doc_id % 6 when 0 then null when 1 then 'skipped' when 2 then 'parse_failed' else 'verified' end")
    after, defect, objective = F.col("m2").cast("string"), F.col("n_chars") % 2 == 0, F.col("n_chars") % 5 != 0
    support = decisions.verifier_supports_person(status, after, defect, objective, _spark(KIND), F.col("lang"))
    own = decisions.reasoner_supports_person(label, F.col("doc_id") % 4 == 0, _spark(KIND))
    return rows.select("doc_id", F.inline(F.array(decisions.arbitrate(label, status, after, defect, support, own))))


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = F.array(*[F.col(m) for m in ("m0", "m1", "m2", "m3", "m4")])
    return runs(spark, sf_dir).select("doc_id", decisions.majority_vote(votes).alias("label"))


def three_pass_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    staged = rows.select("lang", "m0", F.inline(F.array(decisions.three_pass(F.col("m0"), F.col("n_chars") % 3 != 0, F.col("m2"), F.col("m4"), F.col("u")))))
    counts = [F.count_if(c).alias(c) for c in ("verified", "flipped", "guarded", "reverted")]
    return staged.groupBy("lang").agg(*counts, F.sum("label").alias("label_sum"))


def selective_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", _spark(CONTEXT).alias("context"), _spark(RAW).alias("raw")), "doc_id")
    candidate = F.when(F.col("doc_id") % 9 != 0, F.col("m2"))
    return rows.select("doc_id", F.inline(F.array(decisions.selective_merge(F.col("m0"), candidate, F.col("u"), F.col("context"), F.col("raw"), IMAGE_WORDS))))


def retry_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    base = rows.select("doc_id", F.col("m0").alias("label"), "lang")
    again = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return decisions.retry_override(base, again.select("doc_id", F.col("m1").alias("label")), "doc_id")


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalised(F.col("text"))).alias("normal_md5"), F.md5(preview(F.col("text"))).alias("preview_md5"))


QUERIES = (
    answer_ladder, answer_methods, parse_outputs, parse_status_histogram, risk_triggers, trigger_counts, needs_verify, arbitration, majority_vote, three_pass_stages,
    selective_merge, retry_override, normalised_text,
)


def _any(phrases) -> str:
    return "(" + " or ".join(f"contains(t, ' {p} ')" for p in phrases) + ")"


_GROUNDED = " or ".join(
    f"(contains(t, ' {c} ') and not ({' or '.join(f'contains(t, {chr(39)} {n} {c} {chr(39)})' for n in triggers.NEGATIONS)} or ({_any(('no', 'not', 'without'))} and contains(t, ' or {c} is visible '))))" for c in triggers.VISUAL_CUES
)
_TRIGGER_SQL = f"""e as (select doc_id, n_chars, cast(n_chars % 3 as varchar) as label, doc_id % 5 = 0 as unsure, {KIND} as kind,
  concat(' ', trim(regexp_replace(lower({EVIDENCE}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') as t, case when doc_id % 11 = 0 then 'invalid_schema' else 'valid' end as status from documents),
t as (select doc_id, label, status, case when status <> 'valid' then ['invalid_parse'] else list_filter([
  case when label in ('0', '1') and unsure then 'low_confidence' end,
  case when (label in ('0', '1') and kind = 'insufficient_evidence') or (label = '2' and kind <> 'insufficient_evidence') or (label = '2' and not unsure) or (label in ('0', '1') and unsure) then 'unsupported_evidence' end,
  case when n_chars % 6 = 0 then 'protected_attribute_risk' end,
  case when {_any(triggers.APPEARANCE_CUES)} and not {_any((*triggers.VISUAL_CUES, *triggers.STATED_CUES))} then 'appearance_only_reasoning' end,
  case when label in ('0', '1') and kind = 'objective_visible_evidence' and not (not {_any(triggers.GLOBAL_NEGATIONS)} and ({_GROUNDED})) then 'ambiguous_visual_grounding' end], lambda x: x is not null) end as found from e)"""
_UNKNOWN_AT = "coalesce(list_min(list_filter(list_transform([1, 2, 3], lambda i: case when regexp_matches(o[i], '{}') then [length(o[i]), i - 1] end), lambda x: x is not null))[2], -1)".format(answers.UNKNOWN)
_LADDER_SQL = f"""a as (select doc_id, {ANSWER_TEXT} as answer, [{", ".join(OPTION.values())}] as o from documents),
b as (select doc_id, answer, o, list_last(regexp_extract_all(answer, '(?i)answer\\s*[:\\-]?\\s*\\**\\s*([012])', 1)) as p, list_last(regexp_extract_all(answer, '\\b([012])\\b', 1)) as d,
  case when contains(lower(answer), lower(o[1])) then 0 when contains(lower(answer), lower(o[2])) then 1 when contains(lower(answer), lower(o[3])) then 2 end as n,
  cast({_UNKNOWN_AT} as int) as u from a),
ladder as (select doc_id, cast(coalesce(cast(nullif(p, '') as int), cast(nullif(d, '') as int), case when answer <> '' then n end, case when u >= 0 then u end, 0) as int) as label,
  case when nullif(p, '') is not null then 'answer_pattern' when nullif(d, '') is not null then 'digit_pattern' when answer <> '' and n is not null then 'option_text' when u >= 0 then 'unknown_fallback' else 'zero_fallback' end as method, u,
  substr(regexp_replace(split_part(list_last(string_split(answer, 'Reasoning:')), 'Answer:', 1), '^[ \\t\\n\\r\\v\\f]+|[ \\t\\n\\r\\v\\f]+$', '', 'g'), 1, 200) as reason from b)"""
_V2_LADDER = made._ladder(
    "final answer must be a JSON object", parsing.MARKER, "final answer JSON is invalid: ", made.ANSWER, "label must be exactly one of: 0, 1, 2", "evidence must be a non-empty string", []
)
_PARSE_SQL = f"""d as ({made._DRAWS}), f as (select *, {_V2_LADDER} as fault from d),
p as (select *, case when doc_id % 17 = 0 then 'source_failed' else coalesce(split_part(fault, '|', 1), 'valid') end as parse_status from f),
q as (select doc_id, parse_status, case when parse_status = 'valid' then lab end as label, case when parse_status = 'valid' then t end as evidence, case when parse_status = 'valid' then etype end as evidence_type,
  case when parse_status = 'valid' then first_ end as uncertainty_signal, case when parse_status = 'valid' then second_ end as protected_attribute_risk from p)"""
ORACLE = {
    "answer_ladder": f"with {_LADDER_SQL} select doc_id, label, method, u, reason from ladder",
    "answer_methods": f"with {_LADDER_SQL} select method, label, count(*) as n from ladder group by method, label",
    "parse_outputs": f"with {_PARSE_SQL} select * from q",
    "parse_status_histogram": f"with {_PARSE_SQL} select parse_status, count(*) as n from q group by parse_status",
    "risk_triggers": f"""with {_TRIGGER_SQL}, s as (select *, case when doc_id % 3 = 0 then cast(doc_id % 2 as varchar) end as second from t)
select doc_id, array_to_string(case when status = 'valid' and second is not null and second <> label then list_append(found, 'reasoner_verifier_conflict') else found end, ',') as triggers from s""",
    "trigger_counts": f"""with {_TRIGGER_SQL}, names as (select unnest(['{"', '".join(triggers.TRIGGERS)}']) as trigger), f as (select unnest(found) as x from t)
select trigger, count(x) as n from names left join f on x = trigger group by trigger""",
    "needs_verify": f"""with d as (select 'document' as kind, doc_id, cast(null as bigint) as turn, n_chars % 3 as label, {CONTEXT} as context, [{", ".join(OPTION.values())}] as o from documents
union all select 'turn', conv_id, turn, turn % 3, {TURN}, [role, 'Not sure', 'turn ' || turn] from conversations), c as (select *, {_UNKNOWN_AT} as u from d)
select kind, doc_id, turn, (label <> u and regexp_matches(context, '{answers.ANONYMOUS_GROUP}')) or (label = u and regexp_matches(context, '{answers.NAMED}')) as verify from c""",
    "arbitration": f"""with r as ({RUNS_SQL}),
s as (select doc_id, case when doc_id % 10 <> 0 then cast(m0 as varchar) end as l, case doc_id % 6 when 0 then null when 1 then 'skipped' when 2 then 'parse_failed' else 'verified' end as status,
  cast(m2 as varchar) as after, n_chars % 2 = 0 as defect, n_chars % 5 <> 0 as objective, {KIND} as kind, doc_id % 4 = 0 as unsure from r),
t as (select *, coalesce(status = 'verified', false) and after in ('0', '1') and defect and objective and kind <> 'insufficient_evidence' as vs,
  coalesce(l in ('0', '1'), false) and not unsure and kind <> 'insufficient_evidence' as rs from s),
u as (select *, case when status is null or status = 'skipped' then 1 when status <> 'verified' then 2 when not defect and l is not null then 3 when not defect then 4
  when vs and l is not distinct from after then 5 when vs then 6 when after = '2' and not rs then 7 else 8 end as rung from t)
select doc_id, case when rung in (6, 7) then after else l end as label,
  case when rung = 6 then 'verifier' when rung = 7 then 'arbitration' when rung = 4 or l is null then 'error' else 'reasoner' end as stage,
  case when rung = 6 then 'verifier_concrete_defect_with_objective_support' when rung = 7 then 'both_outputs_lack_objective_support' when rung = 4 or l is null then 'no_valid_label'
  when rung = 1 then 'validated_reasoner_output' when rung = 3 then 'verifier_no_concrete_defect_keep_reasoner' when rung = 5 then 'verifier_reaffirmed_reasoner_with_objective_support'
  else '{decisions.KEEP}' end as reason from u""",
    "majority_vote": f"""with r as ({RUNS_SQL}), v as (select doc_id, unnest([m0, m1, m2, m3, m4]) as v, unnest([1, 2, 3, 4, 5]) as p, m0 from r),
c as (select doc_id, v, m0, count(*) as n, min(p) as p from v group by doc_id, v, m0),
k as (select *, row_number() over (partition by doc_id order by n desc, case when v = m0 then 0 else 1 end, p) as k from c) select doc_id, v as label from k where k = 1""",
    "three_pass_stages": f"""with r as ({RUNS_SQL}), a as (select *, n_chars % 3 <> 0 as verified, case when n_chars % 3 <> 0 then m2 else m0 end as after from r),
b as (select *, verified and m0 = u and after <> u as guarded from a), c as (select *, case when guarded then m4 else after end as label from b)
select lang, count(*) filter (verified) as verified, count(*) filter (verified and after <> m0) as flipped, count(*) filter (guarded) as guarded, count(*) filter (guarded and label = m0) as reverted,
cast(sum(label) as bigint) as label_sum from c group by lang""",
    "selective_merge": f"""with r as ({RUNS_SQL}), t as (select doc_id, {CONTEXT} as context, {RAW} as raw from documents),
c as (select r.*, coalesce(case when r.doc_id % 9 <> 0 then m2 end, m0) as cand, regexp_matches(context, '{answers.ANONYMOUS_GROUP}') as anon, regexp_matches(coalesce(raw, ''), '{IMAGE_WORDS}') as cites from r join t on r.doc_id = t.doc_id)
select doc_id, case when cand <> m0 and ((cand = u and anon) or cites) then cand else m0 end as label,
case when cand = m0 then 'same' when cand = u and anon then 'trap' when cites then 'image' else 'keep' end as reason from c""",
    "retry_override": f"""with r as ({RUNS_SQL}) select doc_id, case when doc_id in (select doc_id from labels) then m1 else m0 end as label, lang, case when doc_id in (select doc_id from labels) then 'retry' else 'base' end as origin from r""",
    "normalised_text": r"""select doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g'))) as normal_md5,
md5(substr(replace(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(10), ' '), 1, 200)) as preview_md5 from documents""",
}
ORACLE = {k: to_duck(v) for k, v in ORACLE.items()}
