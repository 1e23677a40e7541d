"""Queries on the first pass: states of samples, inputs of the second, captions, sequences side by side, names and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions import names
from sluicework.jobs.inputs import draw, table, to_duck, to_spark
from sluicework.operators import first_pass as passes
from sluicework.operators.rules import all_faults, joined
from sluicework.operators.triggers import DECISIVE

_IMAGE = f"case {draw(701, 9)} when 0 then 'missing' when 1 then 'corrupt' when 2 then null else 'loaded' end"
_SAID = f"case {draw(702, 3)} when 0 then 'no such file' when 1 then '' end"
_PROMPT, _INFERENCE = f"case when {draw(703, 8)} = 0 then concat('bad template for ', lang) end", f"case when {draw(704, 7)} = 0 then 'out of memory' end"


def first_pass_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document a sample: its whole text is the image's bytes where that is there, the prompt and the output."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", *[F.expr(to_spark(e)).alias(c) for c, e in {"image": _IMAGE, "said": _SAID, "prompt": _PROMPT, "inference": _INFERENCE}.items()])
    content = F.when(F.col("image") == "loaded", F.concat(F.lit("GIF89a"), "text")).cast("binary")
    found = passes.first_pass(F.col("image"), F.col("said"), content, F.col("prompt"), F.concat(F.lit("Q: "), "text"), F.col("inference"), F.concat("source", F.lit(": "), "text"))
    return docs.select("doc_id", F.inline(F.array(found))).withColumn("raw_output", F.md5("raw_output"))


#: Parsed rows, some spoiled.
INPUT = {
    "run_id": f"case {draw(711, 30)} when 0 then ' ' when 1 then null else 'r' end",
    "sample_id": f"case {draw(712, 30)} when 0 then '' else cast(doc_id as string) end",
    "schema_version": f"case {draw(713, 20)} when 0 then 'reasoner_output_v3' when 1 then 'v2' end",
    "uncertainty_option_index": f"case {draw(714, 20)} when 0 then 1 end",
    "flags": draw(715, 12),
    "parse_status": f"case {draw(716, 4)} when 0 then 'invalid_json' when 1 then null else 'valid' end",
    "parsed_label": f"case {draw(717, 9)} when 0 then '3' when 1 then null else cast({draw(718, 3)} as string) end",
    "evidence_summary": f"case {draw(719, 9)} when 0 then '' else text end",
    "evidence_type": f"case {draw(720, 9)} when 0 then 'guess' when 1 then null else 'elimination' end",
    "uncertainty_signal": f"case {draw(721, 9)} when 0 then null else {draw(722, 2)} = 0 end",
}


def trigger_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that keeps a parsed row from having its triggers looked for; whole texts are its evidence."""
    rows = table(spark, sf_dir, "documents").select("doc_id", *[F.expr(to_spark(e)).alias(c) for c, e in INPUT.items()])
    flags = F.when(F.col("flags") == 0, F.lit(None).cast("array<string>")).when(F.col("flags") == 1, F.array(F.lit("odd"))).when(F.col("flags") == 2, F.array(F.lit("invalid_parse"), F.lit(None))).otherwise(F.array(F.lit("invalid_parse")))
    return rows.withColumn("risk_flags", flags).select("doc_id", joined(all_faults(passes.trigger_input_rules())).alias("faults"))


CAPTION = f"case {draw(731, 6)} when 0 then concat(text, ' a Person sits') when 1 then concat('The PERSON', chr(9), 'of ', text) when 2 then concat(text, ' person.') when 3 then null else concat('a person ', text) end"
RELATION = f"case {draw(732, 7)} when 0 then 'near' when 1 then null when 2 then 'On' when 3 then 'in front of' else 'on' end"
_PICTURE = f"case {draw(733, 12)} when 0 then null else concat(source, '/', cast({draw(734, 9)} as string)) end"
_MARK = f"case {draw(735, 9)} when 0 then 2 when 1 then null else {draw(736, 2)} end"


def relation_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", *[F.expr(to_spark(e)).alias(c) for c, e in {"caption": CAPTION, "relation": RELATION, "image": _PICTURE, "label": _MARK}.items()])
    return passes.relation_captions(rows, "doc_id", "caption", "relation", "image", "label")


def zipped_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sequences over all documents side by side: by id, by length, and by hash of the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("h"))
    by_size = docs.select("doc_id", (F.col("n_chars").cast("decimal(38,0)") * 10**12 + F.col("doc_id")).alias("k"))
    by_hash = docs.select("doc_id", F.concat_ws(":", F.coalesce("h", F.lit("-")), F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("k"))
    found = passes.zipped([(docs.select("doc_id"), "doc_id"), (by_size, "k"), (by_hash, "k")])
    return found.select("place", F.col("p0.doc_id").alias("by_id"), F.col("p1.doc_id").alias("by_size"), F.col("p2.doc_id").alias("by_hash"))


NAME = f"case {draw(741, 9)} when 0 then concat('  ', source, '--', lang, '- ') when 1 then '_ -' when 2 then concat(lang, '/x') when 3 then null when 4 then concat('Run ', source, '_ _', cast(n_chars as string)) when 5 then 'Straße' when 6 then substr(text, 1, 12) else concat(source, ' ', lang) end"
LOG = f"case {draw(742, 9)} when 0 then concat(text, ' Try Again At 3:05 pm.') when 1 then concat('try again at 1:00 AM ', chr(10), text, ' TRY AGAIN AT 12:59 AM...') when 2 then concat(text, ' try again at 13:00 PM') when 3 then concat('try again at 11:7  Pm', chr(10), text) when 4 then concat('try again at noon', chr(10), text) when 5 then null when 6 then concat('try again at 12:00 pm', chr(10), text) else text end"
NOW = "2026-01-31 12:00:30"


def names_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run names from what documents are called, and the time to try again from logs that hold their whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(to_spark(NAME)).alias("name"), F.expr(to_spark(LOG)).alias("log"))
    return docs.select("doc_id", names.run_name(F.col("name")).alias("name"), F.date_format(names.retry_at(F.col("log"), F.lit(NOW).cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("retry_at"))


QUERIES = (first_pass_states, trigger_inputs, relation_captions, zipped_sequences, names_and_times)
_ROW = "'valid parsed row ' || sample_id || ' "
_TESTS = [
    ("schema_version = 'reasoner_output_v3' or uncertainty_option_index is not null", "'legacy Verifier is not compatible with Reasoner v3 lineage'"),
    ("trim(coalesce(run_id, '')) = ''", "'run_id must be a non-empty string'"),
    ("sample_id = ''", "'sample_id must be a non-empty string'"),
    ("flags < 3", "'unsupported Reasoner risk_flags for sample ' || sample_id"),
    ("parse_status = 'valid' and coalesce(parsed_label, '3') = '3'", f"{_ROW}is missing a valid label'"),
    ("parse_status = 'valid' and not regexp_matches(coalesce(evidence_summary, ''), '[^ \\t\\n\\r\\v\\f]')", f"{_ROW}is missing evidence'"),
    (f"parse_status = 'valid' and coalesce(evidence_type, '') <> '{DECISIVE[2]}'", f"{_ROW}has unsupported evidence_type'"),
    ("parse_status = 'valid' and uncertainty_signal is null", f"{_ROW}has invalid uncertainty_signal'"),
]
ORACLE = {
    "first_pass_states": f"""with d as (select *, {_IMAGE} as image, {_SAID} as said, {_PROMPT} as p, {_INFERENCE} as i from documents),
s as (select *, case when image is null or image <> 'loaded' then 'image_failed' when p is not null then 'prompt_failed' when i is not null then 'inference_failed' else 'generated' end as status from d)
select doc_id, status, case status when 'image_failed' then 'ImageLoadError' when 'prompt_failed' then 'ConfigurationError' when 'inference_failed' then 'InferenceError' end as error_type,
 case status when 'image_failed' then coalesce(nullif(said, ''), 'image load failed with status: ' || coalesce(image, 'None')) when 'prompt_failed' then p when 'inference_failed' then i end as error_message,
 case when status = 'generated' then md5(source || ': ' || text) end as raw_output, case when status in ('generated', 'inference_failed') then sha256('Q: ' || text) end as prompt_sha256,
 case when image = 'loaded' then sha256('GIF89a' || text) end as image_sha256, case when image = 'loaded' then cast(strlen('GIF89a' || text) as bigint) end as image_bytes from s""",
    "trigger_inputs": f"""with r as (select doc_id, {", ".join(f"{e} as {c}" for c, e in INPUT.items())} from documents)
select doc_id, nullif(concat_ws('; ', {", ".join(f"case when {t} then {m} end" for t, m in _TESTS)}), '') as faults from r""",
    "relation_captions": f"""with r as (select doc_id, {CAPTION} as caption, {RELATION} as relation, {_PICTURE} as image, coalesce({_MARK} in (0, 1), false) as good from documents),
s as (select *, coalesce(list_contains(string_split_regex(lower(caption), '[ \\t\\n\\r\\v\\f]+'), 'person'), false) as person, coalesce(relation in ('on', 'in front of'), false) as seen from r),
f as (select *, min(case when person and seen and good then doc_id end) over (partition by image) as first from s)
select doc_id, case when not person then 'no_person' when not seen then 'relation' when image is null or coalesce(doc_id > first, false) then 'duplicate' when not good then 'malformed' else 'eligible' end as reason from f""",
    "zipped_sequences": """with a as (select doc_id, row_number() over (order by doc_id) as place, row_number() over (order by n_chars, doc_id) as s, row_number() over (order by coalesce(sha256(text), '-'), doc_id) as h from documents)
select x.place, x.doc_id as by_id, y.doc_id as by_size, z.doc_id as by_hash from a x join a y on x.place = y.s join a z on x.place = z.h""",
    "names_and_times": f"""with n as (select doc_id, {NAME} as name, {LOG} as log, {draw(742, 9)} as k from documents),
p as (select *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(name, '^[ \\t\\n\\r\\v\\f]+|[ \\t\\n\\r\\v\\f]+$', '', 'g')), '[- ]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') as plain from n)
select doc_id, case when regexp_matches(plain, '^[a-z0-9_]+$') then plain end as name,
 case when log is null then null else case k when 0 then '2026-01-31 15:05:30' when 1 then '2026-02-01 00:59:30' when 3 then '2026-01-31 23:07:30' when 6 then '2026-02-01 12:00:30' end end as retry_at from p""",
}
ORACLE = {k: to_duck(v) for k, v in ORACLE.items()}
