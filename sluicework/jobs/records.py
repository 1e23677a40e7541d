"""Queries on records, answer lists and image paths.

The tables hold no such files, so lines are made from documents, with whole texts in them, and paths from the URLs of pages.
The SQL judges the same lines with DuckDB's own JSON functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions import paths
from sluicework.jobs.inputs import draw, table, to_duck, to_spark
from sluicework.operators import records
from sluicework.operators.images import image_format
from sluicework.operators.rules import all_faults, joined, ladder

ROOT = "/data/images"


def _pick(k: int, *odd: str, usual: str, of: int = 40) -> str:
    """One of the odd values now and then, else the usual one."""
    return f"case {draw(k, of)} " + " ".join(f"when {n} then {x}" for n, x in enumerate(odd)) + f" else {usual} end"


_LABEL, _PLACE = draw(101, 3), draw(102, 3)
#: JSON of each field, or null where it is left out; {quoted text} and {n} are filled in for each engine.
FIELDS = {
    "sample_id": _pick(103, "'\" \"'", "'7'", "null", usual="concat('\"s', cast(doc_id as string), '\"')"),
    "image_ref": _pick(104, "'\"../up.png\"'", "'\"/etc/x.png\"'", "'\"none.png\"'", "'\"a/../../images/../x\"'", "'\"\"'", "null", usual="concat('\"./a/..//', cast(doc_id as string), '.png\"')"),
    "context": "QUOTED(text)",
    "question": _pick(105, "'null'", "'[\"Who?\"]'", usual="QUOTED(source)"),
    "answers": _pick(106, "'[\"a\", \"b\"]'", "'[\"a\", \"b\", \" \"]'", "'\"abc\"'", "'[\"a\", \"b\", 3]'", "'{}'", usual="'[' || QUOTED(lang) || ', ' || QUOTED(source) || ', \"Unknown\"]'"),
    "expected_label": _pick(107, "'3'", "'\"1\"'", "'true'", "'1.0'", "null", usual=f"cast({_LABEL} as string)"),
    "uncertainty_option_index": _pick(108, "'-1'", "'null'", "null", usual=f"cast({_PLACE} as string)"),
    "expected_is_uncertainty": _pick(109, f"case when {_LABEL} = {_PLACE} then 'false' else 'true' end", "'\"true\"'", "'0'", usual=f"case when {_LABEL} = {_PLACE} then 'true' else 'false' end"),
    "subsets": _pick(110, "'[]'", "'[\"ambiguous\", \"ambiguous\"]'", "'[\"other\"]'", "'[\"ambiguous\", 1]'", "'\"ambiguous\"'", usual="'[\"ambiguous\", \"elimination\"]'"),
    "provenance_type": _pick(111, "'\"bought\"'", "'null'", "'\"synthetic\"'", "'\"generated_allowed\"'", usual="'\"public\"'", of=12),
    "source_uri_or_note": _pick(112, "'\"See TEST.csv\"'", "'\"the Leaderboard\"'", "'\" \"'", usual="QUOTED(substring(text, 1, 400))"),
    "license_or_permission": _pick(113, "'\"\"'", usual="'\"CC BY\"'"),
    "author_id": _pick(114, "'1'", usual=f"concat('\"a', cast({draw(115, 6)} as string), '\"')"),
    "review_status": _pick(116, "'\"open\"'", "'1'", "'\"pending\"'", "'\"rejected\"'", usual="case when doc_id % 2 = 0 then '\"reviewed\"' else '\"adjudicated\"' end", of=20),
    "reviewer_id": _pick(117, "'\" \"'", "'5'", "'null'", "null", usual=f"concat('\"a', cast({draw(118, 6)} as string), '\"')", of=20),
    "split": _pick(119, "'\"train\"'", "null", usual="'\"selection\"'"),
    "randomization_seed": _pick(120, "'1.5'", "'\"x\"'", "'true'", "'null'", "'12'", usual="null"),
    "image_sha256": _pick(121, "'\"00\"'", "'4'", "'null'", usual="null", of=12),
    "extra": _pick(122, "'1'", usual="null", of=60),
}
LINE = f"case {draw(123, 40)} when 0 then ' ' when 1 then '[1]' when 2 then '{{\"sample_id\": ' when 3 then null else concat('{{', concat_ws(', ', " + ", ".join(f"'\"{k}\": ' || ({v})" for k, v in FIELDS.items()) + "), '}') end"
LINE = LINE.replace("'{{'", "'{'").replace("'{{\"", "'{\"")
#: An image for most documents: some empty, some without the bytes of an image.
CONTENT = f"case {draw(124, 15)} when 0 then '' when 1 then concat('text ', source) else concat('GIF89a', coalesce(text, '')) end"
RAW_ANSWERS = f"case {draw(125, 14)} when 0 then '' when 1 then '[1, 2' when 2 then '\"abc\"' when 3 then '{{}}' when 4 then '[\"a\"]' when 5 then '[\"a\", 2, \" \"]' when 6 then '[\" \", 2, \"c\"]' when 7 then '[\"a\", \"b\", null]' when 8 then null else '[' || QUOTED(text) || ', \" x \", ' || QUOTED(lang) || ']' end".replace("{{}}", "{}")
#: The path of a URL, wanted below the training images; with what hostile and careless writers put before it.
WANTED = "train/images"
_TAIL = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '')"
_SHAPE = draw(126, 12).replace("doc_id", "page_id")
RAW_PATH = f"""case {_SHAPE} when 0 then concat('/', {_TAIL}) when 1 then concat('../', {_TAIL}) when 2 then concat('train/images/../../', {_TAIL}) when 3 then concat('images/a/../', {_TAIL})
 when 4 then {_TAIL} when 5 then '  ' when 6 then null when 7 then concat('./images//./', {_TAIL}, '/') when 8 then concat('train/images', {_TAIL}) when 9 then concat(' train/images/', {_TAIL}, ' ') else concat('images/', {_TAIL}) end"""


def _spark(sql: str) -> str:
    """QUOTED(x) is the JSON string of x, null for null."""
    out = to_spark(sql)
    for name in ("substring(text, 1, 400)", "text", "source", "lang"):
        out = out.replace(f"QUOTED({name})", f"substring(to_json(named_struct('a', {name})), 6, case when {name} is null then null else length(to_json(named_struct('a', {name}))) - 6 end)")
    return out


def _duck(sql: str) -> str:
    out = to_duck(sql)
    for name in ("substring(text, 1, 400)", "text", "source", "lang"):
        out = out.replace(f"QUOTED({name})", f"cast(to_json({name}) as varchar)")
    return out


def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a line, with its whole text as context; the images are files of other bytes, found by their path."""
    docs = table(spark, sf_dir, "documents")
    content = F.expr(to_spark(CONTENT)).cast("binary")
    path = F.concat(F.lit(f"{ROOT}/"), F.col("doc_id").cast("string"), F.lit(".png"))
    files = docs.filter(F.expr(to_spark(f"{draw(127, 20)} > 0"))).select(path.alias("path"), image_format(content).alias("format"), F.octet_length(content).alias("bytes"), F.sha2(content, 256).alias("sha256"))
    lines = docs.select(F.col("doc_id").alias("ordinal"), F.expr(_spark(LINE)).alias("line"))
    found = records.record_faults(lines, files, ROOT)
    return found.select(F.col("ordinal").alias("doc_id"), F.array_join(F.transform("faults", lambda f: f["code"]), ",").alias("codes"), F.try_element_at("faults", F.lit(1))["message"].alias("first"), "error")


def answer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists whose first answer is a document's whole text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_spark(RAW_ANSWERS)).alias("raw"))
    found = records.answer_lists(rows, "doc_id", "raw")
    return found.select("doc_id", F.md5(F.array_join("answers", "|")).alias("answers_md5"), "error")


def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path that each page's image means, and what is wrong with it; only paths of labelled pages exist."""
    raw = F.expr(to_spark(RAW_PATH))
    pages = table(spark, sf_dir, "pages").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("known")), "page_id", "left")
    resolved = paths.image_path("/data", "train", WANTED, F.col("raw"))
    rows = pages.select("page_id", "known", raw.alias("raw")).withColumn("resolved", resolved)
    faults = all_faults(ladder(paths.path_rules("/data", WANTED, F.col("raw"), F.col("resolved"), F.col("known"))))
    return rows.select("page_id", "resolved", F.try_element_at(faults, F.lit(1))["code"].alias("code"), joined(faults, F.concat(F.lit("row "), F.col("page_id").cast("string"), F.lit(" "))).alias("error"))


QUERIES = (record_faults, answer_lists, image_paths)


def _json_text(key: str) -> str:
    return f"json_extract_string(j, '$.{key}')"


def _type(key: str) -> str:
    return f"json_type(j, '$.{key}')"


def _text(key: str) -> str:
    return f"coalesce({_type(key)} = 'VARCHAR' and regexp_matches({_json_text(key)}, '\\S'), false)"


def _among(key: str, values) -> str:
    return f"coalesce({_type(key)} = 'VARCHAR' and {_json_text(key)} in ({', '.join(repr(v) for v in values)}), false)"


def _whole(key: str) -> str:
    return f"coalesce({_type(key)} in ('UBIGINT', 'BIGINT') and {_json_text(key)} in ('0', '1', '2'), false)"


def _there(key: str) -> str:
    return f"list_contains(json_keys(j), '{key}')"


def _records_sql() -> str:
    name = {k: _there(k) for k in (*records.REQUIRED, *records.OPTIONAL)}
    required, known = ", ".join(f"'{k}'" for k in sorted(records.REQUIRED)), ", ".join(f"'{k}'" for k in (*records.REQUIRED, *records.OPTIONAL))
    same = f"({_text('reviewer_id')} and {_text('author_id')} and {_json_text('reviewer_id')} = {_json_text('author_id')})"
    done = _among("review_status", ("reviewed", "adjudicated"))
    forbidden = " or ".join(f"contains(lower({_json_text('source_uri_or_note')} || ' ' || {_json_text('image_ref')}), '{m}')" for m in records.FORBIDDEN_PROVENANCE)
    is_sure = f"(not {_whole('expected_label')} or not {_whole('uncertainty_option_index')} or ({_json_text('expected_is_uncertainty')} = 'true') = ({_json_text('expected_label')} = {_json_text('uncertainty_option_index')}))"
    ref = _json_text("image_ref")
    image = {
        "image_escapes": ("'image_ref escapes image root'", f"starts_with({ref}, '/') or starts_with({ref}, '../') or starts_with({ref}, 'a/../../')"),
        "image_missing": (f"'image does not exist: ' || {ref}", f"size is null or {ref} = 'none.png'"),
        "image_empty": ("'image is empty'", "size = 0"),
        "image_corrupt": ("'image cannot be decoded'", "not is_gif"),
        "image_hash": ("'image_sha256 does not match image bytes'", f"{name['image_sha256']} and {_type('image_sha256')} <> 'NULL'"),
    }
    image_case = lambda part: f"case when not {_text('image_ref')} then null " + " ".join(f"when {test} then {repr(code) if part == 'code' else message}" for code, (message, test) in image.items()) + " end"
    rules = [
        ("'missing'", "'missing fields: ' || array_to_string(lacking, ', ')", "len(lacking) > 0"),
        ("'unknown'", "'unknown fields: ' || array_to_string(unknown, ', ')", "len(unknown) > 0"),
        *[(f"'{k}_text'", f"'{k} must be a non-empty string'", f"{name[k]} and not {_text(k)}") for k in records.TEXT_FIELDS],
        ("'answers'", "'answers must contain exactly three non-empty strings'", f"{name['answers']} and not coalesce({_type('answers')} = 'ARRAY' and json_array_length(j, '$.answers') = 3 and len(list_filter(range(3), lambda k: json_type(j, '$.answers[' || k || ']') = 'VARCHAR' and regexp_matches(json_extract_string(j, '$.answers[' || k || ']'), '\\S'))) = 3, false)"),
        ("'labels'", "'expected_label and uncertainty_option_index must be 0, 1, or 2'", f"({name['expected_label']} and not {_whole('expected_label')}) or ({name['uncertainty_option_index']} and not {_whole('uncertainty_option_index')})"),
        ("'is_uncertainty'", "'expected_is_uncertainty is inconsistent with label/index'", f"{name['expected_is_uncertainty']} and not coalesce({_type('expected_is_uncertainty')} = 'BOOLEAN' and {is_sure}, false)"),
        ("'subsets'", "'subsets must be a non-empty unique list of supported values'", f"""{name['subsets']} and not coalesce({_type('subsets')} = 'ARRAY' and cast(json_extract(j, '$.subsets') as varchar) in ('["ambiguous","elimination"]', '["ambiguous", "elimination"]'), false)"""),
        ("'provenance'", "'unsupported provenance_type'", f"{name['provenance_type']} and not {_among('provenance_type', records.PROVENANCES)}"),
        ("'forbidden'", "'evaluation/test-derived provenance is forbidden'", f"{name['source_uri_or_note']} and {name['image_ref']} and ({forbidden})"),
        ("'review'", "'invalid review status or reviewer_id'", f"({name['review_status']} and not {_among('review_status', records.REVIEW_STATUSES)}) or ({name['reviewer_id']} and not ({_type('reviewer_id')} = 'NULL' or {_text('reviewer_id')}))"),
        ("'reviewer'", "'reviewed records require an independent reviewer'", f"{done} and {name['reviewer_id']} and ({same} or {_type('reviewer_id')} = 'NULL')"),
        ("'self_review'", "'generated authors cannot self-review'", f"{done} and {same} and {_among('provenance_type', ('synthetic', 'generated_allowed'))}"),
        ("'split'", "'split must be selection or sealed_holdout'", f"{name['split']} and not {_among('split', records.SPLITS)}"),
        (image_case("code"), image_case("message"), f"({image_case('code')}) is not null"),
        ("'seed'", "'randomization_seed must be an integer or null'", f"{name['randomization_seed']} and {_type('randomization_seed')} not in ('UBIGINT', 'BIGINT', 'NULL')"),
    ]
    structs = ", ".join(f"case when {test} then struct_pack(code := {code}, message := {message}) end" for code, message, test in rules)
    return f"""with d as (select doc_id, {LINE} as line, {draw(127, 20)} > 0 as has_image, {CONTENT} as content from documents),
k as (select doc_id, line, case when json_valid(line) and json_type(line) = 'OBJECT' then cast(line as json) end as j, case when has_image then strlen(content) end as size, starts_with(content, 'GIF89a') as is_gif from d),
m as (select *, list_filter([{required}], lambda x: not list_contains(json_keys(j), x)) as lacking, list_sort(list_filter(json_keys(j), lambda x: x not in ({known}))) as unknown from k),
f as (select doc_id, case when j is null then [struct_pack(code := case when trim(coalesce(line, '')) = '' then 'blank' when starts_with(line, '[') then 'object' else 'json' end,
    message := case when trim(coalesce(line, '')) = '' then 'blank lines are not allowed' when starts_with(line, '[') then 'record must be an object' else 'Expecting value: line 1 column 15 (char 14)' end)]
  else list_filter([{structs}], lambda x: x is not null) end as faults from m)
select doc_id, array_to_string(list_transform(faults, lambda x: x.code), ',') as codes, faults[1].message as first, nullif(array_to_string(list_transform(faults, lambda x: 'line ' || doc_id || ': ' || x.message), '; '), '') as error from f"""


def _paths_sql() -> str:
    """Here .. is taken away by patterns, as often as these paths can hold it."""
    plain = "regexp_replace(regexp_replace('/' || v, '/(\\./)+', '/', 'g'), '/+', '/', 'g')"
    up = lambda x: f"regexp_replace({x}, '/[^/]+/\\.\\.(/|$)', '/')"
    top = lambda x: f"regexp_replace({x}, '^(/\\.\\.)+(/|$)', '/')"
    whole = lambda base: f"rtrim({top(up(up(up(plain.replace(chr(39) + '/' + chr(39) + ' || v', f'{chr(39)}{base}/{chr(39)} || v')))))}, '/')"
    return f"""with p as (select page_id, doc_id is not null as known, {RAW_PATH} as raw from pages left join (select doc_id from labels) l on page_id = doc_id),
v as (select *, trim(coalesce(raw, '')) as v from p),
w as (select *, starts_with(v, '/') as absolute, case when starts_with(v, '/') then rtrim({plain.replace("'/' || v", "v")}, '/') else {whole('/data')} end as at_root, {whole('/data/train')} as at_csv from v),
r as (select *, case when absolute or starts_with(at_root || '/', '/data/{WANTED}/') then at_root else at_csv end as resolved from w),
f as (select *, case when v = '' then null when absolute then 'absolute' when regexp_matches(v, '(^|/)\\.\\.(/|$)') then 'escaping' when not starts_with(resolved || '/', '/data/{WANTED}/') then 'elsewhere' when not known then 'missing' end as code from r)
select page_id, resolved, code, 'row ' || page_id || ' ' || case code when 'absolute' then 'has absolute image_path: ' || v when 'escaping' then 'has escaping image_path: ' || v
  when 'elsewhere' then 'image_path is not under {WANTED}: ' || v when 'missing' then 'image_path does not exist: ' || v end as error from f"""


ORACLE = {
    "record_faults": _duck(_records_sql()),
    "answer_lists": _duck(f"""with d as (select doc_id, text, lang, {draw(125, 14)} as k from documents),
e as (select *, case k when 0 then 'has malformed answers JSON: Expecting value' when 8 then 'has malformed answers JSON: Expecting value' when 1 then 'has malformed answers JSON: Expecting '','' delimiter'
  when 2 then 'answers must be a JSON list' when 3 then 'answers must be a JSON list' when 4 then 'must contain exactly 3 answers, found 1' when 5 then 'answer 2 must be a string' when 6 then 'answer 1 is empty' when 7 then 'answer 3 must be a string'
  else case when text is null or lang is null then 'has malformed answers JSON: Expecting value' when not regexp_matches(text, '[^ \\t\\n\\r\\v\\f]') then 'answer 1 is empty' end end as error from d)
select doc_id, case when error is null then md5(regexp_replace(text, '^[ \\t\\n\\r\\v\\f]+|[ \\t\\n\\r\\v\\f]+$', '', 'g') || '|x|' || lang) end as answers_md5, error from e"""),
    "image_paths": to_duck(_paths_sql()),
}
