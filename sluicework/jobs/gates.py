"""Queries on numeric texts, gates of candidates, runs that stop when enough is accepted, and lines of one ordered file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions import numbers
from sluicework.jobs.inputs import draw, table, to_duck, to_spark
from sluicework.jobs.publish import ordered_csv
from sluicework.operators import eligibility, sampling


def _draw(k: int, m: int, key: str) -> str:
    return draw(k, m).replace("doc_id", key)


_LINE = "(l_orderkey * 7 + l_linenumber)"
_FORM = _draw(401, 24, _LINE)
_LOW, _HIGH = "cast(l_discount as string)", "cast(l_tax + 0.5 as string)"
#: Texts of a line's numbers: plain ones, and forms that a permissive reader takes or not.
BOX = {
    "in_group": f"case {_draw(402, 20, _LINE)} when 0 then ' 1 ' when 1 then '2' when 2 then '0_0' when 3 then '+1' when 4 then '' when 5 then '1.0' when 6 then '-0' when 7 then null else '0' end",
    "depicted": f"case {_draw(403, 20, _LINE)} when 0 then '01' when 1 then 'no' when 2 then '_0' else '0' end",
    "x0": f"case {_FORM} when 0 then concat(' ', {_LOW}, ' ') when 1 then 'nan' when 2 then '1_0e-2' when 3 then '.0_5' when 4 then '1__0' when 5 then '-inf' when 6 then '0x1' when 7 then '' when 8 then '٠.٠٢' when 9 then '5.e-2' when 10 then '-0.0' else {_LOW} end",
    "x1": f"case {_FORM} when 11 then 'Infinity' when 12 then '1e400' when 13 then '+0.9_9' when 14 then '1.5' else {_HIGH} end",
    "y0": f"case {_FORM} when 15 then 'e5' when 16 then '0.5f' else '0' end",
    "y1": f"case {_FORM} when 17 then '1e-3' when 18 then '-1' when 19 then '1_' else '0.5' end",
}


def box_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as an annotated box whose fields are texts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(to_spark(e)).alias(c) for c, e in BOX.items()])
    out = numbers.box_outcome(F.col("in_group"), F.col("depicted"), (F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")))
    return lines.select("l_orderkey", "l_linenumber", out.alias("outcome"), numbers.permissive_float(F.col("x0")).alias("x0"), numbers.permissive_integer(F.col("in_group")).alias("in_group"))


_WHO = "o_orderkey"
_SHA = "sha2(o_orderpriority, 256)"
#: A candidate for each order: its date is the release date.
CANDIDATE = {
    "commit": f"case {_draw(411, 25, _WHO)} when 0 then upper(substring({_SHA}, 1, 40)) when 1 then 'main' when 2 then ' ' when 3 then null else substring({_SHA}, 1, 40) end",
    "release_date": f"case {_draw(412, 25, _WHO)} when 0 then concat(cast(o_orderdate as string), ' ') when 1 then '2024-02-30' when 2 then '24-1-1' when 3 then '2026-06-01' when 4 then '2026-05-31' when 5 then '' when 6 then '0000-01-01' else substring(cast(o_orderdate as string), 1, 10) end",
    "remote_api_usage": f"case {_draw(413, 25, _WHO)} when 0 then 'some' when 1 then null else 'none' end",
    "snapshot_sha256": f"case {_draw(414, 25, _WHO)} when 0 then 'xyz' when 1 then '' else {_SHA} end",
    "adapter": f"case {_draw(415, 15, _WHO)} when 0 then 'dummy' else 'own' end",
    "local_files_only": f"case {_draw(416, 15, _WHO)} when 0 then false when 1 then null else true end",
    "snapshot_hash": f"case {_draw(417, 15, _WHO)} when 0 then 'other' else {_SHA} end",
    "revision": f"case {_draw(418, 9, _WHO)} when 0 then '' when 1 then null when 2 then 'other' else substring({_SHA}, 1, 40) end",
    "n_hashes": _draw(419, 3, _WHO),
    "bad_hash": f"{_draw(420, 25, _WHO)} = 0",
    "trust_remote_code": f"{_draw(421, 3, _WHO)} = 0",
    "n_prepared": _draw(422, 20, _WHO),
    "gpu_name": f"case {_draw(423, 6, _WHO)} when 0 then 'RTX A6000' when 1 then ' nvidia  rtx a6000 ' when 2 then 'NVIDIA RTX A6000 Ada' when 3 then null else 'NVIDIA RTX A6000' end",
    "total_vram_mib": f"case {_draw(424, 6, _WHO)} when 0 then 47999 when 1 then null else 48000 end",
    "peak_vram_mib": f"case {_draw(425, 6, _WHO)} when 0 then -1 when 1 then null else 0 end",
}


def candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejections of a candidate made of each order, by code and detail."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(to_spark(e)).alias(c) for c, e in CANDIDATE.items()])
    hashes = F.when(F.col("n_hashes") > 0, F.create_map(F.lit("a.py"), F.when(F.col("bad_hash"), "zz").otherwise(F.sha2(F.lit("a"), 256)))).otherwise(F.create_map().cast("map<string,string>"))
    prepared = F.when(F.col("n_prepared") > 0, F.create_map(F.lit("size"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = rows.withColumns({"custom_code_hashes": hashes, "preprocessing_metadata": prepared})
    found = eligibility.rejections()
    return rows.select("o_orderkey", F.array_join(F.transform(found, lambda r: F.concat_ws("=", r["code"], r["message"])), ";").alias("rejections"))


_FAILED = f"case {draw(431, 11)} when 0 then 'not found' when 1 then 'too large' end"


def acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order of their ids, until half as many as there are are accepted: some fail to load, exact and near copies
    are rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    near = F.md5(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", ""))
    return sampling.accept_until(docs, F.expr(to_spark(_FAILED)), F.sha2("text", 256), near, "doc_id", docs.count() // 2).select("doc_id", "reason")


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as the lines of one CSV file in order of their ids."""
    lines = ordered_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", ("doc_id", "lang", "text"))
    return lines.select("place", F.sha2("line", 256).alias("sha256"))


QUERIES = (box_texts, candidate_gates, acquisition, ordered_lines)
_INT = r"^[+-]?[0-9](_?[0-9])*$"
_NUM = r"^[+-]?([0-9](_?[0-9])*([.]([0-9](_?[0-9])*)?)?|[.][0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$"


def _float(x: str) -> str:
    plain = f"translate(trim({x}), '٠٢', '02')"
    return f"case when regexp_matches({plain}, '{_NUM}') then case when {plain} = '1e400' then cast('inf' as double) else cast(replace({plain}, '_', '') as double) end when lower({plain}) in ('nan', '-inf', 'infinity') then cast({plain} as double) end"


def _integer(x: str) -> str:
    return f"case when regexp_matches(trim({x}), '{_INT}') then cast(cast(replace(replace(trim({x}), '_', ''), '+', '') as bigint) as varchar) end"


_DETAIL = [
    ("manifest", "trim(coalesce(commit, '')) = ''", "'manifest_invalid=commit must be a non-empty string'"),
    ("manifest", "not regexp_matches(commit, '^[0-9a-f]{40}$')", "'commit_unpinned=commit must be 40 lowercase hex'"),
    ("manifest", "trim(release_date) = ''", "'manifest_invalid=release_date must be a non-empty string'"),
    ("manifest", r"not regexp_matches(release_date, '^\d{4}-\d{2}-\d{2}$')", "'manifest_invalid=release_date must be canonical YYYY-MM-DD'"),
    ("manifest", "release_date in ('2024-02-30', '0000-01-01')", "'manifest_invalid=release_date must be YYYY-MM-DD'"),
    ("manifest", f"release_date > '{eligibility.CUTOFF}'", "'cutoff_ineligible=' || release_date"),
    ("manifest", "remote_api_usage is distinct from 'none'", "'remote_api_forbidden=remote_api_usage must be none'"),
    ("manifest", "snapshot_sha256 = ''", "'manifest_invalid=snapshot_sha256 must be a non-empty string'"),
    ("manifest", "snapshot_sha256 = 'xyz'", "'snapshot_hash_invalid=snapshot_sha256 must be lowercase hex'"),
    ("manifest", "n_hashes > 0 and bad_hash", "'custom_code_hash_invalid=custom code hashes must be SHA-256'"),
    ("manifest", "n_prepared = 0", "'serialization_evidence_missing=preprocessing metadata is empty'"),
    ("config", "adapter = 'dummy'", "'adapter_ineligible=dummy adapter cannot enter diagnostic-48'"),
    ("config", "not coalesce(local_files_only, false)", "'remote_api_forbidden=local_files_only must be true'"),
    ("config", "snapshot_hash <> snapshot_sha256", "'snapshot_hash_mismatch=model config differs'"),
    ("config", "revision <> '' and revision <> commit", "'commit_mismatch=model config differs'"),
    ("config", "trust_remote_code and n_hashes = 0", "'custom_code_evidence_missing=trust_remote_code requires verified custom-code hashes'"),
    ("machine", r"not coalesce(regexp_matches(lower(trim(gpu_name)), '^(nvidia\s+)?rtx\s+a6000$'), false)", "'gpu_not_a6000=' || coalesce(gpu_name, 'None')"),
    ("machine", "coalesce(total_vram_mib, 0) < 48000", "'vram_insufficient=' || coalesce(cast(total_vram_mib as varchar), 'None')"),
    ("machine", "coalesce(peak_vram_mib, -1) < 0", "'peak_vram_missing=' || coalesce(cast(peak_vram_mib as varchar), 'None')"),
]


def _listed(part: str) -> str:
    return f"list_filter([{', '.join(f'case when {test} then {text} end' for p, test, text in _DETAIL if p == part)}], lambda x: x is not null)"


def _duck(sql: str) -> str:
    return to_duck(sql).replace("sha2(o_orderpriority, 256)", "sha256(o_orderpriority)")


ORACLE = {
    "box_texts": to_duck(f"""with b as (select l_orderkey, l_linenumber, {", ".join(f"{e} as {c}" for c, e in BOX.items())} from lineitem),
n as (select l_orderkey, l_linenumber, {_integer("in_group")} as g, {_integer("depicted")} as d, {_float("x0")} as x0, {_float("x1")} as x1, {_float("y0")} as y0, {_float("y1")} as y1 from b)
select l_orderkey, l_linenumber, case when coalesce(g, 'x') not in ('0', '1') then 'malformed' when g = '1' then 'group' when coalesce(d, 'x') not in ('0', '1') then 'malformed' when d = '1' then 'depiction'
 when x0 is null or x1 is null or y0 is null or y1 is null then 'malformed' when isnan(x0) or not (0 <= x0 and x0 < x1 and x1 <= 1 and 0 <= y0 and y0 < y1 and y1 <= 1) then 'geometry'
 when (x1 - x0) * (y1 - y0) < 0.01 then 'small' else 'eligible' end as outcome, x0, g as in_group from n"""),
    "candidate_gates": _duck(f"""with c as (select o_orderkey, {", ".join(f"{e} as {c}" for c, e in CANDIDATE.items())} from orders)
select o_orderkey, array_to_string(case when len({_listed("manifest")}) > 0 then [{_listed("manifest")}[1]] when len({_listed("config")}) > 0 then {_listed("config")} else {_listed("machine")} end, ';') as rejections from c"""),
    "acquisition": to_duck(f"""with d as (select doc_id, text, {_FAILED} as failed, (select count(*) // 2 from documents) as wanted from documents),
k as (select *, first_value(doc_id) over w as f, first_value(sha256(text)) over w as g from d where failed is null window w as (partition by md5(regexp_replace(lower(text), '[\\x20\\x09-\\x0D]+', '', 'g')) order by doc_id)),
r as (select doc_id, wanted, case when doc_id = f then 'accepted' when sha256(text) = g then 'exact_duplicate' else 'near_duplicate' end as reason from k union all select doc_id, wanted, failed from d where failed is not null),
c as (select *, count(case when reason = 'accepted' then 1 end) over (order by doc_id rows between unbounded preceding and 1 preceding) as before from r)
select doc_id, reason from c where before < wanted"""),
    "ordered_lines": """with c as (select doc_id, list_transform([cast(doc_id as varchar), lang, text], lambda x: case when regexp_matches(coalesce(x, ''), '[",\\r\\n]') then '"' || replace(x, '"', '""') || '"' else coalesce(x, '') end) as cells from documents)
select row_number() over (order by doc_id) as place, sha256(array_to_string(cells, ',')) as sha256 from c union all select 0, sha256('doc_id,lang,text')""",
}
