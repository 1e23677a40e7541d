"""Queries on building, sampling, auditing and reviewing a governed corpus, and on comparing runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.jobs.inputs import MODELS, RUNS_SQL, runs, table
from sluicework.operators import comparison, governance, integrity, sampling
from sluicework.sources.tables import in_order

SEED = 236722600
TARGETS = {"en": 60, "de": 30, "fr": 30, "es": 20}
#: Thresholds of the audit: counter, name, least (a share below 1), message.
AUDIT = (
    ("subset", "en", 30, "subset en requires at least 30 records"),
    ("subset", "it", 30, "subset it requires at least 30 records"),
    ("position", "0", 0.30, "uncertainty position 0 requires at least 30% coverage"),
    ("position", "1", 0.50, "uncertainty position 1 requires at least 50% coverage"),
    ("quality", "0", 120, "low quality requires at least 120 samples"),
    ("split", "sealed_holdout", 0.90, "sealed_holdout requires at least 90% coverage"),
)


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.hash_sample(docs, 100, SEED, F.col("source"), F.col("doc_id"))


def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_holdout(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", TARGETS, SEED)


def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # near: the same text but for case and blanks
    marked = sampling.first_wins(docs, F.sha2("text", 256), F.md5(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", "")), "doc_id")
    return marked.select("doc_id", "reason")


def basket_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("qty"), "l_returnflag", "l_discount")
    rules = (("group", F.col("l_returnflag") == "R"), ("small", F.col("qty") < 5), ("geometry", F.col("l_discount") > 0.08))
    kept, _ = governance.person_boxes(lines, rules, "l_orderkey", ("qty", "l_linenumber"))
    listed = F.array_join(F.transform("boxes", lambda b: F.concat_ws(":", b["qty"], b["l_linenumber"])), " ")
    return kept.select("l_orderkey", F.size("boxes").alias("boxes"), listed.alias("listed"))


def basket_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("qty"), "l_returnflag", "l_discount")
    rules = (("group", F.col("l_returnflag") == "R"), ("small", F.col("qty") < 5), ("geometry", F.col("l_discount") > 0.08))
    return governance.person_boxes(lines, rules, "l_orderkey", ("qty", "l_linenumber"))[1]


def attribution_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    accepted = (F.col("o_orderstatus") != "P") & (F.trim("o_orderpriority") != "")
    return governance.attribution_join(customers, orders, "c_custkey", "o_orderkey", accepted).drop("o_orderstatus")


def url_policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (("scheme", ~F.startswith("url", F.lit("https://"))), ("host", F.col("url").rlike(r"^https://[^/]*(spam|pills|casino)")), ("query", F.contains("url", F.lit("?"))))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", F.coalesce(governance.first_failure(rules), F.lit("eligible")).alias("reason"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    rows = labels.join(runs(spark, sf_dir), "doc_id")
    columns = {"quality": F.col("quality"), "position": F.col("u"), "split": F.expr("case when doc_id % 3 = 0 then 'sealed_holdout' else 'selection' end"), "total": F.lit("all")}
    return governance.audit_counts(rows, columns, {"subset": F.array(F.col("lang"), F.col("source"), F.col("lang"))})


def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)


def audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.violations(_audit(spark, sf_dir), "total", AUDIT)


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"))
    return integrity.duplicate_ids(hashed, "sha256")


def _sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The labelled documents in order, and the pages that are put beside them."""
    labels, pages = table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages")
    found = F.when(F.contains("url", F.lit("www")), F.col("page_id") + 1).otherwise(F.col("page_id"))
    return labels.select(F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("id")), pages.select(F.col("page_id").alias("ordinal"), found.alias("id"))


def ordered_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.ordered_mismatches(*_sequences(spark, sf_dir), "ordinal", "id")


def first_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.first_mismatch(*_sequences(spark, sf_dir), "ordinal", "id")


def id_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return integrity.id_difference(table(spark, sf_dir, "labels").select("doc_id"), pages, "doc_id")


def run_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).select((F.col("doc_id") - F.col("doc_id") % 4 % 2).alias("id"), F.expr("case when n_chars % 9 = 0 then 3 else m2 end").alias("label"))
    return integrity.run_violations(rows, "id", "label", 8500)


def review_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels")
    reviews = labels.select("doc_id", F.expr("case when toxic = 1 then 'dispute' when quality = 1 then 'reviewed' else 'rejected' end").alias("decision"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    final = labels.join(pages, "doc_id", "left_semi").select("doc_id", F.expr("case when quality = 1 then 'accept' else 'reject' end").alias("decision"))
    return governance.route_reviews(docs, reviews, final, "doc_id").groupBy("outcome").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def unknown_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.unknown_ids(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), "doc_id")


def disagreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.disagreement_matrix(runs(spark, sf_dir), MODELS)


def risk_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.risk_sets(runs(spark, sf_dir), MODELS[0], MODELS[1:], "u")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.transitions(runs(spark, sf_dir), MODELS[0], MODELS[1:], "u")


def distribution_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping buckets of turns by what they hold."""
    turns = table(spark, sf_dir, "conversations").withColumn("t", F.lower("text"))
    buckets = {"question": F.contains("t", F.lit("?")), "long": F.length("t") > 200, "digits": F.col("t").rlike("[0-9]"), "polite": F.contains("t", F.lit("please"))}
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in buckets.items()]))
    return turns.select("role", F.explode(names).alias("bucket")).groupBy("role", "bucket").agg(F.count("*").alias("n"))


def turn_restoration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns put back in order: their places in it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return in_order(turns, "conv_id", "turn", "role", "n")


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("bytes"))


QUERIES = (
    hash_sample, stratified_holdout, first_wins_dedupe, basket_filter, basket_counters, attribution_join, url_policy_filter, corpus_audit, audit_violations, duplicate_texts, ordered_mismatch,
    first_mismatch, id_difference, run_violations, review_routing, unknown_decisions, disagreement_matrix, risk_sets, transitions, distribution_profile, turn_restoration, content_hashes,
)

_ORDERED = """l as (select doc_id as ordinal, doc_id as left_id from labels),
r as (select page_id as ordinal, case when contains(url, 'www') then page_id + 1 else page_id end as right_id from pages),
j as (select coalesce(l.ordinal, r.ordinal) as ordinal, left_id, right_id from l full join r on l.ordinal = r.ordinal)"""
_BASKET = """j as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as qty, case when l_returnflag = 'R' then 'group' when cast(l_quantity as bigint) < 5 then 'small' when l_discount > 0.08 then 'geometry' end as failure from lineitem)"""
_AUDIT = f"""r as ({RUNS_SQL}), a as (select l.quality, r.* from labels l join r on l.doc_id = r.doc_id),
c as (select 'quality' as counter, cast(quality as varchar) as name, count(*) as n from a group by quality union all select 'position', cast(u as varchar), count(*) from a group by u
union all select 'split', case when doc_id % 3 = 0 then 'sealed_holdout' else 'selection' end, count(*) from a group by 2 union all select 'total', 'all', count(*) from a having count(*) > 0
union all select 'subset', x, count(*) from (select lang as x from a union all select source from a) group by x)"""
ORACLE = {
    "hash_sample": f"select doc_id, source, sha256('{SEED}:' || source || ':' || cast(doc_id as varchar)) as key from documents order by key, doc_id limit 100",
    "stratified_holdout": f"""with k as (select doc_id, lang, row_number() over (partition by lang order by sha256('{SEED}:holdout:' || lang || ':' || cast(doc_id as varchar)), doc_id) as k from documents)
select lang, doc_id, case when k <= case lang {" ".join(f"when '{s}' then {n}" for s, n in TARGETS.items())} else 0 end then 'sealed_holdout' else 'selection' end as split from k""",
    "first_wins_dedupe": """with k as (select doc_id, text, first_value(doc_id) over w as f, first_value(sha256(text)) over w as d from documents window w as (partition by md5(regexp_replace(lower(text), '[\\x20\\x09-\\x0D]+', '', 'g')) order by doc_id))
select doc_id, case when doc_id = f then 'accepted' when sha256(text) = d then 'exact_duplicate' else 'near_duplicate' end as reason from k""",
    "basket_filter": f"""with {_BASKET} select l_orderkey, cast(count(*) as int) as boxes, string_agg(cast(qty as varchar) || ':' || cast(l_linenumber as varchar), ' ' order by qty, l_linenumber) as listed
from j where failure is null group by l_orderkey having count(*) between 2 and 4""",
    "basket_counters": f"with {_BASKET} select coalesce(failure, 'eligible') as reason, count(*) as n from j group by 1",
    "attribution_join": """with a as (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as k, count(*) over (partition by o_custkey) as n from orders where o_orderstatus <> 'P' and trim(o_orderpriority) <> '')
select c_custkey, c_name, o_orderkey, o_orderpriority, n as n_accepted from customer join a on c_custkey = o_custkey where k = 1""",
    "url_policy_filter": """select page_id, case when not starts_with(url, 'https://') then 'scheme' when regexp_matches(url, '^https://[^/]*(spam|pills|casino)') then 'host' when contains(url, '?') then 'query' else 'eligible' end as reason from pages""",
    "corpus_audit": f"with {_AUDIT} select counter, name, n from c",
    "audit_violations": f"""with {_AUDIT}, v(ord, counter, name, least, message) as (values {", ".join(f"({k}, '{c}', '{n}', {float(x)}, '{m}')" for k, (c, n, x, m) in enumerate(AUDIT))}),
w as (select coalesce(sum(n), 0) as whole from c where counter = 'total')
select ord, message from (select v.*, coalesce(c.n, 0) as n, whole from v left join c on v.counter = c.counter and v.name = c.name cross join w)
where case when least < 1 then case when whole > 0 then cast(n as double) / whole else 0.0 end < least else n < least end""",
    "duplicate_texts": "select sha256(text) as sha256, count(*) as n from documents group by 1 having count(*) > 1",
    "ordered_mismatch": f"with {_ORDERED} select ordinal, left_id, right_id from j where left_id is distinct from right_id",
    "first_mismatch": f"""with {_ORDERED} select count(left_id) as n_left, count(right_id) as n_right, count(*) filter (left_id is distinct from right_id) as n_differ, min(ordinal) filter (left_id is distinct from right_id) as first from j""",
    "id_difference": """select 'missing' as side, doc_id from labels where doc_id not in (select page_id from pages) union all select 'extra', page_id from pages where page_id not in (select doc_id from labels)""",
    "run_violations": f"""with r as ({RUNS_SQL}), x as (select doc_id - doc_id % 4 % 2 as id, case when n_chars % 9 = 0 then 3 else m2 end as label from r),
g as (select id, count(*) as k, count(*) filter (label not in (0, 1, 2)) as bad from x group by id)
select * from (select 'row_count' as rule, cast(abs(sum(k) - 8500) as bigint) as n from g union all select 'duplicate_id', cast(sum(k - 1) as bigint) from g union all select 'label_domain', cast(sum(bad) as bigint) from g) where n > 0""",
    "review_routing": """with x as (select d.doc_id, l.doc_id is null as pending, toxic, quality from documents d left join labels l on d.doc_id = l.doc_id),
o as (select doc_id, case when pending then 'pending' when toxic <> 1 then case when quality = 1 then 'reviewed' else 'rejected' end when doc_id not in (select page_id from pages) then 'dispute_open' when quality = 1 then 'adjudicated' else 'dispute_rejected' end as outcome from x)
select outcome, count(*) as n, cast(sum(doc_id) as bigint) as id_sum from o group by outcome""",
    "unknown_decisions": "select doc_id from labels where doc_id not in (select page_id from pages)",
    "disagreement_matrix": f"with r as ({RUNS_SQL}) "
    + " union all ".join(f"select '{a}' as left, '{b}' as right, count(*) as rows, count(*) filter ({a} <> {b}) as disagree from r" for i, a in enumerate(MODELS) for b in MODELS[i + 1 :]).replace("as left", 'as "left"').replace("as right", 'as "right"').replace("as rows", 'as "rows"'),
    "risk_sets": f"""with r as ({RUNS_SQL}), v as (select doc_id, m0, u, unnest([m1, m2, m3, m4]) as m from r),
c as (select doc_id, m0, u, m, count(*) as n from v group by all),
d as (select doc_id, m0, u, coalesce(sum(n) filter (m <> m0), 0) as against, count(*) as kinds, coalesce(max(n) filter (m <> m0), 0) as most, coalesce(max(n) filter (m <> u), 0) as person from c group by doc_id, m0, u)
select count(*) as "rows", count(*) filter (against = 0) as all_agree, count(*) filter (against = 4 and kinds = 1) as base_alone, count(*) filter (most >= 3) as outvoted, count(*) filter (m0 = u and person >= 3) as uncertain_against_person from d""",
    "transitions": f"""with r as ({RUNS_SQL}), v as (select m0, u, unnest(['m1', 'm2', 'm3', 'm4']) as model, unnest([m1, m2, m3, m4]) as m from r)
select model, case when m0 = m then 'same' when m0 = u then 'unknown_to_person' when m = u then 'person_to_unknown' else 'person_to_other' end as kind, count(*) as n from v group by 1, 2""",
    "distribution_profile": """with t as (select role, lower(text) as t from conversations)
select role, bucket, count(*) as n from (select role, 'question' as bucket from t where contains(t, '?') union all select role, 'long' from t where length(t) > 200
union all select role, 'digits' from t where regexp_matches(t, '[0-9]') union all select role, 'polite' from t where contains(t, 'please')) group by role, bucket""",
    "turn_restoration": """select conv_id, turn, role, cast(length(text) as int) as n, row_number() over (partition by conv_id order by turn, role, length(text)) as place from conversations""",
    "content_hashes": "select doc_id, sha256(text) as sha256, md5(text) as md5, cast(strlen(text) as bigint) as bytes from documents",
}
