"""Queries on what conversations and documents are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.jobs.inputs import table
from sluicework.operators import profile

TOP = 10
#: Overlapping buckets of a turn's normalised text: a pattern each.
BUCKETS = {
    "pointing": r" (the|that|this|thst) ",
    "joining": r" (and|or|ander) ",
    "person": r" (he|she|you|who|him|her) ",
    "place": r" (in|on|at|with) ",
    "asking": r" (is|was|which|what) ",
    "long": r"^( [^ ]+){60}",
}


def top_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent words, phrases of two and three words, and the words that turns begin with, by role."""
    turns = table(spark, sf_dir, "conversations").select("role", profile.words(F.col("text")).alias("w"))
    w = F.col("w")
    facets = {"word": w, "phrase2": profile.phrases(w, 2), "phrase3": profile.phrases(w, 3), "prefix1": profile.prefix(w, 1), "prefix2": profile.prefix(w, 2)}
    return profile.top_values(turns, "role", facets, TOP)


def top_document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of whole documents by language: words, pairs, sources, first words."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", profile.words(F.col("text")).alias("w"))
    facets = {"word": F.col("w"), "phrase2": profile.phrases(F.col("w"), 2), "prefix1": profile.prefix(F.col("w"), 1), "source": F.array("source")}
    return profile.top_values(docs, "lang", facets, TOP)


def bucket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two buckets meet in one turn, by role, and in one conversation, whatever its turns."""
    text = F.concat(F.lit(" "), F.array_join(profile.words(F.col("text")), " "), F.lit(" "))
    mask = profile.bucket_mask({name: F.col("t").rlike(pattern) for name, pattern in BUCKETS.items()})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", text.alias("t")).select("conv_id", "role", mask.alias("mask"))
    talks = turns.groupBy("conv_id").agg(F.bit_or("mask").alias("mask")).select(F.lit("whole conversation").alias("role"), "mask")
    return profile.bucket_pairs(turns.select("role", "mask").unionByName(talks), "role", "mask", list(BUCKETS))


QUERIES = (top_phrases, top_document_words, bucket_pairs)


def _top(table_name: str, group: str, facets: dict[str, str]) -> str:
    """Facets are SQL lists of strings over the words w."""
    values = " union all ".join(f"select '{name}' as facet, {group}, unnest({values}) as value from d" for name, values in facets.items())
    return f"""with d as (select *, list_filter(string_split(trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') as w from {table_name}),
v as ({values}), c as (select facet, {group}, value, count(*) as n from v where value is not null group by all),
r as (select facet, {group}, cast(row_number() over (partition by facet, {group} order by n desc, value) as integer) as rank, value, n from c) select * from r where rank <= {TOP}"""


_PAIR = "list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])"
_TRIPLE = "list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])"
_FIRST, _SECOND = "case when len(w) > 0 then [w[1]] else [] end", "case when len(w) > 1 then [w[1] || ' ' || w[2]] else [] end"
_NAMES = list(BUCKETS)
ORACLE = {
    "top_phrases": _top("conversations", "role", {"word": "w", "phrase2": _PAIR, "phrase3": _TRIPLE, "prefix1": _FIRST, "prefix2": _SECOND}),
    "top_document_words": _top("documents", "lang", {"word": "w", "phrase2": _PAIR, "prefix1": _FIRST, "source": "[source]"}),
    "bucket_pairs": f"""with t as (select conv_id, role, ' ' || trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' as t from conversations),
f as (select conv_id, role, {", ".join(f"regexp_matches(t, '{p}') as {n}" for n, p in BUCKETS.items())} from t),
s as (select role, {", ".join(_NAMES)} from f union all select 'whole conversation', {", ".join(f"bool_or({n})" for n in _NAMES)} from f group by conv_id),
p as ({" union all ".join(f"select role, '{a}' as l, '{b}' as r, {a} as x, {b} as y from s" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :])})
select role, l as "left", r as "right", count(*) filter (x) as n_left, count(*) filter (y) as n_right, count(*) filter (x and y) as n_both from p group by role, l, r""",
}
