"""DuckDB SQL of the queries that SQL can express, by name."""

from sluicework.llm.licenses import PHRASES, TELLING, TEMPLATES, Telling, label_of, tokens_needed
from sluicework.llm.quality import BOILERPLATE, DIVIDERS, SYMBOLS
from sluicework.llm.secrets import BASE, OPAQUE

_BLANKS = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def _count(text: str, kept: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '[{kept}]', '', 'g')))"


_FAILS = f"""({_count("x", SYMBOLS + "!")} >= 4 and 2 * {_count("x", SYMBOLS + "!")} >= len(string_split_regex(trim(x), '{_BLANKS}')))
 or (length(x) < 25 and regexp_matches(x, '{_WORD}') and not regexp_matches(x, '\\p{{P}}[\\x20\\x09-\\x0D]*$'))
 or ({_count("x", DIVIDERS)} >= 3 and 4 * {_count("x", DIVIDERS)} >= len(string_split_regex(trim(x), '{_BLANKS}')))
 or {" or ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)}"""

op9_quality_rules = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '{_BLANKS}'), lambda x: x <> '') as words, string_split(t, chr(10)) as lines from d),
p as (select r, words, unnest(range(len(words) - 2)) as i from w where len(words) >= 3),
g as (select r, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] as g from p),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
inside as (select r, count(distinct i) as n from (select r, i from twice union all select r, i + 1 from twice union all select r, i + 2 from twice) group by r),
l as (select *, list_filter(lines, lambda x: regexp_matches(x, '{_WORD}')) as wordy, list_filter(lines, lambda x: not ({_FAILS})) as stays from w),
m as (select r, doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars, cast({_count("t", SYMBOLS)} as bigint) as n_symbols,
  cast(len(wordy) - len(list_distinct(wordy)) as bigint) as n_dup_lines, length(array_to_string(lines, '')) as every, length(array_to_string(stays, '')) as stay from l),
j as (select m.*, cast(coalesce(n, 0) as bigint) as n_repeat_words, case when every > 0 then 1 - cast(stay as double) / every else 0.0 end as lost from m left join inside on m.r = inside.r),
k as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from j)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost <= 0.5 as kept, round(lost, 6) as lost_share from k"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]::varchar[]"


_TEMPLATES = ", ".join(
    f"('{label_of(k)}', list_distinct(string_split('{v}', ' ')), {tokens_needed(len(set(v.split())), 0.8)}, {_list(TELLING.get(k, Telling()).must)}, {_list(TELLING.get(k, Telling()).rivals | TELLING.get(k, Telling()).dividers)})" for k, v in TEMPLATES.items()
)
_PHRASES = ", ".join(f"('{v}', string_split('{k}', ' '))" for k, v in PHRASES.items())

op8_license_scan = f"""
with d as (select row_number() over () as r, doc_id, {_LOW} as t from documents),
w as (select r, doc_id, regexp_extract_all(t, '{_TOKEN}') as words from d),
phrases(label, p) as (values {_PHRASES}),
spots as (select r, words, unnest(range(len(words))) as i from w where len(words) > 0),
places as (select r, i, label from spots join phrases on words[i + 1] = p[1] and list_slice(words, i + 1, i + len(p)) = p),
base as (select r, count(*) as n, min(i) as f, max(i) as l, string_agg(distinct label, ',' order by label) as labels from places group by r),
lines as (select r, unnest(string_split(t, chr(10))) as x, unnest(range(len(string_split(t, chr(10))))) as k from d),
blocks as (select r, k, list_distinct(regexp_extract_all(x, '{_TOKEN}')) as b from lines),
templates(label, s, need, must, others) as (values {_TEMPLATES}),
held as (select r, k, label, len(s) as size, len(list_intersect(b, s)) as both_ from blocks join templates on len(b) >= need and len(list_intersect(b, s)) >= need and list_has_all(b, must) and not list_has_any(b, others)),
ranked as (select *, cast(both_ as double) / size as c, rank() over (partition by r, k order by cast(both_ as double) / size desc, size desc) as best from held),
method as (select r, max(c) as c from ranked group by r),
every as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from places union all select r, label from ranked where best = 1) group by r)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n, 0) as n_base, f as first_word, l as last_word, coalesce(base.labels, '') as base_labels, coalesce(every.labels, '') as labels,
case when n > 0 then 1.0 else coalesce(c, 0.0) end as score
from w left join base on w.r = base.r left join every on w.r = every.r left join method on w.r = method.r"""

_KINDS = (*BASE, OPAQUE)
#: RE2 has no look-around: an opaque run is a maximal run that holds a letter and a digit.
_PATTERNS = {kind: (pattern if kind != "opaque" else "[A-Za-z0-9+/_-]{32,}").replace("'", "''") for kind, pattern, _, _ in _KINDS}


def _matches(order: int, kind: str, group: int, least: int) -> str:
    pattern = _PATTERNS[kind]
    mixed = " and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')" if kind == "opaque" else ""
    return f"""select r, {order} as ord, '{kind}' as kind, start, start + length(hit) as stop, value from (
  select r, hit, value, sum(length(gap) + length(hit)) over (partition by r order by k) - length(hit) as start from (
    select r, unnest(range(len(hits))) as k, unnest(hits) as hit, unnest(vals) as value, unnest(list_slice(gaps, 1, len(hits))) as gap from (
      select r, regexp_extract_all(t, '{pattern}', 0) as hits, regexp_extract_all(t, '{pattern}', {group}) as vals, string_split_regex(t, '{pattern}') as gaps from d)))
  where length(value) >= {least}{mixed}"""


op3_secret_scan = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(source, '') as o, coalesce(lang, '') as p from documents),
{", ".join(f"k{i} as ({_matches(i, kind, group, least)})" for i, (kind, _, group, least) in enumerate(_KINDS))},
base as (select * from k0 union all select * from k1 union all select * from k2),
free as (select * from k3 where not exists (select 1 from base b where b.r = k3.r and b.start < k3.stop and k3.start < b.stop)),
every as (select c.*, o, p from (select * from base union all select * from free) c join d on c.r = d.r),
owned as (select value, count(distinct o) as owners, count(distinct (o, p)) as repos from every group by value),
judged as (select every.*, owners, repos, owners <= 2 and repos <= 6 as live from every join owned on every.value = owned.value where ord < 3 or (owners <= 2 and repos <= 6)),
s as (select r, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as c, count(*) filter (kind = 'hex') as h, count(*) filter (live) as n_live, count(*) filter (not live) as n_copied,
  string_agg(cast(owners as varchar) || '/' || cast(repos as varchar), ',' order by start, ord) as spread,
  string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, ord) as spans,
  string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, ord) filter (ord < 3) as base from judged group by r)
select doc_id, coalesce(a, 0) as n_assign, coalesce(c, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied, coalesce(spread, '') as owners_repos from d left join s on d.r = s.r"""

_TAKES_PART = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"


def _integers(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor({scale} * cast(x as double)))"


op11_hard_negatives = f"""
with e as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_integers(256)} as q
  from embeddings where label is not null and {_TAKES_PART}),
s as (select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and a.r <> b.r),
p as (select *, row_number() over (partition by ar order by score desc, other nulls last, br) as k from s where same),
n as (select anchor_id, p.other as positive_id, cast(row_number() over (partition by p.ar, p.k order by s.score desc, s.other nulls last, s.br) as integer) as rank,
    s.other as negative_id, p.score as positive_score, s.score as negative_score
  from p join s using (ar, anchor_id) where p.k <= 5 and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select * from n where rank <= 10"""


def _assigned(books: str) -> str:
    """Each part's nearest entry, the lower number of equals; distances are integers, so that 256 d + e orders both."""
    return f"""select r, p, v, min(256 * cast(vv - 2 * list_inner_product(v, c) + list_inner_product(c, c) as bigint) + e) as found from parts join {books} using (p) group by r, p, v"""


_ROUNDS = ",\n".join(
    f"""a{k} as ({_assigned(f"b{k}")}),
m{k} as (select p, e, pos, floor(sum(x) / count(*)) as x from (select p, found % 256 as e, unnest(range(1, len(v) + 1)) as pos, unnest(v) as x from a{k}) group by p, e, pos),
b{k + 1} as (select b.p, b.e, coalesce(m.c, b.c) as c from b{k} b left join (select p, e, list(x order by pos) as c from m{k} group by p, e) m on b.p = m.p and b.e = m.e)"""
    for k in range(4)
)

op12_vector_codes = f"""
with kept as (select row_number() over (order by vec_id nulls last, embedding) - 1 as r, vec_id, label, {_integers(1024)} as q from embeddings where {_TAKES_PART}),
parts as (select r, p, v, list_inner_product(v, v) as vv from (select r, p, list_slice(q, p * (len(q) // 4) + 1, (p + 1) * (len(q) // 4)) as v from (select r, q, unnest(range(4)) as p from kept))),
b0 as (select p, r as e, v as c from parts where r < 256),
{_ROUNDS},
z as ({_assigned("b4")}),
coded as (select r, string_agg(lower(printf('%02x', found % 256)), '' order by p) as code, cast(sum(found // 256) as bigint) as error from z group by r),
digest as (select sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by p, e, pos)) as codebooks_sha256 from (select p, e, unnest(range(1, len(c) + 1)) as pos, unnest(c) as x from b4))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join kept using (r), digest"""
