"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluicework.scratch import Scratch, cut

#: The kinds in their listed order, each with its pattern, the group that holds the value and the least
#: length of that value. A match that is too short is consumed and dropped. A run of hex digits is a maximal one, and an
#: access key with too short a tail holds no longer one, so for these two the least length stands in the pattern.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Added by the method: long runs that mix letters and digits, kept only where few owners have them.
OPAQUE = ("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{32,}", 0, 32)
KINDS = (*BASE, OPAQUE)
MARK = "[secret]"


def _candidates(text: Column) -> Column:
    """The matches of all patterns, leftmost and non-overlapping for each, null without any: (ord, gap, length, sound, hash).

    Spark gives matches and the text between them, not their places; ``gap`` and ``length`` are the lengths of both.
    """
    parts, none = [], F.array().cast("array<struct<ord:int,gap:int,length:int,sound:boolean,hash:string>>")
    for order, (_, pattern, group, least) in enumerate(KINDS):
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        rows = F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))

        def entry(x: Column, order: int, least: int) -> Column:
            return F.struct(F.lit(order).alias("ord"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("length"), (F.length(x["value"]) >= least).alias("sound"), F.sha2(x["value"], 256).alias("hash"))

        parts.append(F.when(text.rlike(pattern), _each(rows, entry, order, least)).otherwise(none))
    return F.nullif(F.concat(*parts), none)


def _each(rows: Column, entry, *given) -> Column:
    return F.transform(rows, lambda x: entry(x, *given))


def _placed(found: DataFrame) -> DataFrame:
    """(row, owner, repo, ord, start, end, hash) of every sound match of ``found`` (row, owner, repo, candidates): base ones,
    and opaque ones that overlap none of these. Running sums over the matches of one text give the places."""
    each = found.select("row", "owner", "repo", F.posexplode("candidates").alias("k", "c")).select("row", "owner", "repo", "k", "c.*")
    so_far = Window.partitionBy("row", "ord").orderBy("k")
    each = each.withColumn("end", F.sum((F.col("gap") + F.col("length")).cast("long")).over(so_far)).withColumn("start", F.col("end") - F.col("length")).filter("sound")
    before = Window.partitionBy("row").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("ord") < len(BASE)
    each = each.withColumn("last_end", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn("next_start", F.min(F.when(is_base, F.col("start"))).over(behind))
    free = ~F.coalesce(F.col("last_end") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("next_start") < F.col("end"), F.lit(False))
    return each.filter(is_base | free).select("row", "owner", "repo", "ord", "start", "end", "hash")


def _judged(placed: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """``placed`` with n_owners, n_repos and live, without opaque matches that do not look live."""
    owned = placed.groupBy("hash", "owner", "repo").agg(F.lit(1)).groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    return placed.drop("owner", "repo").join(owned, "hash").withColumn("live", live).filter((F.col("ord") < len(BASE)) | F.col("live"))


def _texts(docs: DataFrame, text_col: str, owner_col: str, repo_col: str) -> list[Column]:
    """owner, repo and candidates of every row."""
    unknown = F.lit("")
    return [F.coalesce(F.col(owner_col).cast("string"), unknown).alias("owner"), F.coalesce(F.col(repo_col).cast("string"), unknown).alias("repo"), _candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("candidates")]


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", max_owners: int = 2, max_repos: int = 6) -> DataFrame:
    """One row for each row of ``docs``: its id and its spans, with a verdict on each.

    Candidates are the base matches and the long opaque runs that overlap none of them. The hashes of their values are
    counted over the whole corpus by distinct owners and by distinct repositories (``repo_col`` names one together with its
    owner). A value that more than ``max_owners`` owners have, or that stands in more than ``max_repos`` repositories, is a
    widely copied example; the others look live. Base spans always stay; an opaque run stays only if it looks live.

    Columns: the id, base (spans by start, then kind), spans (all); a span has start, ord, kind, end, live, n_owners, n_repos.
    Null or empty text: no spans. Null owner or repository: counted as one unknown owner or repository. Repeated rows each
    give a row, and one owner however often. Other columns of ``docs`` are not read. An empty table gives an empty table.

    The text is read once and never shuffled: only lengths and hashes of candidates are, which are counted before they are
    joined. A value that holds a large share of all rows is one row on the counted side, so that adaptive execution can split
    the other. A text of many matches is sorted by them, n log n for n.
    """
    found = cut(docs.select(F.struct(F.col(id_col)).alias("id"), F.monotonically_increasing_id().alias("row"), *_texts(docs, text_col, owner_col, repo_col)))
    judged = _judged(_placed(found), max_owners, max_repos)
    kind = F.get(F.array(*[F.lit(k) for k, *_ in KINDS]), F.col("ord"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "ord", kind.alias("kind"), "end", "live", "n_owners", "n_repos"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint,live:boolean,n_owners:bigint,n_repos:bigint>>")
    every = found.select("id", "row").join(spans, "row", "left").select("id", F.coalesce("spans", none).alias("spans"))
    return every.select(F.col(f"id.`{id_col}`").alias(id_col), F.filter("spans", lambda s: s["ord"] < len(BASE)).alias("base"), "spans")


#: Marks that are set in one piece of a text: pieces are cut from the text, and marks set in pieces.
PIECE = 64


def _marked(text: Column, segments: Column, mark: str) -> Column:
    """``text`` with ``mark`` in place of each segment (start, end), which are in order and do not overlap."""

    def end_before(k: Column) -> Column:
        return F.when(k > 0, F.get(segments, k - 1)["end"]).otherwise(F.lit(0).cast("long"))

    def piece(c: Column) -> Column:
        inside = F.slice(segments, c * PIECE + 1, F.lit(PIECE))
        start = end_before(c * PIECE)
        return F.struct(F.substring(text, start.cast("int") + 1, (F.element_at(inside, -1)["end"] - start).cast("int")).alias("text"), start.alias("start"), inside.alias("inside"))

    def filled(p: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(p["inside"], i - 1)["end"]).otherwise(p["start"])
            return F.concat(F.substring(p["text"], (begin - p["start"]).cast("int") + 1, (s["start"] - begin).cast("int")), F.lit(mark))

        return F.array_join(F.transform(p["inside"], one), "")

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(segments) - 1) / PIECE).cast("int")), piece)
    last = F.element_at(segments, -1)["end"].cast("int")
    return F.concat(F.array_join(F.transform(pieces, filled), ""), F.substring(text, last + 1, F.lit(2**31 - 1)))


def redact_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = MARK, owner_col: str = "source", repo_col: str = "lang", max_owners: int = 2, max_repos: int = 6
) -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mark``; overlapping spans share one mark.

    Columns, rows and null texts stay as they are, whatever the columns' names. The patterns run once over the texts, which are
    written with their candidates; texts without one, which are nearly all, pass from there untouched and are never shuffled.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"), *_texts(docs, text_col, owner_col, repo_col))
    found = scratch.table(given, "marked", compression="zstd")
    held = found.filter("candidates is not null")
    live = _judged(_placed(held.drop("doc")), max_owners, max_repos).filter("live").select("row", "start", "end")
    ordered = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = live.withColumn("opens", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    merged = opens.withColumn("segment", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    segments = merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("segments"))
    joined = held.select("row", "doc").join(segments, "row", "left")
    text = F.col(f"doc.`{text_col}`")
    cleaned = F.when(F.col("segments").isNull(), text).otherwise(_marked(text, F.col("segments"), mark))
    changed = joined.select(*[cleaned.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
    return changed.unionByName(found.filter("candidates is null").select("doc.*"))
