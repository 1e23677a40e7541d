"""URL filters: fixed host rules, and association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluicework.llm.text import ascii_lower
from sluicework.scratch import cut

#: Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BLOCK, ALLOW = "=block", "=allow"  # items of the labels; no URL token starts with "="


def url_host(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; both null without one."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the labels of the host, the pieces of those that have hyphens, and the words of the path, numbers as
    one."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    pieces = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.concat(F.lit("/"), F.regexp_replace(x, r"^\p{N}+$", "0")))
    return F.array_sort(F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("."), x)), F.filter(pieces, lambda x: x != ""), words)))


#: Items that one basket brings to FP-growth, besides its label: it lists every subset of a frequent one.
BASKET = 12


def _items(sets: DataFrame, needed: int) -> DataFrame:
    """(item, tokens, place): the tokens that stand in ``needed`` URLs or more; those that always stand together are one item.

    Tokens of the same URLs have the same sums over them. All tokens of an item stand in one URL, which bounds them; the
    number of items is bounded by the support, so that they can be numbered in one task.
    """
    each = sets.select("n", F.xxhash64("tokens").alias("h"), F.xxhash64(F.lit(1), "tokens").alias("h2"), F.explode("tokens").alias("token"))
    counted = each.groupBy("token").agg(F.sum("n").alias("n"), *[F.sum(F.col(h).cast("decimal(38,0)")).alias(h) for h in ("h", "h2")]).filter(F.col("n") >= needed)
    items = counted.groupBy("n", "h", "h2").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return items.select(F.col("tokens")[0].alias("item"), "tokens", F.row_number().over(Window.orderBy(F.col("tokens")[0])).alias("place"))


def _baskets(items: Column, most: int) -> Column:
    """Baskets of at most ``BASKET`` items that hold each combination of up to ``most`` of the items at least once.

    ``items`` are structs of place and item. A larger set is dealt to fixed groups of neighbouring places, and every ``most``
    groups make a basket: the same for all sets, so that their combinations do not multiply.
    """
    width = BASKET // most
    groups = F.array_sort(F.array_distinct(F.transform(items, lambda x: F.floor(x["place"] / width))))

    def chosen(depth: int, after: Column | None) -> Column:
        rest = groups if after is None else F.filter(groups, lambda g: g > after)
        if depth == 1:
            return F.transform(rest, lambda g: F.array(g))
        return F.flatten(F.transform(rest, lambda g: F.transform(chosen(depth - 1, g), lambda more: F.concat(F.array(g), more))))

    def held(combination: Column) -> Column:
        return F.transform(F.filter(items, lambda x: F.array_contains(combination, F.floor(x["place"] / width))), lambda x: x["item"])

    whole = F.array(F.transform(items, lambda x: x["item"]))
    return F.when(F.size(items) <= BASKET, whole).when(F.size(groups) <= most, whole).otherwise(F.transform(chosen(most, None), held))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_urls: int = 5, max_items: int = 4) -> DataFrame:
    """Association rules from token combinations to a label: (tokens, verdict, confidence, support, rule_id).

    ``labelled`` has columns tokens (array of strings) and bad (boolean), one row per labelled URL; rows with a null in either
    are left out. Tokens that always stand together are one item, and a rule is a combination of at most ``max_items`` items:
    with all their tokens, so that any number of shared segments is one item. FP-growth proposes combinations that stand
    with their label in ``min_support`` of the URLs, and in ``min_urls`` of them; the labels of all URLs with a proposed
    combination give its confidence. Pruned are rules below ``min_confidence``, and those whose items hold fewer items of a rule
    of the same verdict that is as confident. Rules of both verdicts stay, so that the surest rule that fits a URL decides it.
    The number of rules depends on the support, not on the rows.
    Without labelled URLs there is no rule.
    """
    spark = labelled.sparkSession
    rows = cut(labelled.filter(F.col("bad").isNotNull() & (F.size("tokens") > 0)).select(F.xxhash64("tokens").alias("set"), "tokens", "bad"))
    sets = cut(rows.groupBy("tokens").agg(F.first("set").alias("set"), F.count("*").alias("n"), F.count_if("bad").alias("n_bad")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    needed = max(min_urls, ceil(min_support * total - 1e-9))
    items = cut(_items(sets, needed))
    listed = sets.select("tokens", F.explode("tokens").alias("item")).join(items.select("item", "place"), "item").groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("held"))
    listed = cut(sets.join(listed, "tokens").select("tokens", "held", "n", "n_bad"))
    dealt = rows.select("tokens", "bad").join(listed.select("tokens", F.explode(_baskets(F.col("held"), max_items)).alias("basket")), "tokens")
    dealt = cut(dealt.select(F.concat("basket", F.array(F.when(F.col("bad"), BLOCK).otherwise(ALLOW))).alias("items")))
    if not (baskets := dealt.count()):
        return spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double, rule_id long")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (needed - 0.5) / baskets)).fit(dealt)
    labels = F.array(F.lit(BLOCK), F.lit(ALLOW))
    found = model.freqItemsets.filter(F.arrays_overlap("items", labels) & F.size("items").between(2, max_items + 1))
    found = cut(found.select(F.array_sort(F.array_except("items", labels)).alias("tokens")).distinct().withColumn("rule_id", F.xxhash64("tokens")))

    # baskets repeat the combinations of large sets, so counts come from the sets themselves
    own = listed.select(F.transform("held", lambda x: x["item"]).alias("tokens"), "n", "n_bad")
    counts = _hits(own, found, ["n", "n_bad"]).groupBy("rule_id").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
    judged = found.join(counts, "rule_id").select("tokens", F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), c.alias("hits"), "n") for v, c in (("block", F.col("n_bad")), ("allow", F.col("n") - F.col("n_bad")))])))
    rules = judged.withColumn("confidence", F.col("hits") / F.col("n")).withColumn("support", F.col("hits") / total).filter((F.col("hits") >= needed) & (F.col("confidence") >= min_confidence))
    rules = cut(rules.select("tokens", "verdict", "confidence", "support").withColumn("rule_id", F.xxhash64("tokens", "verdict")))

    # a rule has few items, so that all its proper parts can be looked up
    parts = F.aggregate("tokens", F.array(F.array().cast("array<string>")), lambda acc, x: F.concat(acc, F.transform(acc, lambda a: F.concat(a, F.array(x)))))
    narrow = rules.select("rule_id", "verdict", "confidence", F.explode(F.filter(parts, lambda a: (F.size(a) > 0) & (F.size(a) < F.size("tokens")))).alias("part"))
    wide = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("least"))
    beaten = narrow.join(wide, ["part", "verdict"]).filter(F.col("least") >= F.col("confidence")).select("rule_id").distinct()
    kept = rules.join(beaten, "rule_id", "left_anti").select("rule_id", "verdict", "confidence", "support", F.explode("tokens").alias("item"))
    spelt = kept.join(items.select("item", "tokens"), "item").groupBy("rule_id", "verdict", "confidence", "support").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"))
    return spelt.select("tokens", "verdict", "confidence", "support", "rule_id")


def _hits(urls: DataFrame, rules: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the columns of ``rules`` for every rule whose tokens a row of ``urls`` holds.

    Inverted index: every rule stands under its rarest token, by the frequency of tokens in ``urls``; a row looks up each of
    its tokens and then compares the whole rule.
    """
    own = [c for c in rules.columns if c != "tokens"]
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("token_rows"))
    placed = rules.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token")
    rarest = placed.groupBy("rule_id").agg(F.min_by("token", F.struct("token_rows", "token")).alias("token"))
    index = rules.withColumnRenamed("tokens", "rule_tokens").join(rarest, "rule_id")
    looked = urls.select(*keep, "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return looked.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0).select(*keep, *own)


def match_rules(urls: DataFrame, rules: DataFrame, key: str = "url_key") -> DataFrame:
    """The best rule of every row of ``urls`` (columns ``key`` and tokens) that any rule fits: (key, rule_id, mined, confidence).

    Best: highest confidence, then support, then a block, then the lower id.
    """
    best = F.max_by(F.struct("rule_id", F.col("verdict").alias("mined"), "confidence"), F.struct("confidence", "support", (F.col("verdict") == "block").alias("b"), (-F.col("rule_id")).alias("i")))
    return _hits(urls, rules, [key]).groupBy(key).agg(best.alias("best")).select(key, "best.*")


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, **mining) -> DataFrame:
    """Host, path, fixed rule, mined rule and verdict of every URL.

    ``labels`` has the columns of ``pages``' id and bad (boolean). FP-growth mines rules from the labelled URLs; where no
    fixed rule fits, the best mined rule decides, and where none of these fits, the URL is allowed. Null URLs, and those
    without ``://``, have empty host and path and are allowed. Repeated rows each give a row. Without labels or pages no rule
    is mined. Only the id and the URL of ``pages`` are read.

    Hosts and paths recur, so rules are matched once for each distinct set of tokens; a host that holds a third of all rows
    weighs no more there than any other.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    read = pages.select(id_col, host.alias("host"), path.alias("path"))
    read = read.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    read = cut(read.withColumn("url_key", F.sha2(F.array_join("tokens", " "), 256)))
    given = labels.select(id_col, "bad").join(read.select(id_col, "tokens"), id_col)
    mined = mine_rules(given.select("tokens", "bad"), **mining)
    distinct = read.groupBy("url_key").agg(F.first("tokens").alias("tokens"))
    matched = cut(match_rules(distinct, mined))
    return read.join(matched, "url_key", "left").select(
        id_col,
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, "mined", F.lit("allow")).alias("verdict"),
        F.col("rule_id").alias("mined_rule"),
        "confidence",
    )
