"""Line-first quality rules, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.text import split_words

#: Phrases of page furniture, matched in lower case anywhere in a line.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in to",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign up for",
    "skip to content",
    "subscribe to our",
    "terms of service",
    "terms of use",
)
#: Characters that n_symbols counts; the first set also gives a line away.
SYMBOLS = r"#*$%&|<>"
DIVIDERS = r"|»›•→·>"
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def _count(text: Column, keep: str) -> Column:
    """How many characters of the class ``keep`` a text has."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def furnished(text: Column) -> Column:
    """Whether a text holds one of the phrases; plain search is many times cheaper here than a pattern of them all."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in BOILERPLATE])


def line_fails(line: Column, marked: Column, phrased: Column) -> Column:
    """Whether a line breaks a rule; a line without a word breaks none.

    punctuation: symbols or exclamation marks at half the words or more, from 4 marks on; or fewer than 25 characters with
    no punctuation at the end. navigation: 3 or more bars, arrows or bullets, one for every 4 words at least. boilerplate:
    one of the listed phrases. ``marked`` and ``phrased`` tell, once for the text, whether any line can break the rules
    on marks and on phrases, so that most texts skip them.
    """
    words = F.size(F.split(F.trim(line), BLANKS))
    marks = _count(line, SYMBOLS + "!")
    dividers = _count(line, DIVIDERS)
    return (
        (marked & (marks >= 4) & (2 * marks >= words))
        | ((F.length(line) < 25) & line.rlike(WORD) & ~line.rlike(r"\p{P}[\x20\x09-\x0D]*$"))
        | (marked & (dividers >= 3) & (4 * dividers >= words))
        | (phrased & furnished(line))
    )


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each 3-word window, in order."""
    n = F.size(words)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])))
    return F.coalesce(hashes, F.array().cast("array<bigint>"))


def repeat_places(words: Column, hashes: Column) -> Column:
    """Places of the windows that the text holds twice or more.

    Hashes are sorted with their places, so that equal windows become neighbours, whose words are then compared: n log n
    steps for n words. Texts whose hashes all differ, which a hash set tells, skip the sort.
    """
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _twice(words: Column, placed: Column) -> Column:
    def same(x: Column, y: Column) -> Column:
        i, j = x["i"], y["i"]
        return F.coalesce((x["h"] == y["h"]) & (words[i] == words[j]) & (words[i + 1] == words[j + 1]) & (words[i + 2] == words[j + 2]), F.lit(False))

    return F.array_compact(F.transform(placed, lambda x, k: F.when(same(x, F.get(placed, k + 1)) | same(x, F.get(placed, k - 1)), x["i"])))


def keep_quality(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """``docs`` without the documents that ``quality_rules`` rejects and, in the others, without the lines that break a rule.
    Columns stay as they are, whatever their names, but for the text."""
    name = "judged"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name), F.col(text_col).alias("text"))
    judged = quality_rules(rows, "text", **limits).filter("kept")
    return judged.select(*[F.col("cleaned_text").alias(c) if c == text_col else F.col(f"{name}.`{c}`").alias(c) for c in docs.columns])


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_lost: float = 0.5) -> DataFrame:
    """Judge every document; adds the columns below and keeps the given ones.

    Lines that break a rule go; a document is rejected (``kept`` false) if the base rule fails (fewer than ``min_words``
    words, or repeated words above ``max_repeat_pct`` percent) or if the removed lines held more than ``max_lost`` of the
    characters of its lines.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_share, cleaned_text, kept. A given
    column of one of these names is replaced. Null or empty text: no words, hence base_failed, and cleaned_text null or
    empty. Repeated rows are judged one by one; an empty table gives an empty table. One narrow pass: no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "cleaned_text", "kept")
    own = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in added]
    q = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(text_col).isNotNull().alias("given"),
        split_words(text).alias("words"),
        F.split(text, "\n").alias("lines"),
        text.rlike(f"[{SYMBOLS}{DIVIDERS}!]").alias("marked"),
        furnished(text).alias("phrased"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
    )
    q = q.withColumn("hashes", window_hashes(F.col("words")))
    q = q.withColumn("placed", repeat_places(F.col("words"), F.col("hashes"))).drop("hashes")
    q = q.withColumn("twice", F.coalesce(_twice(F.col("words"), F.col("placed")), F.array().cast("array<int>"))).drop("placed")
    q = q.withColumn("flags", F.transform("lines", lambda x: line_fails(x, F.col("marked"), F.col("phrased"))))
    inside = F.array_distinct(F.concat("twice", F.transform("twice", lambda i: i + 1), F.transform("twice", lambda i: i + 2)))
    wordy = F.filter("lines", lambda x: x.rlike(WORD))
    stays = F.filter("lines", lambda x, i: ~F.get(F.col("flags"), i))
    q = q.select(
        "doc",
        "given",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(wordy) - F.size(F.array_distinct(wordy))).cast("long").alias("n_dup_lines"),
        F.size(inside).cast("long").alias("n_repeat_words"),
        F.length(F.array_join("lines", "")).alias("all"),
        F.array_join(stays, "\n").alias("left"),
        F.length(F.array_join(stays, "")).alias("stay"),
    )
    q = q.withColumn("lost_share", F.when(F.col("all") > 0, 1 - F.col("stay") / F.col("all")).otherwise(F.lit(0.0)))
    q = q.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    q = q.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost))
    q = q.withColumn("cleaned_text", F.when(F.col("given"), F.col("left")))
    # a generator, which filters on the verdict do not pass: below it they would repeat all the work above, many times over
    return q.select(*own, F.inline(F.array(F.struct(*added))))
