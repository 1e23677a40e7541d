"""Language identification by known words, with shorter and shorter character n-grams for the others."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.scratch import Scratch

WORD = re.compile(r"[^\W\d_]+")
#: Entries that a task counts before it hands them on; it bounds its memory.
COUNTER_ENTRIES = 300_000
UNKNOWN = "und"
#: Orders of the n-grams, longest first.
ORDERS = (4, 3, 2, 1)
#: Log frequencies are whole multiples of 1 / UNIT, so that sums are the same in whatever order they are taken.
UNIT = 1 << 20
SMOOTH = 0.5


@dataclass
class LanguageModel:
    """Log frequencies by language, in units: every counted word and n-gram, in tables; some words in memory as well.

    ``words`` has columns key, logs (one for each language) and head (whether ``places`` has it); ``grams`` has order, key and
    logs. ``head`` holds the logs of the words of ``places``: a shortcut that changes no score.
    """

    languages: list[str]
    words: DataFrame | None = None
    grams: DataFrame | None = None
    places: dict[str, int] = field(default_factory=dict)
    head: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))


def grams_of(word: str, order: int) -> list[str]:
    """The n-grams of a word between its borders; of order 1, its letters."""
    framed = f"^{word}$" if order > 1 else word
    return [framed[i : i + order] for i in range(len(framed) - order + 1)]


def _counted(rows: DataFrame, languages: Sequence[str], pairs, keys: str) -> DataFrame:
    """``keys``, and counts (n0, n1, ..., one for each language) over what ``pairs`` yields for a batch: counted in tasks
    first, then over the corpus."""
    place = {x: i for i, x in enumerate(languages)}
    names = keys.split(", ")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            flat = [(*(k if isinstance(k, tuple) else (k,)), place[lang], n) for lang, c in found.items() for k, n in c.items()]
            found.clear()
            columns = zip(*flat, strict=True) if flat else [[] for _ in range(len(names) + 2)]
            types = [pa.string() if x.endswith("string") else pa.int32() for x in names] + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*(x.split()[0] for x in names), "lang", "n"])

        for batch in batches:
            for lang, add in pairs(batch):
                add(found.setdefault(lang, Counter()))
                if len(found[lang]) > COUNTER_ENTRIES:
                    yield flush()
        yield flush()

    sums = [F.coalesce(F.sum(F.when(F.col("lang") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(len(languages))]
    return rows.mapInArrow(count, f"{keys}, lang int, n long").groupBy(*(x.split()[0] for x in names)).agg(*sums)


def _words_in(batch: pa.RecordBatch):
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        words = WORD.findall(text.lower())
        yield lang, lambda c, words=words: c.update(words)


def _grams_in(languages: Sequence[str]):
    def pairs(batch: pa.RecordBatch):
        for word, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            grams = [(order, g) for order in ORDERS for g in grams_of(word, order)]
            for lang, n in zip(languages, counts, strict=True):
                if n:

                    def add(c: Counter, grams=grams, n=n) -> None:
                        for g in grams:
                            c[g] += n

                    yield lang, add

    return pairs


def _logs(counts: list[Column], sizes: list[Column], kinds: Column) -> Column:
    """Smoothed log frequencies in units, as an array."""
    return F.array(*[F.round(F.log((c + SMOOTH) / (s + SMOOTH * kinds)) * UNIT).cast("long") for c, s in zip(counts, sizes, strict=True)])


def learn_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", head_words: int = 150_000) -> LanguageModel:
    """Count words, and the n-grams in them, by language over every document with a text and a language.

    The model keeps all of them, in tables in the shared folder. Words that are frequent enough for at most ``head_words`` of
    them are held in memory too, which only saves work: scores do not depend on that number. Counting is partial in each task,
    so shuffles carry distinct words, not texts. Only the names of the languages, the histogram of the words' totals down to
    that frequency, and these words reach the driver. An empty table gives a model without languages.
    """
    scratch = Scratch(docs.sparkSession, "languages")
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # one row per language
    model = LanguageModel(languages)
    if not languages:
        return model
    ns = [F.col(f"n{i}") for i in range(len(languages))]
    counted = scratch.table(_counted(rows, languages, _words_in, "key string"), "counts").withColumn("total", sum(ns[1:], ns[0]))
    size = counted.agg(F.count("*").alias("kinds"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(ns)]).first()
    if not size["kinds"]:
        return model
    least, held = size["kinds"] + sum(size[1:]) + 1, 0
    for r in counted.groupBy("total").agg(F.count("*").alias("keys")).orderBy(F.desc("total")).limit(head_words).collect():
        held += r["keys"]
        if held > head_words:
            break
        least = r["total"]
    logs = _logs(ns, [F.lit(size[f"s{i}"]) for i in range(len(languages))], F.lit(size["kinds"]))
    model.words = scratch.table(counted.select("key", logs.alias("logs"), (F.col("total") >= least).alias("head")), "words")
    head = sorted((r["key"], r["logs"]) for r in model.words.filter("head").select("key", "logs").collect())  # head_words at most
    model.places = {k: i for i, (k, _) in enumerate(head)}
    model.head = np.array([x for _, x in head], np.int64).reshape(-1, len(languages))

    grams = scratch.table(_counted(counted.select("key", F.array(*ns)), languages, _grams_in(languages), "order int, key string"), "gram-counts")
    sizes = grams.groupBy(F.col("order").alias("_o")).agg(F.count("*").alias("kinds"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(ns)])
    joined = grams.join(F.broadcast(sizes), F.col("order") == F.col("_o"))  # one row per order
    model.grams = scratch.table(joined.select("order", "key", _logs(ns, [F.col(f"s{i}") for i in range(len(ns))], F.col("kinds")).alias("logs")), "grams")
    scratch.drop("counts")
    scratch.drop("gram-counts")
    return model


def _gram_column(word: Column, order: int) -> Column:
    """``grams_of`` as a column."""
    framed = F.concat(F.lit("^"), word, F.lit("$")) if order > 1 else word
    places = F.when(F.length(framed) >= order, F.sequence(F.lit(1), F.length(framed) - order + 1))
    return F.transform(places, lambda i: F.substring(framed, i, F.lit(order)))


def _backed_off(words: DataFrame, model: LanguageModel, scratch: Scratch) -> DataFrame:
    """(word, logs) of distinct ``words``: the mean over their n-grams of the longest order of which any is known, rounded.

    Orders go from long to short, and only words without a known n-gram go on to the next; words without any are left out.
    """
    n = len(model.languages)
    parts = []
    for order in ORDERS:
        grams = words.select("word", F.explode(_gram_column(F.col("word"), order)).alias("key"))
        known = grams.join(model.grams.filter(F.col("order") == order).select("key", "logs"), "key")
        means = known.groupBy("word").agg(F.array(*[F.round(F.sum(F.col("logs")[i]) / F.count("*")).cast("long") for i in range(n)]).alias("logs"))
        parts.append(scratch.table(means, f"order-{order}"))
        if order > 1:
            words = scratch.table(words.join(parts[-1], "word", "left_anti"), f"left-{order}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def identify_language(docs: DataFrame, model: LanguageModel, keep: Sequence[str | Column] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep``, then lang_pred and score of every whole text.

    A known word scores its log frequency in each language, any other word the mean of its n-grams of the longest known
    order. The language with the highest sum wins, the first by name among equals; score is its share when the sums are taken
    as log likelihoods. Null text, or one without a letter: ``und`` with score 0, as is every text under a model without
    languages. Repeated rows each give a row; columns outside ``keep`` are not returned, and a kept column named lang_pred or
    score is replaced.

    Texts are read once and never shuffled. Words in the model's memory are added up there; the distinct others of each
    document are joined with the model's tables, and each distinct unknown word is backed off once.
    """
    scratch = Scratch(docs.sparkSession, "identify")
    kept = docs.select(F.struct(*keep).alias("kept"))
    inner = kept.schema["kept"].dataType
    own = [F.col(f"kept.`{c}`") for c in inner.names if c not in ("lang_pred", "score")]
    if not model.languages or model.words is None:
        return kept.select(*own, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.places, model.head))
    n = len(model.languages)
    others = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, logs = shared.value
        for batch in batches:
            sums, rest = [], []
            for text in batch.column(2).to_pylist():
                if text is None or not any(map(str.isalpha, text)):
                    sums.append(None)
                    rest.append([])
                    continue
                counts = Counter(WORD.findall(text.lower()))
                at = np.fromiter(map(places.get, counts, repeat(-1)), np.int64, len(counts))
                times = np.fromiter(counts.values(), np.int64, len(counts))
                known = at >= 0
                sums.append((times[known] @ logs[at[known]]).tolist())
                words = list(counts)
                rest.append([{"word": words[k], "n": int(times[k])} for k in np.flatnonzero(~known)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.list_(pa.int64())), pa.array(rest, others)], names=["row", "kept", "sums", "others"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"), F.col(text_col).alias("text"))
    first = scratch.table(texts.mapInArrow(read, f"row long, kept {inner.simpleString()}, sums array<long>, others array<struct<word: string, n: long>>"), "rows", compression="zstd")
    each = first.select("row", F.inline("others"))
    table = model.words.filter(~F.col("head")).select(F.col("key").alias("word"), "logs")
    joined = scratch.table(each.join(table, "word", "left").groupBy("row", F.when(F.col("logs").isNull(), F.col("word")).alias("unknown")).agg(*[F.coalesce(F.sum(F.col("n") * F.col("logs")[i]), F.lit(0)).alias(f"s{i}") for i in range(n)], F.sum("n").alias("n")), "joined", compression="zstd")
    unknown = scratch.table(joined.filter("unknown is not null").select(F.col("unknown").alias("word")).distinct(), "unknown")
    backed = _backed_off(unknown, model, scratch)
    more = joined.filter("unknown is not null").join(backed.withColumnRenamed("word", "unknown"), "unknown").select("row", *[(F.col("n") * F.col("logs")[i]).alias(f"s{i}") for i in range(n)])
    added = joined.filter("unknown is null").select("row", *[f"s{i}" for i in range(n)]).unionByName(more).groupBy("row").agg(F.array(*[F.sum(f"s{i}") for i in range(n)]).alias("added"))
    total = F.when(F.col("sums").isNotNull(), F.zip_with("sums", F.coalesce("added", F.array(*[F.lit(0).cast("long")] * n)), lambda a, b: a + b))
    judged = first.join(added, "row", "left").select("kept", total.alias("total"))
    best = F.array_max("total")
    pred = F.get(F.array(*[F.lit(x) for x in model.languages]), (F.array_position("total", best) - 1).cast("int"))
    score = 1 / F.aggregate(F.transform("total", lambda x: F.exp((x - best) / UNIT)), F.lit(0.0), lambda a, x: a + x)
    return judged.select(*own, F.coalesce(pred, F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"))
