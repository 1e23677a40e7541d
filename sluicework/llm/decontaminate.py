"""Benchmark decontamination: rare n-gram seeds join texts to items, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.text import private
from sluicework.scratch import Scratch

WORD = re.compile(r"[^\W_]+")
SEED = 3
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words that a task counts, or remembers the hashes of; it bounds its memory.
MEMO_WORDS = 300_000
#: 64-bit words of a filter at most (64 MB), which is what tasks receive.
FILTER_WORDS = 1 << 23


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score and where it ends in ``window`` and in ``item``, row by row with vector operations.

    A gap in the item moves along the row; its best value is a running maximum once each cell is raised by its distance. Of
    equal ends in a row the middle one is taken, so that many copies are halved rather than cut off one by one.
    """
    n = len(window)
    slope = -GAP * np.arange(n + 1)
    above = np.zeros(n + 1, np.int64)
    best, end, last = 0, 0, 0
    for k, word in enumerate(item, 1):
        row = np.zeros(n + 1, np.int64)
        np.maximum(above[:-1] + np.where(window == word, MATCH, MISMATCH), above[1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        above = np.maximum.accumulate(row + slope) - slope
        if (top := int(above.max())) > best:
            ends = np.flatnonzero(above == top)
            best, end, last = top, int(ends[len(ends) // 2]), k
    return best, end, last


def reach(item: np.ndarray, window: np.ndarray, score: int) -> int:
    """How many of the last words of ``window`` an alignment of that score takes which ends with both ``window`` and ``item``.

    The fewest, if there are several. With a score above 0, at most two other words stand for each that matches.
    """
    item, window = item[::-1], window[::-1][: (MATCH + 1) * len(item)]
    slope = -GAP * np.arange(len(window) + 1)
    above = -slope
    found = len(window)
    for k, word in enumerate(item, 1):
        row = np.full(len(window) + 1, GAP * k, np.int64)
        np.maximum(above[:-1] + np.where(window == word, MATCH, MISMATCH), above[1:] + GAP, out=row[1:])
        above = np.maximum.accumulate(row + slope) - slope
        if (at := int(above.argmax())) < found and above[at] == score:
            found = at
    return found


class _WordHashes(dict):
    """Word to 64-bit hash, emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def gram_hashes(words: list[str], order: int) -> np.ndarray:
    """A 64-bit hash of every n-gram of ``order`` words, in order."""
    n = len(words) - order + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    out = np.full(n, order, np.uint64)
    for k in range(order):
        out = (out ^ hashes[k : n + k]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


class Filter:
    """A Bloom filter of 64-bit hashes: three bits in each of two words of a table. It never denies a hash that it holds."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def bits(hashes: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Place and mask of both words of each hash, in a table of ``size`` words, a power of two."""
        out = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            x = hashes * np.uint64(factor)
            x ^= x >> np.uint64(29)
            mask = np.zeros(len(x), np.uint64)
            for shift in (46, 52, 58):
                mask |= np.uint64(1) << ((x >> np.uint64(shift)) & np.uint64(63))
            out.append(((x & np.uint64(size - 1)).astype(np.int64), mask))
        return out

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place, mask in self.bits(hashes, len(self.words)):
            found &= (self.words[place] & mask) == mask
        return found

    @classmethod
    def of(cls, rows: DataFrame, column: str) -> Filter:
        """The filter of a column of hashes (long), built in tasks; what reaches the driver is at most its table, of 32 bits or
        more for each hash up to ``FILTER_WORDS``."""
        size = min(FILTER_WORDS, 1 << max(10, (rows.count() // 2).bit_length()))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = cls.bits(batch.column(0).to_numpy().view(np.uint64), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs]).view(np.int64), pa.int64()) for k in (0, 1)], names=["place", "mask"])

        table = rows.select(column).mapInArrow(place, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(size, np.uint64)
        words[table.column("place").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
        return cls(words)


def stretches(target: list[str], words: list[str], diagonals: list[int], least_share: float) -> list[tuple[float, int, int]]:
    """(share, first word, end word) of every stretch of ``words`` that aligns well enough with ``target``.

    ``diagonals`` are the places in ``words`` where the target would begin by its seeds. Around them the best stretch goes
    first, then those in what is left before and behind it, until none does. ``share`` is the alignment score over the score
    of the whole target against itself; a target shorter than a seed must match as a whole.
    """
    number = {w: k for k, w in enumerate(dict.fromkeys(target), 1)}
    item = np.fromiter(map(number.__getitem__, target), np.int64, len(target))
    least = least_share if len(target) >= SEED else 1.0
    slack = len(target) // 2
    spans: list[list[int]] = []
    for d in sorted(diagonals):
        if spans and d - slack <= spans[-1][1]:
            spans[-1][1] = d + len(target) + slack
        else:
            spans.append([d - slack, d + len(target) + slack])
    found = []
    todo = [(max(0, a), min(len(words), b)) for a, b in spans]
    while todo:
        a, b = todo.pop()
        window = np.fromiter((number.get(w, 0) for w in words[a:b]), np.int64, max(0, b - a))
        if np.count_nonzero(window) < least * len(target):  # even if all of them matched
            continue
        score, end, last = align(item, window)
        share = score / (MATCH * len(target))
        if score and share >= least:
            start = end - reach(item[:last], window[:end], score)
            found.append((share, a + start, a + end))
            todo += [(a, a + start), (a + end, b)]
    return found


def _counted(rows: DataFrame, wanted: Callable[[list[str]], list[str]]) -> DataFrame:
    """(word, n) of the words of the only column of ``rows`` that ``wanted`` picks of a batch's distinct ones; the word ""
    stands for all words together. Counted in tasks first, then over the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            new: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                new.update(words_of(text))
            found[""] += new.total()
            for word in wanted(list(new)):
                found[word] += new[word]
            if len(found) > MEMO_WORDS:
                yield flush()
        yield flush()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _seeds(docs: DataFrame, items: DataFrame, text_col: str, rare: float, scratch: Scratch) -> DataFrame:
    """(hash, item, at, order) of the rare n-grams of every item: ``SEED`` words, or all of a shorter item.

    A word's share is that in corpus and benchmark together, so that what all items have in common is no rare seed either.
    """
    spark = docs.sparkSession
    own = scratch.table(_counted(items.select("text"), list), "item-words")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(batch.column(0).to_pylist()).view(np.int64), pa.int64())], names=["hash"])

    known = spark.sparkContext.broadcast(Filter.of(scratch.table(own.filter("word != ''").select("word").mapInArrow(keys, "hash long"), "word-hashes"), "hash"))

    def among(words: list[str]) -> list[str]:
        return [words[k] for k in np.flatnonzero(known.value.holds(_hashes(words)))]

    counts = scratch.table(own.join(_counted(docs.select(text_col), among).withColumnRenamed("n", "m"), "word", "left").select("word", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")), "counts")
    total = (counts.filter("word = ''").agg(F.sum("n")).first()[0] or 0) + 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t) for t in batch.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            places = np.concatenate([*[np.arange(len(x)) for x in found], np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(places, pa.int64()), pa.array([w for x in found for w in x], pa.string())], names=["item", "at", "word"])

    chances = items.select("item", "text").mapInArrow(placed, "item long, at long, word string").join(counts, "word")
    listed = chances.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("places"))  # an item's length bounds it

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text, shares in zip(*(batch.column(c).to_pylist() for c in ("item", "text", "shares")), strict=True):
                words = words_of(text)
                order = min(SEED, len(words))
                hashes = gram_hashes(words, order).view(np.int64)
                grams = np.prod([shares[k : len(words) - order + 1 + k] for k in range(order)], axis=0)
                keep = grams <= max(rare, np.sort(grams)[len(grams) // 4])  # the rarest quarter at least, whatever the words
                rows += [(int(hashes[at]), item, at, order) for at in np.flatnonzero(keep).tolist()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["hash", "item", "at", "order"])

    shares = F.transform("places", lambda x: x["n"] / F.lit(float(total)))
    joined = items.select("item", "text").join(listed.select("item", shares.alias("shares")), "item")
    return scratch.table(joined.select("item", "text", "shares").mapInArrow(pick, "hash long, item long, at long, `order` long"), "seeds")


def _matches(docs: DataFrame, benchmark: DataFrame, key: Column, text_col: str, item_col: str, item_text_col: str, rare: float, least_share: float, scratch: Scratch) -> DataFrame:
    """(key, item_id, share, word_start, word_end) of every stretch of a text that aligns with an item, in a table."""
    spark = docs.sparkSession
    schema = benchmark.schema
    items = benchmark.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    items = scratch.table(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = _seeds(docs, items, text_col, rare, scratch)
    orders = sorted(r["order"] for r in seeds.select("order").distinct().collect())  # SEED at most
    known = spark.sparkContext.broadcast(Filter.of(seeds, "hash"))
    given = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    hits_type = pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int64())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, at = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                found = []
                for order in orders:
                    grams = gram_hashes(words, order)
                    places = np.flatnonzero(known.value.holds(grams))
                    found += [{"hash": h, "place": p} for h, p in zip(grams[places].view(np.int64).tolist(), places.tolist(), strict=True)]
                if found:
                    at.append(k)
                    hits.append(found)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hits, hits_type)], names=["key", "text", "hits"])

    carried = given.mapInArrow(look, f"key {kind}, text string, hits array<struct<hash: long, place: long>>")
    carried = scratch.table(carried.withColumn("row", F.monotonically_increasing_id()), "carried", compression="zstd")
    joined = carried.select("row", F.inline("hits")).join(seeds.select("hash", "item", "at"), "hash")
    pairs = joined.groupBy("row", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("diagonals"))  # a text's length bounds it
    tried = pairs.join(items.select("item", F.col("item_id"), F.col("text").alias("target")), "item").join(carried.select("row", "key", "text"), "row")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, [])
        for batch in batches:
            at, out = [], []
            for k, (row, target, diagonals, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "target", "diagonals", "text")), strict=True)):
                if last[0] != row:  # rows of one text come together
                    last = (row, words_of(text))
                for found in stretches(words_of(target), last[1], diagonals, least_share):
                    at.append(k)
                    out.append(found)
            rows = pa.array(at, pa.int64())
            shares, starts, ends = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(rows), batch.column("item_id").take(rows), pa.array(shares, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["key", "item_id", "share", "word_start", "word_end"],
            )

    scored = tried.select("row", "key", "item_id", "target", "diagonals", "text").mapInArrow(score, f"key {kind}, item_id {schema[item_col].dataType.simpleString()}, share double, word_start long, word_end long")
    return scratch.table(scored, "matches")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rare: float = 1e-7,
    least_share: float = 0.5,
) -> DataFrame:
    """Every stretch of a document that aligns with a benchmark item: (id, item, share, word_start, word_end).

    Seeds are the 3-word sequences of an item whose words' frequencies in corpus and benchmark make them rare (expected at
    most ``rare`` times per position), and at least its rarest quarter; an item of one or two words is a seed as a whole.
    Frequencies of words rather than of seeds decide on rarity, so an item that leaked into many documents keeps its seeds.
    A document that holds a seed is aligned with the item around it, word by word, which also scores edited and paraphrased
    copies; ``share`` is the score over the item's own, and stretches from ``least_share`` on are returned. Items of one or
    two words match as a whole only.

    Null or empty texts match nothing. Repeated rows, and repeated stretches of a long text, adjacent ones included, each give
    a row, as do benchmark rows of one id, or of none, with different texts; equal benchmark rows count once. Only the named
    columns are read. An empty table on either side gives an empty result.

    Two narrow passes over the texts: one counts the benchmark's words, one looks for seeds; both know them by a filter of
    bounded size, which only spares work. Texts with a seed, which are few, are written, and their seeds are joined with the
    table of seeds, of any size; nothing of the benchmark is held in a task as a whole.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found = _matches(docs, benchmark, F.col(id_col), text_col, item_col, item_text_col, rare, least_share, scratch)
    for name in ("items", "item-words", "word-hashes", "counts", "seeds", "carried"):
        scratch.drop(name)
    return found.select(F.col("key").alias(id_col), F.col("item_id").alias(item_col), "share", "word_start", "word_end")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rare: float = 1e-7,
    least_share: float = 0.5,
) -> DataFrame:
    """``docs`` without the rows that ``find_contamination`` would report; all columns and all other rows stay, those of null
    text included. Rows are known by 128 bits of hashes of their texts, on which those found are joined."""

    def hashes(text: Column) -> Column:
        return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"))

    scratch = Scratch(docs.sparkSession, "decontaminate")
    found = _matches(docs, benchmark, hashes(F.col(text_col)), text_col, item_col, item_text_col, rare, least_share, scratch)
    a, b = private(docs, "a", "b")
    keys = scratch.table(found.select("key.a", "key.b").distinct().toDF(a, b), "keys")
    own = hashes(F.col(text_col))
    return docs.join(keys, (own["a"] == keys[a]) & (own["b"] == keys[b]), "left_anti")
