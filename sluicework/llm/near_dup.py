"""Near-duplicate documents: min-max hashing proposes links, full shingle sets confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.operators.components import connected_components
from sluicework.scratch import Scratch, cut

SHINGLE = 5
#: Bands of ROWS values each; half of them hold minima, half maxima. A pair of similarity s meets in one of them but for a
#: share of (1 - s**5)**42: at 0.75, 1 pair in 80,000; at 0.8, 1 in 20 million.
BANDS, ROWS = 42, 5
MEMO_WORDS = 300_000
CHUNK = 512
#: Members of a group, and shingles of their sets, that one block holds; a task compares two blocks with each other.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: Counters of shingles that order them by frequency.
SLOTS = 1 << 18


class _WordHashes(dict):
    """Word to 64-bit hash, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _constants() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(20240501)
    odd32 = rng.integers(0, 2**32, size=BANDS * ROWS // 2, dtype=np.uint32) | np.uint32(1)
    return {
        "places": rng.integers(0, 2**64, size=SHINGLE, dtype=np.uint64) | np.uint64(1),
        "factors": odd32[:, None],
        "masks": rng.integers(0, 2**32, size=BANDS * ROWS // 2, dtype=np.uint32)[:, None],
        "rows": rng.integers(0, 2**64, size=ROWS, dtype=np.uint64) | np.uint64(1),
        "bands": rng.integers(0, 2**64, size=BANDS, dtype=np.uint64),
    }


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 5-word shingles of a text, A-Z lower-cased; with fewer words, one of them all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    places = _constants()["places"]
    hashes = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return _mixed((hashes * places[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    n = len(words) - SHINGLE + 1
    total = hashes[:n] * places[0]
    for k in range(1, SHINGLE):
        total += hashes[k : n + k] * places[k]
    return np.unique(_mixed(total))


def bands(found: np.ndarray) -> np.ndarray:
    """Band hashes of a shingle set.

    Each hash function is evaluated once and gives two values, its least and its greatest over the set; each agrees between
    two sets with their similarity as its chance, so bands of either estimate it without bias.
    """
    c = _constants()
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    least = greatest = None
    for at in range(0, len(x), CHUNK):
        values = (x[at : at + CHUNK] ^ c["masks"]) * c["factors"]
        low, high = values.min(axis=1), values.max(axis=1)
        least = low if least is None else np.minimum(least, low)
        greatest = high if greatest is None else np.maximum(greatest, high)
    rows = np.concatenate([least, greatest]).astype(np.uint64).reshape(BANDS, ROWS)
    return _mixed((rows * c["rows"]).sum(axis=1, dtype=np.uint64) + c["bands"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, rows = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                rows.append(bands(found).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                names=["id", "text_hash", "n_shingles", "class", "bands"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, "id long, text_hash long, n_shingles long, class binary, bands array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose texts' full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
                if last[0] != a:  # rows of one document come together
                    last = (a, shingles(left))
                keep.append(linked(last[1], shingles(right), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def _across(cells: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components within a cell (columns key, cell, node, component, text).

    Shingles of the cell are numbered, so that the intersections of one document's full set with those of all others are one
    vector operation. Documents outside the largest component are compared so; a link joins its components at once, and a
    cell gives fewer links than it has members, whatever its pairs.
    """

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("node", ignore_index=True)
        nodes = cell["node"].to_numpy()
        _, comps, counts = np.unique(cell["component"].to_numpy(), return_inverse=True, return_counts=True)
        sets = [shingles(t) for t in cell["text"]]
        sizes = np.array([len(x) for x in sets])
        starts = np.cumsum(sizes) - sizes
        known, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(known), np.int32)
        out = []
        for k in np.flatnonzero(comps != counts.argmax()).tolist():
            own = numbers[starts[k] : starts[k] + sizes[k]]
            mark[own] = 1
            same = np.add.reduceat(mark[numbers], starts)
            mark[own] = 0
            for j in np.flatnonzero((comps != comps[k]) & (100 * same >= percent * (sizes + sizes[k] - same))).tolist():
                if comps[j] != comps[k]:
                    out.append((nodes[k], nodes[j]))
                    comps = np.where(comps == comps[k], comps[j], comps)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return cells.groupBy("key", "cell").applyInPandas(compare, "a long, b long").distinct()


def _unsettled(placed: DataFrame) -> DataFrame:
    """(key, size, weight) of the groups of ``placed`` (key, node, n_shingles, component) that hold several components.

    Groups of the same members are one, under their least key, so that what many bands share is compared once.
    """
    groups = placed.groupBy("key").agg(
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("size"), F.sum("n_shingles").alias("weight"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"),
    )
    return groups.filter("c1 < c2").groupBy("members", "size", "weight", "c1", "c2").agg(F.min("key").alias("key")).select("key", "size", "weight")


def _cells(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of ``groups`` in cells, (key, cell, node, component), so that every two members of a group meet in one.

    A cell holds two blocks of about ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles at most. A group of several blocks
    becomes one cell for each pair of them, which every member of either block goes to.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs_of = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.concat_ws("-", F.least(own, j), F.greatest(own, j)))
    return placed.join(groups, "key").select("key", "node", "component", F.explode(F.when(blocks > 1, pairs_of).otherwise(F.array(F.lit("0")))).alias("cell"))


def _by_rare_shingles(members: DataFrame, percent: int) -> DataFrame:
    """``placed`` anew for ``members`` (node, n_shingles, component, text): keys are the shingles of each prefix.

    Prefix filter, exact whatever the order of the shingles: of two sets with 100 * intersection >= percent * union each
    holds that share of the other, so they share one of the first n - ceil(n * percent / 100) + 1 shingles of each. The order
    is by frequency among the members, the rarest first, counted in a fixed number of slots, so that what fills a bucket (a
    passage that very many documents hold) is no key for them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, (shingles(text) % np.uint64(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["slot", "n"])

    frequency = np.zeros(SLOTS, np.int64)
    for r in members.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # SLOTS rows at most
        frequency[r["slot"]] = r["n"]
    shared = members.sparkSession.sparkContext.broadcast(frequency)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            firsts = [x[np.lexsort((x, shared.value[(x % np.uint64(SLOTS)).astype(np.int64)]))][: len(x) - -(-len(x) * percent // 100) + 1] for x in sets]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in firsts]), pa.int64())
            keys = pa.array(np.concatenate([*firsts, np.zeros(0, np.uint64)]).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([keys, *(batch.column(c).take(at) for c in ("node", "n_shingles", "component"))], names=["key", "node", "n_shingles", "component"])

    return members.mapInArrow(key, "key long, node long, n_shingles long, component long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Component of every document: (id, n_shingles, component_id), one row per row of ``docs``; ids are integers.

    Documents are linked if their sets of distinct 5-word shingles have 100 * intersection >= percent * union. A component is
    all that links reach, named by its least id. Texts without a word have an empty set and link with nothing. Equal texts,
    however many, are one class from the start. Rows that share an id are one document: all of them are in one component, with
    the links of each. A null id names no component and joins no rows: its row has the component of its text, else null. An
    empty table gives an empty table. Only the id and the text are read.

    1. Sign every text in one narrow pass; collapse classes of equal sets, which are the nodes from here on.
    2. Every bucket of a band proposes a link from its least class to each of its others: as many pairs as rows.
    3. Full sets, built again from the texts, confirm proposals; components of what holds.
    4. Buckets that still hold several components are compared by full sets: small ones as they are; the members of large ones
       meet again under the rare shingles of their prefixes, which a passage shared by very many does not fill. Cells are
       bounded in members and in shingles, and groups of the same members are compared once. Then every two classes of a
       bucket are in one component or were compared, or cannot be similar, so no link that any band proposes is lost.

    Texts are shuffled once, and only those with a proposal are kept for the comparisons.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    signed = scratch.table(_signatures(docs, id_col, text_col), "signed", compression="zstd")
    least = F.struct(F.col("id").isNull().alias("n"), "id", "text_hash")
    grouped = signed.filter("n_shingles > 0").groupBy("class").agg(F.min("id").alias("least_id"), F.min(least)["text_hash"].alias("text_hash"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = scratch.table(grouped.withColumn("node", F.monotonically_increasing_id()), "classes", compression="zstd")
    rows = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
    pivots = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.min_by("n_shingles", "node").alias("n_pivot"), F.count("*").alias("size")).filter("size > 1")
    members = scratch.table(rows.join(pivots, "key"), "members", compression="zstd")

    near = 100 * F.least("n_shingles", "n_pivot") >= percent * F.greatest("n_shingles", "n_pivot")
    pairs = scratch.table(members.filter((F.col("node") != F.col("pivot")) & near).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = scratch.table(members.select("node").distinct().join(classes.select("node", "least_id", "text_hash"), "node"), "wanted")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    own = F.col("id").eqNullSafe(F.col("least_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))
    # as at any larger size: a small table of those wanted would be broadcast, and the texts stay where they are
    texts = scratch.table(source.alias("d").join(wanted.hint("merge").alias("w"), own).select("node", "text"), "texts", compression="zstd")
    if texts.count() > wanted.count():  # rows given twice
        texts = scratch.table(texts.dropDuplicates(["node"]), "texts-once", compression="zstd")
    links = scratch.table(_confirmed(pairs, texts, percent), "links")
    # a document's rows of different texts belong together
    several = signed.filter("id is not null").groupBy("id").agg(F.min("class").alias("c1"), F.max("class").alias("c2"), F.count("*").alias("n")).filter("n > 1").select("id", "c1", "c2")
    several = scratch.table(several, "several")
    spread_ids = signed.filter("class is not null").join(several.filter("c1 < c2"), "id").select("c1", "class").distinct()
    given = spread_ids.filter("c1 != class").join(classes.select(F.col("class").alias("c1"), F.col("node").alias("a")), "c1").join(classes.select("class", F.col("node").alias("b")), "class").select("a", "b")
    links = scratch.table(links.unionByName(given), "links-given")
    found = cut(connected_components(links, "a", "b"))

    placed = members.filter("size > 2").join(found, "node", "left").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    groups = scratch.table(_unsettled(placed), "groups")
    small = (F.col("size") <= BLOCK) & (F.col("weight") <= BLOCK_SHINGLES)
    cells = [_cells(placed, groups.filter(small))]
    large = groups.filter(~small)
    if not large.isEmpty():
        again = scratch.table(placed.join(large.select("key"), "key").select("node", "n_shingles", "component").distinct().join(texts, "node"), "again", compression="zstd")
        keyed = scratch.table(_by_rare_shingles(again, percent), "keyed", compression="zstd")
        cells.append(_cells(keyed, scratch.table(_unsettled(keyed), "keyed-groups")))
    more = [scratch.table(_across(c.join(texts, "node"), percent), f"more-{k}") for k, c in enumerate(cells)]
    if not all(m.isEmpty() for m in more):
        for m in more:
            links = links.unionByName(m)
        found = cut(connected_components(links, "a", "b"))

    of_class = classes.select("class", "node", "least_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = of_class.groupBy("component").agg(F.min("least_id").alias("name"))
    named = signed.select("id", "n_shingles", "class").join(of_class.join(names, "component").select("class", "name"), "class", "left")
    # a row without a word has the component of its document's other rows
    by_id = several.select(F.col("id").alias("_id"), F.col("c1").alias("_c1")).join(of_class.join(names, "component").select(F.col("class").alias("_c1"), F.col("name").alias("_name")), "_c1")
    named = named.join(by_id.select("_id", "_name"), F.col("id") == F.col("_id"), "left")
    result = cut(named.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("name", "_name", "id").alias("component_id")))
    scratch.drop()
    return result


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with one document of each component: that of the least id. Columns stay; rows with a null id stay; of rows that
    share an id one stays."""
    keep = near_duplicates(docs, id_col, text_col, percent).filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.join(keep, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull())).select(docs.columns)
