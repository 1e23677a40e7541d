"""Hard negatives by threshold joins of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework.llm.vectors import exact_type, in_range, matrix, moments, padded, scaled
from sluicework.scratch import Scratch

#: Rows and anchors of a cell, least rows of one, and anchors looked at together; they bound a task's memory.
BLOCK_ROWS, BLOCK_ANCHORS, LEAST_ROWS, STEP_ANCHORS = 32_768, 32_768, 512, 256
#: The first threshold of a window lies where its rows are expected to be so many times those wanted; the next where 16 times that is.
EXPECTED, LOWER = 4.0, 16.0
#: Thresholds of a window: by these powers of LOWER, then its lower end.
LEVELS = (0, 1, None)
#: Dimensions fall into so many groups, each with its norms.
GROUPS = 8
#: Share of pairs above which partial scores are completed for all rows together, and not pair by pair.
DENSE = 0.03
_ENDS = 1 << 62
_FOUND = "anchor long, w int, score long, other long, other_id {id}"


class Index(NamedTuple):
    """Inverted index of a block of rows: ``posting[g]`` holds the values of dimension group g, for all rows, those with the
    most indexed groups first. Row r is indexed in its first ``depth[r]`` groups; ``norms[r, g]`` is its norm from group g on."""

    posting: list[np.ndarray]
    depth: np.ndarray
    norms: np.ndarray
    row: np.ndarray


def groups_of(width: int) -> list[slice]:
    step = max(1, -(-width // GROUPS))
    return [slice(k, min(k + step, width)) for k in range(0, width, step)]


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """The norm of what each row has from a group on; 0 behind the last."""
    squares = np.stack([(x[:, g].astype(float) ** 2).sum(1) for g in groups_of(x.shape[1])], 1)
    return np.sqrt(np.pad(np.cumsum(squares[:, ::-1], 1)[:, ::-1], ((0, 0), (0, 1))))


def build_index(rows: np.ndarray, anchor_norms: np.ndarray, least: np.ndarray) -> Index:
    """Index the rows for anchors that want scores of ``least`` or more.

    A row's dimensions from a group on are left out if their norm, times any anchor's norm there, stays below what that
    anchor wants: they alone can't make a match. Rows that are left out altogether match nothing. Where an anchor wants
    scores of 0 or less, everything is indexed.
    """
    norms = suffix_norms(rows)
    last = norms.shape[1] - 1
    depth = np.full(len(rows), last)
    if len(least) and least.min() > 0:
        reach = (anchor_norms / least[:, None]).max(0)
        depth = (norms * reach >= 1 - 1e-9).sum(1)  # norms fall from group to group
        depth = np.minimum(depth, last)
    row = np.argsort(-depth, kind="stable")[: np.count_nonzero(depth)]
    return Index([np.ascontiguousarray(rows[row, g].T) for g in groups_of(rows.shape[1])], depth[row], norms[row], row)


def matches(anchors: np.ndarray, least: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs (anchor, row, score) whose inner product is the anchor's ``least`` or more; in runs of anchors.

    Partial scores are accumulated over the posting lists. A row goes when what is accumulated and the product of the remaining
    norms together reach no anchor's threshold: half-way, and at the end of the index. What is left is completed exactly.
    """
    cuts = groups_of(rows.shape[1])
    for at in range(0, len(anchors), STEP_ANCHORS):
        a, t = anchors[at : at + STEP_ANCHORS], least[at : at + STEP_ANCHORS]
        norms = suffix_norms(a)
        index = build_index(rows, norms, t)
        margin = (t - 1e-6 * (1 + abs(t)))[:, None]
        live = np.arange(len(index.row))
        depth = index.depth
        partial = np.zeros((len(a), len(live)), rows.dtype)

        def bound(upto: int) -> np.ndarray:
            rest = np.minimum(depth, upto)  # noqa: B023
            return partial + norms[:, rest] * index.norms[live, rest]  # noqa: B023

        for g, cut in enumerate(cuts):
            n = np.count_nonzero(depth > g)
            if n == 0:
                break
            partial[:, :n] += a[:, cut] @ index.posting[g][:, live[:n]]
            if g + 1 == len(cuts) // 2:
                keep = (bound(g + 1) >= margin).any(0)
                if keep.mean() < 0.75:
                    live, depth, partial = live[keep], depth[keep], partial[:, keep]
        possible = bound(len(cuts)) >= margin
        if np.count_nonzero(possible) > DENSE * possible.size:
            for g, cut in enumerate(cuts):
                n = np.count_nonzero(depth > g)
                partial[:, n:] += a[:, cut] @ index.posting[g][:, live[n:]]
            i, j = np.nonzero(partial >= t[:, None])
            score = partial[i, j]
            j = index.row[live[j]]
        else:
            i, j = np.nonzero(possible)
            j = index.row[live[j]]
            score = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 65_536]], rows[j[k : k + 65_536]]) for k in range(0, max(1, len(i)), 65_536)])
            kept = score >= t[i]
            i, j, score = i[kept], j[kept], score[kept]
        yield i + at, j, score


def first_of_each(i: np.ndarray, j: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Of each i, the k pairs of highest score, ties to the smaller place of j: their numbers."""
    order = np.lexsort((place[j], -score, i))
    sorted_i = i[order]
    begins = np.flatnonzero(np.diff(sorted_i, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def first_threshold(low: int, high: int, mean: float, spread: float, share: float) -> int:
    """Where, below the upper end, a ``share`` of all rows is expected if scores are spread normally; within the window."""
    if spread <= 0:
        return low
    p = _tail((high - mean) / spread) + share
    return low if p >= 0.5 else max(low, min(high, math.floor(mean - spread * NormalDist().inv_cdf(max(p, 1e-300)))))


def _search(wanted: DataFrame, table: DataFrame, count: int, mean: np.ndarray, variance: np.ndarray, same: bool, k: int, level: int | None) -> DataFrame:
    """For each window of the wanted anchors, the first k of the rows at or above its threshold of this level, of each cell.

    Anchors and rows are dealt into blocks by their numbers; a cell is one block of each, so its size is bounded whatever the labels
    or vectors, and no pair is met twice. ``wanted``: anchor, label, n, q and windows (w, low, high).
    """
    session = table.sparkSession
    width = len(mean)
    order = np.argsort(-(variance + mean * mean), kind="stable")  # heavy dimensions first, so that norms fall early
    anchors = wanted.count()
    down = max(1, -(-anchors // BLOCK_ANCHORS))
    across = max(1, -(-count // BLOCK_ROWS), min(count // LEAST_ROWS, 2 * session.sparkContext.defaultParallelism))
    kinds = {c: table.schema[c].dataType.simpleString() for c in ("id", "label")}
    dealt = min(down * across, 10_000)

    def block(number: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(number), F.lit(blocks)).cast("int")

    def cell(down_at: Column, across_at: Column) -> Column:
        return down_at * across + across_at

    left = wanted.withColumns({"d": block("anchor", down), "r": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))}).withColumn("cell", cell(F.col("d"), F.col("r")))
    right = table.withColumns({"r": block("number", across), "d": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))}).withColumn("cell", cell(F.col("d"), F.col("r")))
    left = left.select("cell", "anchor", "label", "n", "q", "windows").repartition(dealt, "cell")
    right = right.select("cell", "number", "id", "label", "q").repartition(dealt, "cell")
    schema = pa.schema([("anchor", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("other", pa.int64())])

    def join(one: pa.Table, many: pa.Table) -> pa.Table:
        one, many = one.combine_chunks(), many.combine_chunks()
        ids = many["id"].combine_chunks() if many.num_rows else pa.array([], many.schema.field("id").type)
        found: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
        if one.num_rows and many.num_rows:
            a, x = (matrix(t["q"].combine_chunks(), width)[:, order] for t in (one, many))
            kind = exact_type(*(math.sqrt((y.astype(float) ** 2).sum(1).max()) for y in (a, x)))
            a, x = a.astype(kind), x.astype(kind)
            number, other = one["anchor"].to_numpy(), many["number"].to_numpy()
            # Labels as codes; places of rows by id (null last) and number.
            coded = pa.chunked_array([one["label"].combine_chunks(), many["label"].combine_chunks()]).combine_chunks().dictionary_encode().indices.to_numpy()
            label, other_label = coded[: len(a)], coded[len(a) :]
            sorting = pa.table({"id": ids, "number": many["number"].combine_chunks()}).sort_by([("id", "ascending"), ("number", "ascending")])["number"].to_numpy()
            place, by = np.empty(len(x), np.int64), np.argsort(other)
            place[by[np.searchsorted(other[by], sorting)]] = np.arange(len(x))
            windows = [[(v["w"], v["low"], v["high"]) for v in ws] for ws in one["windows"].to_pylist()]
            centre, spread = a @ mean[order], np.sqrt((a.astype(float) ** 2) @ variance[order])
            n = one["n"].to_numpy()
            limits = np.full((3, len(a), max(map(len, windows))), _ENDS, np.int64)  # lower and upper ends of windows, and their names
            for i, ws in enumerate(windows):
                for m, (w, low, high) in enumerate(ws):
                    t = low if level is None else first_threshold(low, high, centre[i], spread[i], EXPECTED * LOWER**level * k / max(1, n[i]))
                    limits[:, i, m] = t, high, w
            least = limits[0].min(1)
            sides = [(np.arange(len(a)), np.arange(len(x)))] if not same else [(np.flatnonzero(label == v), np.flatnonzero(other_label == v)) for v in np.intersect1d(label, other_label)]
            for of_a, of_x in sides:
                for i, j, score in matches(a[of_a], least[of_a].astype(float), x[of_x]):
                    i, j = of_a[i], of_x[j]
                    fit = number[i] != other[j] if same else label[i] != other_label[j]
                    i, j, score = i[fit], j[fit], score[fit].astype(np.int64)
                    for m in range(limits.shape[2]):
                        inside = np.flatnonzero((limits[0, i, m] <= score) & (score <= limits[1, i, m]))
                        best = inside[first_of_each(i[inside], j[inside], score[inside], place, k)]
                        found.append((number[i[best]], limits[2, i[best], m], score[best], j[best]))
        columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4)]
        at = columns[3]
        others = many["number"].to_numpy()[at] if many.num_rows else at
        made = pa.table([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), pa.array(others)], schema=schema)
        return made.append_column("other_id", ids.take(pa.array(at)))

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(join, _FOUND.format(**kinds))


def _fill(scratch: Scratch, name: str, wanted: DataFrame, table: DataFrame, count: int, mean: np.ndarray, variance: np.ndarray, same: bool, k: int) -> DataFrame:
    """The first k rows of every window: at a high threshold, then at a lower one for windows that did not fill, then at their
    lower ends. Each level's rows are written. A window with k rows at or above a threshold is right whatever lies below."""
    levels = []
    by_window = Window.partitionBy("anchor", "w")
    for at, level in enumerate(LEVELS):
        found = _search(wanted, table, count, mean, variance, same, k, level)
        ranked = found.withColumn("rank", F.row_number().over(by_window.orderBy(F.desc("score"), F.col("other_id").asc_nulls_last(), "other"))).filter(F.col("rank") <= k)
        ranked = scratch.table(ranked.withColumn("filled", F.count("*").over(by_window)), f"{name}-{at}")
        levels.append(ranked if level is None else ranked.filter(F.col("filled") >= k))
        if level is None:
            break
        full = ranked.filter(F.col("filled") >= k).groupBy("anchor").agg(F.collect_set("w").alias("full"))  # an anchor's windows at most
        still = wanted.join(full, "anchor", "left").withColumn("windows", F.filter("windows", lambda v: ~F.array_contains(F.coalesce("full", F.array().cast("array<int>")), v["w"])))
        wanted = scratch.table(still.filter(F.size("windows") > 0).select(wanted.columns), f"{name}-wanted-{at}")
        if wanted.isEmpty():
            break
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    return every.select("anchor", "w", "score", "other", "other_id", "rank")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """Rows of another label that score between ``low`` and ``high`` percent of a positive's score, the highest first.

    A score is the inner product of vectors whose components become floor(scale * x). An anchor (a row where ``anchor`` holds)
    has as positives its first ``positives`` other rows of the same label, for each of which it gets the first ``negatives`` rows of
    other labels in the window. Higher scores come first, ties go to the smaller id, a null id last. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    The search is a threshold join: see ``matches`` and ``_fill``. Thresholds start where the moments of all rows let the window fill
    and are lowered until it does; they never change the result. Anchors and rows meet in blocks, so that no label, vector or
    id makes a task larger; of a cell only the first rows of each window are shuffled, however many tie.

    Rows with a null label, a null vector, or a component that is null, not finite, or 2**24 and more when scaled take no
    part. Shorter vectors, empty ones included, count as followed by zeros. Repeated rows are rows of their own: each can be
    anchor, positive and negative. A positive of negative score has an empty window. An anchor without other rows of its label gives
    none; nor does an empty table. Other columns are not read, so none can clash.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    vector, label = F.col(f"`{vec_col}`"), F.col(f"`{label_col}`")
    kept = vectors.filter(in_range(vector, scale) & label.isNotNull())
    width = max(1, kept.agg(F.max(F.size(vector))).first()[0] or 0)
    table = kept.select(F.monotonically_increasing_id().alias("number"), F.col(f"`{id_col}`").alias("id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), padded(scaled(vector, scale), width).alias("q"))
    table = scratch.table(table, "q")  # numbers are fixed from here on
    count, mean, variance = moments(table, "q", width)
    mean, variance = (x if count else np.zeros(width) for x in (mean, variance))
    rows = table.drop("is_anchor")
    of_label = rows.groupBy("label").agg(F.count("*").alias("n"))
    window = F.array(F.struct(F.lit(0).alias("w"), F.lit(-_ENDS).alias("low"), F.lit(_ENDS).alias("high")))
    asking = table.filter("is_anchor").join(of_label, "label").select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id"), "label", "n", "q", window.alias("windows"))
    asking = scratch.table(asking, "anchors")
    near = _fill(scratch, "near", asking.drop("anchor_id"), rows, count, mean, variance, True, positives)

    lower, upper = F.expr(f"(score * {low} + 99) div 100"), F.expr(f"(score * {high}) div 100")
    wins = near.filter(F.col("score") >= 0).select("anchor", F.col("rank").alias("w"), lower.alias("low"), upper.alias("high"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    wins = scratch.table(wins.filter(F.col("low") <= F.col("high")), "windows")
    lists = wins.groupBy("anchor").agg(F.collect_list(F.struct("w", "low", "high")).alias("windows"))  # as many as positives
    asking_far = asking.drop("windows", "n").withColumn("n", F.lit(count).cast("long")).join(lists, "anchor")
    asking_far = scratch.table(asking_far.select("anchor", "label", "n", "q", "windows"), "anchors-far")
    far = _fill(scratch, "far", asking_far, rows, count, mean, variance, False, negatives)
    named = far.join(wins, ["anchor", "w"]).join(asking.select("anchor", "anchor_id"), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
