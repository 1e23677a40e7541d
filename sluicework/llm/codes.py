"""Vector code compression: codebooks of vector parts, assigned through memoised grid cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.text import private
from sluicework.llm.tokens import ChunkMemo
from sluicework.llm.vectors import exact_type, in_range, matrix, moments, padded, scaled
from sluicework.scratch import Scratch

#: Cells that a task remembers for each part, and numbers that one vector operation makes; both bound its memory.
MEMO_CELLS = 100_000
STEP_NUMBERS = 2_000_000


class Cells:
    """Nearest entries of one codebook, by the coarse cell of a vector.

    Space is cut into cubes. For a cube, an entry whose least squared distance to it exceeds the least of all entries' greatest
    distances is dominated: some other entry is nearer to every point inside. The entries that are left are remembered
    under the cube's coordinates, which are the key, so cubes can't be confused; for its vectors only these are measured, exactly.
    """

    def __init__(self, book: np.ndarray, side: int) -> None:
        self.book, self.side = book, side
        self.memo = ChunkMemo(self.survivors, MEMO_CELLS)

    def survivors(self, cells: list[bytes]) -> list[bytes]:
        """For each cube, the numbers of the entries that may be nearest to some of its points, ascending."""
        entries, width = self.book.shape
        found: list[bytes] = []
        step = max(1, STEP_NUMBERS // (4 * entries))
        for at in range(0, len(cells), step):
            grid = np.frombuffer(b"".join(cells[at : at + step]), "<i8").reshape(-1, width)
            widest = (int(abs(grid).max()) + 2) * self.side + int(abs(self.book).max())
            kind = np.int32 if width * widest**2 < 1 << 31 else np.int64
            near, far = np.zeros((2, len(grid), entries), kind)
            for k in range(width):
                levels, back = np.unique(grid[:, k], return_inverse=True)
                low = self.book[:, k] - levels[:, None] * self.side
                high = low - (self.side - 1)
                near += (np.maximum(0, np.maximum(high, -low)) ** 2).astype(kind)[back]
                far += (np.maximum(abs(low), abs(high)) ** 2).astype(kind)[back]
            kept = near <= far.min(1)[:, None]
            numbers, ends = np.nonzero(kept)[1].astype(np.uint8).tobytes(), np.cumsum(kept.sum(1)).tolist()
            found += [numbers[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the lower number of equals, and its squared distance."""
        grid = np.ascontiguousarray(np.floor_divide(x, self.side), "<i8")
        keys = grid.view(f"V{8 * x.shape[1]}").ravel().tolist()
        lists = self.memo.values([keys])[0]
        kind = exact_type(4, x.shape[1], max(1, abs(x).max(initial=0), abs(self.book).max()) ** 2)
        vectors, book = x.astype(kind), self.book.astype(kind)
        entry, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        step = max(1, STEP_NUMBERS // (len(book) * x.shape[1]))
        for at in range(0, len(x), step):
            some = lists[at : at + step]
            sizes = np.array([len(s) for s in some])
            row = np.repeat(np.arange(len(some)), sizes)
            number = np.frombuffer(b"".join(some), np.uint8).astype(np.int64)
            apart = vectors[at : at + step][row] - book[number]
            distance = np.einsum("ij,ij->i", apart, apart)
            least = np.minimum.reduceat(distance, np.cumsum(sizes) - sizes)
            hit = np.flatnonzero(distance == least[row])
            hit = hit[np.diff(row[hit], prepend=-1) > 0]  # the first of equals
            entry[at : at + step], error[at : at + step] = number[hit], least
        return entry, error


def _cells(books: np.ndarray, sides: list[int]) -> list[Cells]:
    return [Cells(book, side) for book, side in zip(books, sides, strict=True)]


def _next_books(table: DataFrame, books: np.ndarray, sides: list[int]) -> np.ndarray:
    """Each entry replaced by the floor of its parts' mean. A task sums up its rows; what moves is one row for each task,
    entry and component, what reaches the driver one for each entry and component."""
    parts, entries, width = books.shape
    sent = table.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _cells(sent.value, sides)
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * width).reshape(-1, parts, width)
            for p in range(parts):
                entry, _ = cells[p].nearest(x[:, p])
                np.add.at(total[p], entry, x[:, p])
                count[p] += np.bincount(entry, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["p", "e", "n", "sums"])

    summed = table.select("q").mapInArrow(sums, "p int, e int, n long, sums array<long>")
    by = summed.select("p", "e", "n", F.posexplode("sums").alias("at", "s")).groupBy("p", "e", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    books = books.copy()
    for r in by.collect():  # parts x entries x width rows at most
        books[r["p"], r["e"], r["at"]] = r["s"] // r["n"]
    return books


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    scale: int = 1024,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
) -> DataFrame:
    """The codes of vectors whose components become floor(scale * x), cut into equal consecutive parts.

    Each part's codebook starts as that part of the rows of the ``entries`` smallest ids (a null id comes last, rows of one id by
    their vectors); each round assigns every part to its nearest entry (squared distance, ties to the lower number) and
    replaces entries by the floor of their parts' mean; unused ones stay. Returns the id, code (the entries' numbers in part
    order, two hex digits each), error (squared distances summed over parts), label_error (errors summed over
    rows of equal label, null being one) and codebooks_sha256 (of all final entries' decimal components).

    Rows whose vector is null, or holds a null, NaN, infinite component or one of 2**24 and more when scaled, are left out. Shorter
    vectors, empty ones included, and lengths that do not divide evenly count as followed by zeros. Repeated rows each
    count. Fewer rows than entries make a smaller codebook; an empty table gives an empty result. Other columns are not
    read, so none can clash. The integers are written once and scanned in each round; nothing but sums is shuffled.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries are numbered by two hex digits")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    vector = F.col(f"`{vec_col}`")
    kept = vectors.filter(in_range(vector, scale))
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = max(1, -(-longest // parts))
    table = kept.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), padded(scaled(vector, scale), parts * width).alias("q"))
    table = scratch.table(table, "q")
    first = [r["q"] for r in table.select("id", "q").orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()]  # 256 at most
    books = np.array(first, np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    _, _, variance = moments(table, "q", parts * width)
    spread = np.sqrt(variance.reshape(-1, width).mean(1)) if len(variance) else np.ones(parts)
    sides = [1 << max(0, int(np.log2(max(1.0, s / 4)))) for s in spread]  # the power of two below a quarter of the spread
    if len(first):
        for _ in range(rounds):
            books = _next_books(table, books, sides)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(books)
    kinds = {c: table.schema[c].dataType.simpleString() for c in ("id", "label")}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _cells(sent.value, sides)
        for batch in batches:
            x = matrix(batch.column(2), parts * width).reshape(-1, parts, width)
            found = [cells[p].nearest(x[:, p]) for p in range(parts)]
            codes = np.stack([e for e, _ in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(d for _, d in found), pa.int64())], names=["id", "label", "code", "error"])

    coded = scratch.table(table.mapInArrow(assign, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    scratch.drop("q")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    (name,) = private(coded.select("code", "error"), id_col)
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(name), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
