"""Vectors as integers, and their moments: what operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of this size and beyond are out of range: sums of their squares would leave 64 bits.
LIMIT = float(1 << 24)


def in_range(vector: Column, scale: int) -> Column:
    """Whether a vector takes part: not null, no component null, not finite, or out of range when scaled. False if null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * scale >= LIMIT))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(vector: Column, scale: int) -> Column:
    """Each component x as the integer floor(scale * x), taken as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def padded(vector: Column, width: int) -> Column:
    """A vector with zeros behind it, up to ``width`` components."""
    return F.concat(vector, F.array_repeat(F.lit(0), F.greatest(F.lit(0), width - F.size(vector))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, all of ``width`` integers, as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def moments(table: DataFrame, column: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and variance of each component: each task sums up its rows; ``width`` rows reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            x = matrix(batch.column(0), width).astype(float)
            n, first, second = n + len(x), first + x.sum(0), second + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(first), pa.array(second)], names=["at", "n", "first", "second"])

    rows = table.select(column).mapInArrow(sums, "at int, n long, first double, second double").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "first", "second")])
    found = sorted((r["at"], r["n"], r["first"], r["second"]) for r in rows.collect())
    n = found[0][1] if found else 0
    mean = np.array([x[2] for x in found]) / max(1, n)
    return n, mean, np.maximum(0, np.array([x[3] for x in found]) / max(1, n) - mean * mean)


def exact_type(*largest: int) -> type:
    """A float matrix where sums up to the product of ``largest`` are exact in doubles, else integers."""
    return np.float64 if np.prod([float(x) for x in largest]) < 2.0**52 else np.int64
