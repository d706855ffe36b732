"""What the operators over embeddings share: rows that take part, as whole numbers, and blocks of rows that meet."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers up to which sums of doubles are exact.
EXACT = 2**53


def finite(e: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def floored(e: Column, scale: int) -> Column:
    return F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def whole(vectors: DataFrame, scale: int, *more: Column) -> DataFrame:
    """own, vec_id, more, dim, v: the rows whose vector has only finite components, as floor(scale * x).

    own tells repeated rows apart: it is settled once the result is stored.
    """
    e = F.col("embedding")
    rows = vectors.where(finite(e)).select(F.col("vec_id").cast("long").alias("vec_id"), *more, floored(e, scale).alias("v"))
    return rows.select(F.monotonically_increasing_id().alias("own"), *[c for c in rows.columns if c != "v"], F.size("v").alias("dim"), "v")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: type = np.float64) -> np.ndarray:
    """A list column whose lists have dim components, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of the rows of a and of b, exact in doubles."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most >= EXACT:
        raise OverflowError("components are too large for exact scores: their products must stay below 2**53")
    return (a @ b.T).astype(np.int64)


def blocks_meet(rows: DataFrame, asked: DataFrame, func: Callable[[pa.Table, pa.Table], pa.Table], kinds: str, block_rows: int, asked_rows: int) -> DataFrame:
    """func over each block of rows and each block of asked of the same dim, both dealt by hash: every row meets every asked one once.

    Both are stored tables with own and dim. A group holds about block_rows and asked_rows rows, however large the tables are;
    a row is copied for each block of asked rows, an asked row for each block of rows.
    """
    m, n = -(-rows.count() // block_rows) or 1, -(-asked.count() // asked_rows) or 1

    def dealt(df: DataFrame, mine: str, of: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(mine, F.pmod(F.xxhash64("own"), F.lit(of)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    key = ["dim", "block", "chunk"]
    left, right = dealt(rows, "block", m, "chunk", n), dealt(asked, "chunk", n, "block", m)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, where both come from one table
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(func, kinds)
