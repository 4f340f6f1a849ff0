"""Embedding vectors as whole numbers: what operators 11 and 13 share.

A component c becomes floor(256 * c), worked out in double precision and held as a long (values beyond a long's range end at
it).  Vectors that are null or empty, or hold a null, NaN or infinite component, take no part, and neither do vectors of
another length than the commonest one (of equally common lengths the largest counts).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a matrix that one step works on, so that memory does not follow the size of an Arrow batch.
CELLS = 1 << 21
SAFE = 1 << 62


def scale(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * 256))


def scaled(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``x`` (array of long) of the rows that take part, but for the test of the length."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(v.isNotNull() & (F.size(v) > 0)).where(whole).select(F.col(id_col).cast("long").alias("vec_id"), scale(v).alias("x"))


def common_length(rows: DataFrame) -> int:
    """The commonest length of ``x``, 0 of an empty table."""
    top = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 0


def matrix(column) -> np.ndarray:
    """The vectors of a batch as an int64 matrix."""
    return np.stack(column.to_numpy()).astype(np.int64, copy=False)


def steps(rows: int, width: int):
    """Slices of a batch of ``rows`` vectors."""
    size = max(1, CELLS // max(1, width))
    return (slice(at, min(at + size, rows)) for at in range(0, rows, size))


def exact_dots(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Inner product of each row of a with the same row of b, exact; beyond a long's range it ends at it."""
    top = int(np.abs(a.astype(np.float64)).max(initial=0)) * int(np.abs(b.astype(np.float64)).max(initial=0))
    if top * a.shape[1] < SAFE:
        return (a * b).sum(axis=1).tolist()
    return [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in (a.astype(object) * b.astype(object)).sum(axis=1)]
