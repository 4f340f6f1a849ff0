"""Embedding whitening: projection on the leading components of the covariance, each with unit variance.

The covariance is that of the fit list, in which each distinct vector of whole numbers stands once, so that copies don't
weigh more.  Its sums are exact integers; a row is centred as (n * x - S) / n, rounded once, and goes to Spark MLlib's
RowMatrix, whose Gramian divided by n is the covariance.  The eigenvectors of that matrix (dimensions squared, not rows) are
found on the driver and broadcast; the rows are projected where they lie.  The covariance of the projected fit list is
measured again, and its distance from the identity is part of the result.

A hot vector is combined before the shuffle of the distinct vectors; sums and Gramians are combined inside tasks.

Defined cases: see ``vectors`` for the rows that take part; a null id stays a row; repeated rows stay rows and count once in the
fit; an empty table gives an empty result; of fewer dimensions than ``components`` there are as many components.  A component
without variance (eigenvalue at most dimensions * 2**-52 of the largest) can't be whitened: its ``whitened`` is null and it
takes no part in ``identity_error`` (0.0 if there is no other); ``explained`` is null if no component has variance.
``deviation`` is null where it does not fit in a long.  The largest entry of a component's eigenvector is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import stash
from ledgermill.llm.vectors import SAFE, common_length, matrix, scaled, steps

COMPONENTS = 4
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """n distinct vectors with their sums; per component a unit vector, its eigenvalue, and whether it has variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def varied(self) -> np.ndarray:
        return self.values > len(self.sums) * 2.0**-52 * max(self.values.max(initial=0.0), 0.0)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: int64, or Python's integers where 64 bits don't hold them."""
        most = int(np.abs(x.astype(np.float64)).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most < SAFE:
            return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.offsets(x) / self.n).astype(np.float64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """One column per component; NaN where it has no variance."""
        scale = np.where(self.varied, np.sqrt(np.where(self.varied, self.values, 1.0)), np.nan)
        return self.centred(x) @ self.vectors / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = self.offsets(x)
        about = (y.astype(np.float64) ** 2).sum(axis=1)
        if y.dtype == np.int64 and about.max(initial=0) < SAFE:
            return (y * y).sum(axis=1).tolist()
        return [s if near < 2.0**64 and (s := int((row.astype(object) ** 2).sum())) < 1 << 63 else None for row, near in zip(y, about)]


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's exact sums: a row per dimension; dimension -1 counts the vectors."""
    n, total = 0, None
    for pdf in batches:
        if len(pdf):
            x = matrix(pdf["x"])
            safe = int(np.abs(x.astype(np.float64)).max()) * len(x) < SAFE
            part = (x if safe else x.astype(object)).sum(axis=0).astype(object)
            n, total = n + len(x), part if total is None else total + part
    if n:
        yield pd.DataFrame({"dim": range(-1, len(total)), "part": [str(v) for v in (n, *total)]})


def _gramian(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of ``v`` (array of double) with itself."""
    wide = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(wide, 0, width).computeGramianMatrix().toArray()


def _rows(df: DataFrame, of) -> DataFrame:
    """``v``: of(x) for every row's ``x``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in steps(len(pdf), len(pdf["x"].iat[0]) if len(pdf) else 1):
                yield pd.DataFrame({"v": list(of(matrix(pdf["x"].iloc[at])))})

    return df.mapInPandas(run, "v array<double>")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``x`` (array of long, one length), from each distinct vector once."""
    spark = rows.sparkSession
    once = stash(rows.select("x").distinct(), "fit-list")
    found = {r["dim"]: int(r["total"]) for r in once.mapInPandas(_sums, "dim int, part string").groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}
    n, sums = found.pop(-1), [found[k] for k in sorted(found)]
    width = len(sums)
    plain = spark.sparkContext.broadcast(Whitening(n, sums, np.empty((0, 0)), np.empty(0), 0.0))
    cov = _gramian(_rows(once, lambda x: plain.value.centred(x)), width) / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    model = Whitening(n, sums, vectors, np.maximum(values[order], 0.0), float(np.trace(cov)))
    kept = np.flatnonzero(model.varied)
    if len(kept):
        shared = spark.sparkContext.broadcast(model)
        projected = stash(_rows(once, lambda x: shared.value.whiten(x)[:, kept]), "whitened-fit-list")
        means = projected.agg(*[F.avg(F.col("v")[k]).alias(f"m{k}") for k in range(len(kept))]).first()
        again = _gramian(projected.select(F.transform("v", lambda e, i: e - F.array(*[F.lit(m) for m in means])[i]).alias("v")), len(kept)) / n
        model.identity_error = float(np.abs(again - np.eye(len(kept))).max())
    return model


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component."""
    spark = df.sparkSession
    rows = scaled(df, id_col, vector_col)
    width = common_length(rows)
    if not width:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("x") == width)
    model = fit(rows, components)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        k = len(m.values)
        explained = m.values / m.trace if m.trace > 0 else np.full(k, np.nan)
        for pdf in batches:
            for at in steps(len(pdf), width):
                x, ids = matrix(pdf["x"].iloc[at]), pdf["vec_id"].iloc[at]
                yield pd.DataFrame(
                    {
                        "vec_id": pd.array(ids, dtype="Int64").repeat(k),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                        "n": m.n,
                        "deviation": pd.array(m.deviations(x), dtype="Int64").repeat(k),
                        "whitened": pd.array(m.whiten(x).ravel(), dtype="Float64"),
                        "explained": pd.array(np.tile(explained, len(x)), dtype="Float64"),
                        "identity_error": m.identity_error,
                    }
                )

    none_for_nan = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("whitened", "explained")]
    return rows.mapInPandas(run, RESULT).select("vec_id", "component", "n", "deviation", *none_for_nan, "identity_error")
