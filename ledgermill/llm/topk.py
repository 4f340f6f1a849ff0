"""Exact top-k search by inner product, with a vector-approximation file.

Every dimension's range is cut into ``2 ** bits`` equal cells; the file holds one byte a dimension for each distinct vector.  A
cell's two ends bound the products with it, so a scan of the file bounds every score.  The first scan finds, for each query,
the k-th largest lower bound; the second keeps the vectors whose upper bound reaches it.  Only those vectors are read
exactly, in the order of their bounds, in rounds that grow, until the k-th score found is above every bound left.

Equal vectors are one entry of the file with their k + 1 smallest ids: of copies that score alike no others can be among the
first k, whichever of them is the query's own.  Queries are met in waves of at most ``WAVE_CELLS`` components, so what is
broadcast, and how often a hub among the vectors is asked for in one wave, is bounded.

The work of the scans is queries times vectors, in blocks, as the search is exact and the queries are a stated share of the
rows; what the bounds save is the exact vectors and their products.

Defined cases: see ``vectors`` for the rows that take part.  Rows with the query's id are its own and no candidates of it; a row
repeated in full (id and vector) counts once; rows of one id with different vectors are queries, and candidates, of their
own; a null id is never a query but a candidate, after all others of its score.  With fewer than k candidates all are
returned, with none nothing.  Scores are exact; beyond a long's range they end at it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import discard, new_path, stash
from ledgermill.llm.vectors import common_length, exact_dots, matrix, scaled, steps

K, BITS = 5, 6
#: Components of all queries of a wave together: 16 MB as whole numbers.
WAVE_CELLS = 1 << 21
#: Vectors and queries whose bounds are worked out in one step.
ROWS, QUERIES = 2048, 512
REACHING = "q long, row long, upper double"
LEFT = f"{REACHING}, wave int"
RESULT = "query_id long, rank int, vec_id long, score long"


class Cells:
    """Equal cells over each dimension's range [low, high] of whole numbers."""

    def __init__(self, low: list[int], high: list[int], bits: int):
        self.low, self.count = low, 1 << bits
        self.span = [h - l + 1 for l, h in zip(low, high)]
        ends = [[l - (-c * s // self.count) for c in range(self.count + 1)] for l, s in zip(low, self.span)]
        first, last = np.array([e[:-1] for e in ends], dtype=np.float64), np.array([[v - 1 for v in e[1:]] for e in ends], dtype=np.float64)
        self.middle, self.radius = (first + last) / 2, np.maximum(last - first, 0) / 2
        self.most = np.array([max(abs(l), abs(h)) for l, h in zip(low, high)], dtype=np.float64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        small = max(self.span) * self.count < 1 << 62
        kind = np.int64 if small else object
        return ((x.astype(kind) - np.array(self.low, dtype=kind)) * self.count // np.array(self.span, dtype=kind)).astype(np.uint8)

    def boxes(self, codes: np.ndarray) -> np.ndarray:
        """Middles and radii of the cells, side by side."""
        dims = np.arange(codes.shape[1])
        return np.hstack([self.middle[dims, codes], self.radius[dims, codes]])

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """More than the rounding of any bound of each query."""
        return np.abs(queries) @ self.most * 2.0**-40


class Wave:
    """Queries that meet the file in one scan: their numbers, ids and vectors."""

    def __init__(self, rows: list, cells: Cells):
        self.q = np.array([r["q"] for r in rows], dtype=np.int64)
        self.ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        self.x = np.array([r["qx"] for r in rows], dtype=np.float64)
        self.slack = cells.slack(self.x)
        self.blocks = [slice(at, at + QUERIES) for at in range(0, len(rows), QUERIES)]
        self.floor: np.ndarray | None = None

    def own(self, sole: np.ndarray, alone: np.ndarray, block: slice) -> tuple[np.ndarray, np.ndarray]:
        """(vector, query) places in a step where the vector is only the query's own."""
        order = np.argsort(self.ids[block], kind="stable")
        ids = self.ids[block][order]
        lo = np.searchsorted(ids, sole, "left")
        hi = np.where(alone, np.searchsorted(ids, sole, "right"), lo)
        rows = np.repeat(np.arange(len(sole)), hi - lo)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        return rows, order[at]


def _steps(batches: Iterator[pd.DataFrame], cells: Cells) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, sole ids, whether there is only one, and boxes of the file's vectors, step by step."""
    for pdf in batches:
        for at in range(0, len(pdf), ROWS):
            part = pdf.iloc[at : at + ROWS]
            codes = np.frombuffer(b"".join(part["code"]), dtype=np.uint8).reshape(len(part), -1)
            yield part["row"].to_numpy(), part["sole"].to_numpy(), part["alone"].to_numpy(), cells.boxes(codes)


def _lower(shared, k: int):
    """A scan that returns each task's k largest lower bounds of every query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, wave = shared.value
        best = np.full((k, len(wave.q)), -np.inf)
        for _, sole, alone, boxes in _steps(batches, cells):
            for b in wave.blocks:
                q = wave.x[b].T
                bound = boxes @ np.vstack([q, -np.abs(q)]) - wave.slack[b]
                bound[wave.own(sole, alone, b)] = -np.inf
                up = np.flatnonzero(bound.max(axis=0) > best[:, b].min(axis=0))
                if len(up):
                    both = np.vstack([best[:, b][:, up], bound[:, up]])
                    best[:, b.start + up] = -np.partition(-both, k - 1, axis=0)[:k]
        got = np.nonzero(best > -np.inf)
        if len(got[0]):
            yield pd.DataFrame({"q": wave.q[got[1]], "bound": best[got]})

    return run


def _reaching(shared):
    """A scan that returns the vectors whose upper bound reaches the query's floor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, wave = shared.value
        for row, sole, alone, boxes in _steps(batches, cells):
            for b in wave.blocks:
                q = wave.x[b].T
                bound = boxes @ np.vstack([q, np.abs(q)]) + wave.slack[b]
                reach = bound >= wave.floor[b]
                reach[wave.own(sole, alone, b)] = False
                v, at = np.nonzero(reach)
                if len(v):
                    yield pd.DataFrame({"q": wave.q[b][at], "row": row[v], "upper": bound[v, at]})

    return run


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    low = high = None
    for pdf in batches:
        if len(pdf):
            x = matrix(pdf["x"])
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
    if low is not None:
        yield pd.DataFrame({"dim": range(len(low)), "low": low, "high": high})


def _coded(cells: Cells):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in steps(len(pdf), len(cells.low)):
                part = pdf.iloc[at]
                yield part[["row", "sole", "alone"]].assign(code=[c.tobytes() for c in cells.codes(matrix(part["x"]))])

    return run


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in steps(len(pdf), len(pdf["x"].iat[0]) if len(pdf) else 1):
            part = pdf.iloc[at]
            yield part[["q", "query_id", "ids"]].assign(score=exact_dots(matrix(part["x"]), matrix(part["qx"])))


def vector_file(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: ``row``, ``x``, their k + 1 smallest ``ids``, whether there is one ``alone``, and that one, ``sole``."""
    hashed = rows.select("vec_id", "x", F.xxhash64("x").alias("h")).groupBy("h", "x", "vec_id").agg(F.count(F.lit(1)).alias("copies"))
    few = hashed.withColumn("at", F.row_number().over(Window.partitionBy("h", "x").orderBy(F.col("vec_id").asc_nulls_last()))).where(F.col("at") <= k + 1)
    held = few.groupBy("h", "x").agg(F.collect_list(F.struct("vec_id")).alias("ids"))
    first = F.col("ids")[0]["vec_id"]
    alone = ((F.size("ids") == 1) & first.isNotNull()).alias("alone")
    return stash(held.select(F.monotonically_increasing_id().alias("row"), "x", "ids", alone, F.coalesce(first, F.lit(0)).alias("sole")), "vectors")


def _waves(asked: DataFrame, width: int) -> list[DataFrame]:
    """The queries in parts of at most WAVE_CELLS components."""
    most = max(1, WAVE_CELLS // width)
    total = asked.count()
    if total <= most:
        return [asked] if total else []
    n = 2 * -(-total // most)
    while asked.groupBy(F.pmod(F.xxhash64("q"), F.lit(n))).count().agg(F.max("count")).first()[0] > most:
        n *= 2
    return [asked.where(F.pmod(F.xxhash64("q"), F.lit(n)) == i) for i in range(n)]


def _candidates(asked: DataFrame, coded: DataFrame, cells: Cells, k: int) -> DataFrame:
    """``wave, q, row, upper``: vectors whose upper bound reaches the k-th largest lower bound of the query; two scans a wave."""
    spark = asked.sparkSession
    path = new_path(spark, "candidates")
    for number, part in enumerate(_waves(asked, len(cells.low))):
        rows = part.collect()  # at most WAVE_CELLS components
        if not rows:
            continue
        wave = Wave(rows, cells)
        shared = spark.sparkContext.broadcast((cells, wave))
        bounds = coded.mapInPandas(_lower(shared, k), "q long, bound double")
        kth = bounds.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound")))).where(F.col("at") == k)
        floor = {r["q"]: r["bound"] for r in kth.select("q", "bound").collect()}  # one row a query of the wave
        wave.floor = np.array([floor.get(q, -np.inf) for q in wave.q.tolist()])
        shared = spark.sparkContext.broadcast((cells, wave))
        coded.mapInPandas(_reaching(shared), REACHING).write.parquet(f"{path}/wave={number}")
    return spark.read.schema(LEFT).parquet(path)


def _certain(asked: DataFrame, vectors: DataFrame, left: DataFrame, k: int) -> DataFrame:
    """``q, query_id, vec_id, score``: the first k, reading exact vectors by falling bound until none left can be among them."""
    spark, take, best = asked.sparkSession, 2 * k, None
    by_bound = Window.partitionBy("q").orderBy(F.desc("upper"), "row")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    old: list[str] = []
    while True:
        paths = [new_path(spark, name) for name in ("candidates-read", "first-k", "candidates-left")]
        left.withColumn("at", F.row_number().over(by_bound)).where(F.col("at") <= take).write.parquet(paths[0])
        taken = spark.read.schema(f"{LEFT}, at int").parquet(paths[0])
        read = taken.select("row", "wave").distinct().join(vectors.select("row", "x", "ids"), "row")
        pairs = taken.select("q", "row", "wave").join(read, ["row", "wave"]).join(asked, "q").select("q", "query_id", "ids", "x", "qx")
        scored = pairs.mapInPandas(_scored, "q long, query_id long, ids array<struct<vec_id: long>>, score long")
        found = scored.select("q", "query_id", F.explode("ids").alias("i"), "score").select("q", "query_id", F.col("i.vec_id").alias("vec_id"), "score")
        found = found.where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
        all_found = found if best is None else best.unionByName(found)
        all_found.withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= k).drop("at").write.parquet(paths[1])
        best = spark.read.schema(all_found.schema).parquet(paths[1])
        kth = best.groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).alias("kth"))
        last = taken.where(F.col("at") == take).select("q", F.col("upper").alias("last"), F.col("row").alias("last_row"))
        behind = (F.col("upper") < F.col("last")) | ((F.col("upper") == F.col("last")) & (F.col("row") > F.col("last_row")))
        rest = left.join(last.join(kth, "q", "left"), "q").where(behind & (F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))))
        rest.select(left.columns).write.parquet(paths[2])
        left = spark.read.schema(LEFT).parquet(paths[2])
        for path in old:
            discard(spark, path)
        old, take = paths, take * 8
        if left.isEmpty():
            return best


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, bits: int = BITS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of every row that ``is_query`` (over ``vec_id``) holds for, the k rows with the highest scores."""
    spark = df.sparkSession
    if not 1 <= bits <= 8:
        raise ValueError("a cell's number is one byte: bits must be 1 to 8")
    rows = scaled(df, id_col, vector_col)
    width = common_length(rows)
    if not width:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("x") == width)
    vectors = vector_file(rows, k)
    ranges = vectors.mapInPandas(_ranges, "dim int, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    cells = Cells([r["low"] for r in ranges], [r["high"] for r in ranges], bits)
    coded = stash(vectors.select("row", "sole", "alone", "x").mapInPandas(_coded(cells), "row long, sole long, alone boolean, code binary"), "vector-approximations")
    chosen = rows.where(F.col("vec_id").isNotNull() & is_query).distinct()
    asked = stash(chosen.select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), F.col("x").alias("qx")), "queries")
    if asked.isEmpty():
        return spark.createDataFrame([], RESULT)
    best = _certain(asked, vectors, _candidates(asked, coded, cells, k), k)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return best.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score")


def every_fiftieth(df: DataFrame) -> DataFrame:
    return search(df, F.col("vec_id") % 50 == 0)


#: The same in DuckDB: every score, ranked.
ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
w AS (SELECT * FROM v WHERE len(x) = (SELECT len(x) FROM v GROUP BY len(x) ORDER BY count(*) DESC, len(x) DESC LIMIT 1)),
s AS (SELECT q.vec_id AS query_id, q.x AS qx, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qx ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}"""
