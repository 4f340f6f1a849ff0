"""Exact search, blocks of vectors or texts against blocks of queries: products by matrices, the few that count term by term.

A task goes through its pairs of blocks and keeps, for each query, what may still be among its k best.  A product of two
blocks only says which pairs come within SLACK of the k-th score so far; these are scored in the order of the components,
as the Column expression does it.  Of equal scores only the k smallest ids are kept, so groups of copies stay bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.shared import written

#: Vectors and queries of a block; pairs that are scored term by term in one step.
VECTORS, QUERIES, STEP = 2048, 512, 1 << 16
#: Texts that a product takes at once, and pairs of a text and a query that are added up at once.
TEXTS, SUMS = 256, 512
#: More than what rounding to nine places moves two scores towards each other, and than the error of a product.
SLACK = 2e-9
#: Keys of scores that are null (after all others) and not a number (before all others).
NULL, NAN = -2.0, 2.0


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vec) as one row a block (ids, vecs)."""
    for batch in batches:
        for at in range(0, batch.num_rows, VECTORS):
            part = batch.slice(at, VECTORS)
            one = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(c)])) for c in range(2)]
            yield pa.RecordBatch.from_arrays(one, ["ids", "vecs"])


class Vectors:
    """A block's ids and vectors; ``sound`` are those without nulls and of the block's width."""

    def __init__(self, ids: pa.Array, vecs: pa.Array):
        self.ids = np.array(ids.to_pylist() if ids.null_count or not pa.types.is_integer(ids.type) else ids.to_numpy())
        lengths = np.array([-1 if n is None else n for n in vecs.value_lengths().to_pylist()])
        whole = np.array([n >= 0 for n in lengths], dtype=bool)
        if (flat := vecs.flatten()).null_count:
            whole &= np.array([v is not None and None not in v for v in vecs.to_pylist()], dtype=bool)
        self.width = int(lengths[whole].max()) if whole.any() else -1
        self.sound = whole & (lengths == self.width)
        self.x = np.zeros((len(lengths), max(self.width, 0)))
        if self.sound.all():
            self.x[:] = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(self.x.shape)
        elif self.sound.any():
            self.x[self.sound] = [v for v, s in zip(vecs.to_pylist(), self.sound, strict=True) if s]
        with np.errstate(all="ignore"):
            self.norms = np.sqrt(in_order(self.x, self.x))
        self.finite = bool(np.isfinite(self.norms).all())
        #: Vectors of other widths, a block of each.
        self.others = [Vectors(ids.take(k), vecs.take(k)) for k in (pa.array(np.flatnonzero(whole & ~self.sound)),) if len(k)]
        if self.others:
            kept = ~whole | self.sound
            self.ids, self.sound, self.x, self.norms = self.ids[kept], self.sound[kept], self.x[kept], self.norms[kept]

    def blocks(self) -> list[Vectors]:
        return [self, *(b for o in self.others for b in o.blocks())]


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products, component after component."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def smallest_first(ids: np.ndarray) -> np.ndarray:
    """Places of ids in their order, nulls first."""
    if ids.dtype != object:
        return ids
    place = {v: i for i, v in enumerate(sorted(set(ids.tolist()), key=lambda v: (v is not None, v)))}
    return np.array([place[v] for v in ids.tolist()], dtype=np.int64)


class Best:
    """What may be among the k best of n queries; a pair counts if its score is above ``floor``."""

    def __init__(self, n: int, k: int, floor: float = -np.inf):
        self.k, self.floor = k, floor
        self.at, self.score, self.ids = np.empty(0, np.int64), np.empty(0), None
        self.least, self.started = np.full(n, -np.inf), False

    def meet(self, near: np.ndarray, ids: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = STEP) -> None:
        """Scores of rows by queries, nearly; ``exact`` (rows, queries) works out those that count."""
        least = self.least
        if not self.started and len(near) > self.k:
            least = np.maximum(least, np.partition(near, len(near) - self.k, axis=0)[len(near) - self.k])
        self.started = True
        rows, cols = np.nonzero((near >= least - SLACK) & (near > self.floor))
        for at in range(0, len(rows), step):
            r, c = rows[at : at + step], cols[at : at + step]
            self.keep(c, exact(r, c), ids[r])

    def keep(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        at, score = np.concatenate([self.at, at]), np.concatenate([self.score, score])
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        order = np.lexsort((smallest_first(ids), -score, at))
        at, score, ids = at[order], score[order], ids[order]
        index = np.arange(len(at))
        new_query = np.r_[True, at[1:] != at[:-1]]
        rank = index - np.maximum.accumulate(np.where(new_query, index, 0))
        again = index - np.maximum.accumulate(np.where(new_query | np.r_[True, score[1:] != score[:-1]], index, 0))
        kth = rank == self.k - 1
        self.least[at[kth]] = np.maximum(self.least[at[kth]], score[kth])
        left = (again < self.k) & (score >= self.least[at] - SLACK)
        self.at, self.score, self.ids = at[left], score[left], ids[left]


def meet_vectors(best: Best, block: Vectors, q: Vectors) -> None:
    if block.width != q.width:
        return best.meet(np.full((len(block.ids), len(q.ids)), NULL), block.ids, lambda r, c: np.full(len(r), NULL))
    with np.errstate(all="ignore"):
        near = block.x @ q.x.T
        near /= np.where((norms := np.outer(block.norms, q.norms)) == 0, 1.0, norms)
    if not (block.finite and q.finite):
        near[np.isnan(near)] = NAN
    near[~block.sound] = NULL
    near[:, ~q.sound] = NULL

    def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            norm = block.norms[r] * q.norms[c]
            score = in_order(block.x[r], q.x[c]) / np.where(norm == 0, 1.0, norm)
        return np.where(block.sound[r] & q.sound[c], np.where(np.isnan(score), NAN, score), NULL)

    best.meet(near, block.ids, exact)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): of every query (query_id, vec) its k best vectors (chunk_id, vec) by cosine and some more, unrounded."""
    ids, kind = vectors.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    double = lambda c: F.col(c).cast("array<double>")
    asked = written(queries.select("query_id", double("vec").alias("vec")), "vector-queries")
    blocks = -(-asked.count() // QUERIES) or 1
    block = F.pmod(F.xxhash64("query_id", F.rand(7)), F.lit(blocks))
    asked = asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("query_id", "vec")).alias("q"))
    asked = written(asked.select("block", F.col("q.query_id").alias("q_ids"), F.col("q.vec").alias("q_vecs")), "query-blocks")
    rows = vectors.select(F.col("chunk_id").alias("id"), double("vec").alias("vec")).mapInArrow(packed, f"ids array<{ids}>, vecs array<array<double>>")
    # Dealt evenly over the tasks, whatever files the vectors come from.
    pairs = rows.withColumn("_d", F.monotonically_increasing_id()).repartition("_d").drop("_d").crossJoin(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[Best]] = {}
        types, last = None, (None, None)
        for batch in batches:
            types = [batch.schema.field(n).type.value_type for n in ("q_ids", "ids")]
            ids, vecs, number = batch.column("ids"), batch.column("vecs"), batch.column("block").to_pylist()
            for i in range(batch.num_rows):
                if number[i] not in best:
                    q = Vectors(batch.column("q_ids")[i].values, batch.column("q_vecs")[i].values)
                    best[number[i]] = [(Best(len(b.ids), k), b) for b in q.blocks()]
                if last[0] is None or not last[0].equals(vecs[i].values):
                    last = (vecs[i].values, Vectors(ids[i].values, vecs[i].values).blocks())
                for b, q in best[number[i]]:
                    for v in last[1]:
                        meet_vectors(b, v, q)
        for b, q in (x for found in best.values() for x in found if len(x[0].at)):
            score = pa.array(np.where(b.score == NAN, np.nan, b.score), mask=b.score == NULL, from_pandas=False)
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[b.at].tolist(), types[0]), pa.array(b.ids.tolist(), types[1]), score], ["query_id", "chunk_id", "score"])

    return pairs.mapInArrow(search, f"query_id {kind}, chunk_id {ids}, score double")


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (chunk_id, length, at, tf), together by chunk with ``at`` 0 for the chunk itself, as one row a block of chunks."""
    rest = None
    for batch in _and_end(batches):
        if batch is not None:
            rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if rest is None or rest.num_rows == 0:
            continue
        ids = rest.column("chunk_id")
        head = np.r_[0, 1 + np.flatnonzero(~np.asarray(_same(ids)))]
        # The last chunk of a batch may go on in the next.
        whole = len(head) if batch is None else len(head) - 1
        if batch is not None and whole < VECTORS:
            continue
        ends = np.r_[head, rest.num_rows]
        for at in range(0, whole, VECTORS):
            first, last = at, min(at + VECTORS, whole)
            part = rest.slice(ends[first], ends[last] - ends[first])
            starts = head[first:last] - head[first]
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [part.column("chunk_id").take(pa.array(starts)), part.column("length").take(pa.array(starts)), pa.array(np.r_[starts, part.num_rows].astype(np.int32)), part.column("at"), part.column("tf")]
            yield pa.RecordBatch.from_arrays([one(x) for x in columns], ["ids", "lengths", "starts", "at", "tf"])
        rest = rest.slice(ends[whole])


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _same(ids: pa.Array) -> np.ndarray:
    """Whether each id but the first is that before it."""
    equal = pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1))
    both = pc.and_(pc.is_null(ids.slice(1)), pc.is_null(ids.slice(0, len(ids) - 1)))
    return pc.or_(pc.fill_null(equal, False), both).to_numpy(zero_copy_only=False)


class Texts:
    """The postings of a block of chunks; EVERY's (``at`` 0) are left out."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda n: batch.column(n)[i].values
        ids = get("ids")
        self.ids = np.array(ids.to_pylist() if ids.null_count or not pa.types.is_integer(ids.type) else ids.to_numpy())
        lengths, starts, at, tf = (get(n).to_numpy(zero_copy_only=False) for n in ("lengths", "starts", "at", "tf"))
        row = np.repeat(np.arange(len(self.ids)), np.diff(starts))
        real = at > 0
        self.row, self.at, self.tf, self.length = row[real], at[real], tf[real].astype(np.float64), lengths[row[real]].astype(np.float64)

    def meet(self, best: Best, words: np.ndarray, weights: np.ndarray, gain: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Scores by queries: ``weights`` of the sorted ``words`` by query."""
        place = np.minimum(np.searchsorted(words, self.at), len(words) - 1)
        hit = words[place] == self.at
        row, place, gains = self.row[hit], place[hit], gain(self.tf[hit], self.length[hit])
        for at in range(0, len(self.ids), TEXTS):
            here = (row >= at) & (row < at + TEXTS)
            x = np.zeros((min(TEXTS, len(self.ids) - at), len(words)))
            x[row[here] - at, place[here]] = gains[here]
            best.meet(x @ weights.T, self.ids[at : at + TEXTS], lambda r, c, x=x: (x[r] * weights[c]).sum(axis=1), SUMS)


def best_texts(blocks: DataFrame, weighted: DataFrame, k: int, gain: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, chunk_id, score): of every query (query_id, at, weight) its k best chunks of ``blocks`` and some more, unrounded.

    A score is the sum of weight times ``gain`` (tf, length) over shared words; chunks that share none are not found.
    """
    ids, kind = blocks.schema["ids"].dataType.elementType.simpleString(), weighted.schema["query_id"].dataType.simpleString()
    asked = written(weighted.groupBy("query_id").agg(F.collect_list("at").alias("at"), F.collect_list("weight").alias("weight")), "text-queries")
    count = -(-asked.count() // QUERIES) or 1
    asked = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(count)).alias("block")).agg(F.collect_list(F.struct("query_id", "at", "weight")).alias("q"))
    asked = written(asked.select("block", F.col("q.query_id").alias("q_ids"), F.col("q.at").alias("q_at"), F.col("q.weight").alias("q_weight")), "query-blocks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        types, last = None, (None, None)
        for batch in batches:
            types = [batch.schema.field(n).type.value_type for n in ("q_ids", "ids")]
            number = batch.column("block").to_pylist()
            for i in range(batch.num_rows):
                if number[i] not in best:
                    at, weight = batch.column("q_at")[i].values, batch.column("q_weight")[i].values
                    words, place = np.unique(at.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
                    weights = np.zeros((len(at), len(words)))
                    weights[np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False)), place] = weight.flatten().to_numpy(zero_copy_only=False)
                    best[number[i]] = (Best(len(at), k, 0.0), batch.column("q_ids")[i].as_py(), words, weights)
                if last[0] is None or not last[0].equals(batch.column("starts")[i].values) or not last[2].equals(batch.column("ids")[i].values):
                    last = (batch.column("starts")[i].values, Texts(batch, i), batch.column("ids")[i].values)
                found, _, words, weights = best[number[i]]
                last[1].meet(found, words, weights, gain)
        for found, q_ids, _, _ in (x for x in best.values() if len(x[0].at)):
            yield pa.RecordBatch.from_arrays([pa.array([q_ids[j] for j in found.at], types[0]), pa.array(found.ids.tolist(), types[1]), pa.array(found.score)], ["query_id", "chunk_id", "score"])

    return blocks.crossJoin(asked).mapInArrow(search, f"query_id {kind}, chunk_id {ids}, score double")
