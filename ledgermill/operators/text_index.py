"""An inverted index that lives: versions of words and blocks, deletions and statistics in one folder, and exact top-k search.

Every change is a version.  Its rows lie in partitions ``version=n`` of four tables:

* ``chunks``: (block, chunk_id, length, words), a row a chunk, its words counted.  A text is cut into words once, when it is added;
  everything else comes from here.
* ``blocks``: (term, block, max_tf, min_length, df, total), the blocks of about BLOCK chunks that hold a term: largest tf and
  smallest length, which bound any score in there, number and length of the chunks that hold it.  A block that a batch
  of rows ends in has two rows of a term; bounds are added up and stay bounds, as they do when chunks are deleted.
* ``gone``: chunk_ids whose rows of earlier versions no longer count.  Adding a chunk that is there replaces it.
* ``terms``: what the version changes in each term's document frequency, and for EVERY in the number of chunks and their length.

A version counts once the ``log`` has a row of it, which is written last: an interrupted change leaves nothing that a search
reads, and the next one writes over its partitions.  ``compact`` writes what is live as one version that replaces all before.
One change at a time: writers of the same folder must take turns; searches may run beside them and see one version.

Defined cases: a null body has no words and counts as a chunk of length 1; of repeated rows of one chunk_id in a batch one
stays, the one with the greatest body; removing an id that isn't there changes nothing; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.operators import blocks
from ledgermill.operators.retrieval import EVERY, K1, STOPWORDS, B, asked_terms, counted, numbered, packed, tokens, top
from ledgermill.shared import written

#: Chunks of a block, about; blocks per query that are scored first, to learn what the k-th score is at least.
BLOCK, SEEDS = 32, 16
#: Queries that blocks are left out for, at most.  Bounds are a row for each query and block, and a block that one query needs is scored
#: for all of them: for many queries at once that is more work than scoring every block.
BOUNDED = 32
#: Scores are sums in any order: a block is left out only if its bound is lower by more than this.
SLACK = 1e-6


@dataclass(frozen=True)
class Asked:
    """Terms of queries: ``weights`` (query_id, term, at, weight), ``places`` (term, at), and the chunks' mean length."""

    weights: DataFrame
    places: DataFrame
    mean: float


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    stopwords: tuple[str, ...] = STOPWORDS

    @staticmethod
    def create(like: DataFrame, path: str, stopwords: tuple[str, ...] = STOPWORDS) -> TextIndex:
        """An empty index; ``like`` has the type of chunk_id."""
        index = TextIndex(like.sparkSession, path, stopwords)
        chunk = like.schema["chunk_id"].dataType.simpleString()
        tables = {
            "log": "version long, base long",
            "chunks": f"block int, chunk_id {chunk}, length int, words array<struct<term: string, tf: bigint>>",
            "blocks": "term string, block int, max_tf long, min_length int, df long, total long",
            "gone": f"chunk_id {chunk}",
            "terms": "term string, df long, total long",
        }
        for name, schema in tables.items():
            empty = index.spark.createDataFrame([], schema)
            index._write(name, 0, empty)
        return index

    def _write(self, name: str, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}" if name != "log" else f"{self.path}/log/{version}")

    def _state(self, version: int | None = None) -> tuple[int, int]:
        """(version, base): the latest, or the one asked for, and the version that it builds on."""
        log = self.spark.read.schema("version long, base long").option("recursiveFileLookup", "true").parquet(f"{self.path}/log")
        row = (log if version is None else log.where(F.col("version") <= version)).agg(F.max("version"), F.max("base")).first()
        return row[0] or 0, row[1] or 0

    def _read(self, name: str, state: tuple[int, int]) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows.where((F.col("version") <= state[0]) & (F.col("version") >= state[1]))

    def _live(self, state: tuple[int, int]) -> DataFrame:
        """(block, chunk_id, length, words, version) of the chunks that count."""
        gone = self._read("gone", state).groupBy("chunk_id").agg(F.max("version").alias("_gone"))
        return self._read("chunks", state).join(gone, "chunk_id", "left").where(F.col("_gone").isNull() | (F.col("version") >= F.col("_gone"))).drop("_gone")

    def _live_of(self, state: tuple[int, int], ids: DataFrame) -> DataFrame:
        return self._live(state).select("chunk_id").join(ids.select("chunk_id"), "chunk_id", "left_semi")

    def _commit(self, state: tuple[int, int], added: DataFrame, gone: DataFrame, terms: DataFrame | None = None) -> int:
        """Write a version: chunks ``added`` (block, chunk_id, length, words) and live ids ``gone``; one with ``terms`` replaces all before."""
        version = state[0] + 1
        self._write("gone", version, gone)
        self._write("chunks", version, added.select("block", "chunk_id", "length", "words"))
        here = lambda name: self.spark.read.parquet(f"{self.path}/{name}/version={version}")
        kept = "term string, block int, max_tf long, min_length int, df long, total long"
        self._write("blocks", version, here("chunks").select("block", "length", "words").mapInArrow(bounds_of, kept))
        if terms is None:
            lost = self._live(state).join(here("gone"), "chunk_id", "left_semi")
            every = lambda rows, sign: rows.agg(F.lit(EVERY).alias("term"), (sign * F.count(F.lit(1))).alias("df"), (sign * F.sum("length")).alias("total"))
            minus = lost.select("length", F.explode("words.term").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("length")).alias("total"))
            changes = here("blocks").select("term", "df", "total").unionByName(minus).unionByName(every(here("chunks"), 1)).unionByName(every(lost, -1))
            delta = changes.groupBy("term").agg(F.sum("df").alias("df"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
        else:
            delta = terms
        self._write("terms", version, delta)
        self._write("log", version, self.spark.createDataFrame([(version, state[1] if terms is None else version)], "version long, base long").coalesce(1))
        return version

    @staticmethod
    def _in_blocks(rows: DataFrame) -> DataFrame:
        """Rows with the number of their block, dealt over the tasks by it, those of a block together."""
        count = rows.select("chunk_id").count()
        block = F.pmod(F.xxhash64(F.col("chunk_id").cast("string")), F.lit(max(1, -(-count // BLOCK)))).cast("int")
        return rows.withColumn("block", block).repartition("block").sortWithinPartitions("block")

    def _cut(self, chunks: DataFrame) -> DataFrame:
        """(block, chunk_id, length, words) of chunks (chunk_id, body)."""
        rows = chunks.select("chunk_id", "body")
        if not rows.groupBy("chunk_id").count().where("count > 1").isEmpty():
            rows = rows.groupBy("chunk_id").agg(F.max("body").alias("body"))
        toks = self._in_blocks(rows).select("block", "chunk_id", tokens(F.coalesce("body", F.lit("")), self.stopwords).alias("t"))
        return toks.select("block", "chunk_id", F.greatest(F.size("t"), F.lit(1)).alias("length"), counted(F.col("t")).alias("words"))

    def add(self, chunks: DataFrame) -> int:
        """Add chunks (chunk_id, body), in place of those of the same ids; the new version."""
        state = self._state()
        return self._commit(state, self._cut(chunks), self._live_of(state, chunks))

    def remove(self, ids: DataFrame) -> int:
        """Remove chunks by id (chunk_id); the new version."""
        state = self._state()
        return self._commit(state, self._read("chunks", state).where("false"), self._live_of(state, ids))

    def compact(self) -> int:
        """What is live as one version, on which later ones build; the rows found stay the same."""
        state = self._state()
        return self._commit(state, self._in_blocks(self._live(state)), self._read("gone", state).select("chunk_id").where("false"), self._terms(state))

    def terms(self, version: int | None = None) -> DataFrame:
        """(term, df, total): live chunks that hold the term, and their length; EVERY stands for all chunks."""
        return self._terms(self._state(version))

    def _terms(self, state: tuple[int, int]) -> DataFrame:
        return self._read("terms", state).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where("df > 0")

    def bounded(self, queries: DataFrame, k: int, version: int | None = None) -> DataFrame:
        """(query_id, version, block, bound, kept): the blocks of every query, ``kept`` if one of the k best may lie there."""
        state = self._state(version)
        return self._bounded(state, self._asked(state, queries), k)

    def _asked(self, state: tuple[int, int], queries: DataFrame) -> Asked:
        terms = self._terms(state)
        row = terms.where(F.col("term") == EVERY).first()
        n, mean = (row["df"], row["total"] / row["df"]) if row else (0, 1.0)
        idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = asked_terms(queries, self.stopwords).join(terms.where(F.col("term") != EVERY), "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))
        weights = written(asked, "asked-weights")
        places = numbered(weights)
        return Asked(written(weights.join(places, "term"), "asked-places"), places, mean)

    def _bounded(self, state: tuple[int, int], asked: Asked, k: int) -> DataFrame:
        # A block's terms meet the queries' where they are read and are added up there; what is shuffled are sums.
        gain = _gain(F.col("max_tf"), F.col("min_length"), asked.mean)
        met = self._read("blocks", state).select("term", "version", "block", "max_tf", "min_length").join(asked.weights, "term")
        bounds = written(met.groupBy("query_id", "version", "block").agg(F.sum(F.col("weight") * gain).alias("bound")), "block-bounds")
        first = top(bounds.select("query_id", "version", "block", F.col("bound").alias("score"), F.struct("version", "block").alias("chunk_id")), SEEDS)
        seeds = top(self._scored(state, asked, first, k), k)
        least = seeds.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        return bounds.join(least, "query_id", "left").select("query_id", "version", "block", "bound", (F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).alias("kept"))

    def _scored(self, state: tuple[int, int], asked: Asked, parts: DataFrame | None, k: int) -> DataFrame:
        """(query_id, chunk_id, score): of every query its k best live chunks, in the blocks of ``parts`` (version, block) if there are any given, and some more."""
        live = self._live(state)
        if parts is not None:
            live = live.join(written(parts.select("version", "block").distinct(), "kept-blocks"), ["version", "block"], "left_semi")
        rows = live.select("chunk_id", "length", F.explode("words").alias("w"))
        found = packed(rows.select("chunk_id", "length", "w.term", "w.tf"), asked.places)
        mean = asked.mean
        return blocks.best_texts(found, asked.weights, k, lambda tf, length: _gain(tf, length, mean)).withColumn("score", F.round("score", 9))

    def search(self, queries: DataFrame, k: int = 12, version: int | None = None) -> DataFrame:
        """Top k live chunks of every query (query_id, text) by Okapi BM25 with their rank: the rows of an index built anew.

        Blocks are scored for all queries at once: of up to BOUNDED queries those that may hold one of the k best of any, of more all blocks.
        """
        state = self._state(version)
        asked = self._asked(state, queries)
        few = asked.weights.select("query_id").distinct().count() <= BOUNDED
        return top(self._scored(state, asked, self._bounded(state, asked, k).where("kept") if few else None, k), k)


def bounds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (block, length, words), together by block, as a row (term, block, max_tf, min_length, df, total) for each term of a block."""
    for batch in batches:
        lists = batch.column("words")
        row, flat = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
        if not len(flat):
            continue
        block, length = (batch.column(n).to_numpy(zero_copy_only=False)[row].astype(np.int64) for n in ("block", "length"))
        coded = pc.struct_field(flat, "term").dictionary_encode()
        places = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(places), np.int64)
        rank[places.to_numpy(zero_copy_only=False)] = np.arange(len(places))
        width = int(block.max()) + 1
        key = rank[coded.indices.to_numpy(zero_copy_only=False)] * width + block
        order = np.argsort(key)
        key, length, tf = key[order], length[order], pc.struct_field(flat, "tf").to_numpy(zero_copy_only=False)[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        term = coded.dictionary.take(places.take(pa.array(key[starts] // width)))
        columns = [term, (key[starts] % width).astype(np.int32), np.maximum.reduceat(tf, starts), np.minimum.reduceat(length, starts).astype(np.int32), np.diff(np.r_[starts, len(key)]), np.add.reduceat(length, starts)]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["term", "block", "max_tf", "min_length", "df", "total"])


def _gain(tf, length, mean: float):
    """What a term of weight 1 adds to a score; it rises with tf and falls with length, so block maxima bound it."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
