"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into permuted blocks by a seeded hash of its documents' ids and texts (MD5, so that SQL can follow it).
Targets are shared by weight (a source stops at ``MAX_REPEATS`` times its size, the excess is shared again), which gives
each source an exact quota of blocks: whole passes over all its blocks, and for the last pass the first blocks of its
permutation.  A binary tree over the output shards splits the quota vector with a multivariate hypergeometric draw at every
node (inverse transform of a hashed uniform, source by source), so the leaves' quotas are disjoint and add up exactly; every
shard then draws its blocks from an affine permutation of each source's block sequence and is shuffled locally by a seeded
hash.  What the mix takes of a document is the sum of what the leaves take of it.

What reaches the driver is one row per source (not per document or block) and the tree, sources times output shards; beyond
``BROADCAST_SOURCES`` sources the plan is joined by a shuffle instead of broadcast.  The decision for a document is an
expression over its own row: no document is shuffled, and a source that holds a third of all rows is just more blocks.  Only
rows that stand exactly at a source's cut are numbered, after equal ones are counted together.

Defined cases: a null text has no words; a null source is a source of its own and comes last; null ids hash like an
empty id; rows repeated in full share a place in their permutation, and where the cut falls among them the first few are
taken, so that sums stay exact; an empty table gives an empty plan; a source without words has a target of 0.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import WORD, stash

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2.0
OUT_SHARDS = 16
BLOCK_WORDS = 16_384
MAX_BLOCKS = 16_384
SEED = 20_240
#: The plan has one row a source; it is broadcast up to this many.
BROADCAST_SOURCES = 20_000


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = MAX_REPEATS) -> list[float]:
    """Shares of ``total`` by weight; who would pass ``most`` times its size stops there and the excess is shared again."""
    targets, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in over:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def uniform(seed: int, lo: int, hi: int, src: int) -> float:
    """The node's number in [0, 1) for a source, from the first 52 bits of an MD5."""
    return int(hashlib.md5(f"{seed}:{lo}:{hi}:{src}".encode()).hexdigest()[:13], 16) / float(1 << 52)


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    logs = _log_factorials(int(np.max(n, initial=0)))
    return logs[n] - logs[k] - logs[n - k]


_LOGS = np.zeros(1)


def _log_factorials(n: int) -> np.ndarray:
    """Logarithms of 0! to n!."""
    global _LOGS
    if len(_LOGS) <= n:
        _LOGS = np.array([math.lgamma(k + 1) for k in range(max(n + 1, 2 * len(_LOGS)))])
    return _LOGS


def hypergeometric(good: int, bad: int, sample: int, u: float) -> int:
    """Good ones among ``sample`` drawn without return: the number of outcomes whose distribution function is at most u."""
    k = np.arange(max(0, sample - bad), min(good, sample) + 1)
    ways = log_choose(np.full(len(k), good), k) + log_choose(np.full(len(k), bad), sample - k) - log_choose(np.array([good + bad]), np.array([sample]))
    return int(k[0]) + min(int((np.cumsum(np.exp(ways)) <= u).sum()), len(k) - 1)


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(sources, shards) counts of blocks: each node deals half of its shards their exact part of every quota."""
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def deal(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = counts
            return
        mid = (lo + hi) // 2
        rest = int(counts.sum())
        some = rest * (mid - lo) // (hi - lo)
        left = np.zeros_like(counts)
        for i, n in enumerate(counts.tolist()):
            if some and n:
                left[i] = hypergeometric(n, rest - n, some, uniform(seed, lo, hi, i)) if n < rest else some
            rest -= n
            some -= int(left[i])
        deal(left, lo, mid)
        deal(counts - left, mid, hi)

    if len(quotas):
        deal(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def measured(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with ``size`` (words) and the two seeded hashes that place them in their source."""
    key = F.concat_ws(":", F.lit(str(SEED)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    digest = F.md5(key.cast("binary"))
    return docs.withColumns({
        "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "_block_hash": F.conv(F.substring(digest, 1, 10), 16, 10).cast("long"),
        "_inner_hash": F.substring(digest, 11, 16),
    })


def plan(sized: DataFrame, out_shards: int = OUT_SHARDS, block_words: int = BLOCK_WORDS, whole_documents: bool = False, seed: int = SEED) -> DataFrame:
    """One row per source: totals, targets, passes, the cut of the last pass, and the leaves of the splitting tree.

    The cut is a place (block, inner hash) and how many words are missing there; ``whole_documents`` rounds that to whole
    documents, whichever is nearer, otherwise the last document gives just the words that are missing.
    """
    spark = sized.sparkSession
    totals = sorted(sized.groupBy("source").agg(F.sum("size").alias("words")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["words"] or 0) for r in totals]
    targets = water_fill(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], TOTAL_SHARE * sum(sizes))
    rows = []
    for i, (r, size, target) in enumerate(zip(totals, sizes, targets, strict=True)):
        passes = min(int(MAX_REPEATS), int(target // size)) if size else 0
        rows.append((i, r["source"], size, float(target), passes, max(0, round(target) - passes * size), min(MAX_BLOCKS, max(1, math.ceil(size / block_words)))))
    sources = spark.createDataFrame(rows, "src int, source string, source_size long, target double, passes int, rest long, blocks long")
    # Rows that share a place are one row with a count: equal ones are added up before anything is ordered.
    placed = with_source(sized, sources, len(rows)).groupBy("src", "block", "_inner_hash", "rest").agg(F.sum("size").alias("words"), F.max("size").alias("size"))
    per_block = placed.groupBy("src", "block", "rest").agg(F.sum("words").alias("words"))
    upto = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_block = (
        per_block.withColumn("end", F.sum("words").over(upto))
        .where((F.col("end") - F.col("words") < F.col("rest")) & (F.col("end") >= F.col("rest")))
        .groupBy("src").agg(F.min("block").alias("block"), F.min_by(F.col("end") - F.col("words"), "block").alias("before"))
    )
    inside = Window.partitionBy("src").orderBy("_inner_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        placed.join(sized_broadcast(cut_block, len(rows)), ["src", "block"])
        .withColumn("end", F.col("before") + F.sum("words").over(inside))
        .where((F.col("end") - F.col("words") < F.col("rest")) & (F.col("end") >= F.col("rest")))
        .groupBy("src").agg(F.min_by(F.struct("block", "_inner_hash", (F.col("rest") - F.col("end") + F.col("words")).alias("part"), "size"), "end").alias("cut"))
    )
    at = {r["src"]: r["cut"] for r in cut.collect()}
    quotas, full = [], []
    for i, source, size, target, passes, rest, blocks in rows:
        c = at.get(i)
        part = 0 if c is None else c["part"]
        if c is not None and whole_documents:
            part = (2 * part + c["size"]) // (2 * c["size"]) * c["size"]
        full.append((i, source, size, target, passes, blocks, -1 if c is None else c["block"], "" if c is None else c["_inner_hash"], part))
        quotas.append(passes * blocks + (0 if c is None else c["block"] + 1))
    tree = split_tree(quotas, out_shards, seed)
    out = []
    for row, n, leaves in zip(full, quotas, tree, strict=True):
        step = next((a for a in range(n * 618 // 1000 | 1, n + 2) if math.gcd(a, max(n, 1)) == 1), 1)
        out.append((*row, max(n, 1), step, [int(x) for x in np.cumsum(leaves)]))
    return spark.createDataFrame(out, "src int, source string, source_size long, target double, passes int, blocks long, cut_block long, cut_hash string, cut_part long, quota long, step long, leaves array<long>")


def sized_broadcast(rows: DataFrame, sources: int) -> DataFrame:
    """A table of one row per source, broadcast where there are few."""
    return F.broadcast(rows) if sources <= BROADCAST_SOURCES else rows


def with_source(sized: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """Join the rows of the plan (one per source) by source, null included, and place each document in its block."""
    s = sources.withColumnRenamed("source", "_source")
    return sized.join(sized_broadcast(s, n), sized["source"].eqNullSafe(s["_source"]), "left").drop("_source").withColumn("block", F.pmod("_block_hash", "blocks"))


def draws(sized: DataFrame, sources: DataFrame, equal: list[str], seed: int = SEED) -> DataFrame:
    """``sized`` with ``copies``: what the leaves take of each document, as (pass, words, shard, order).

    ``equal`` are the columns by which rows are told apart.  Rows at a source's cut that are equal in them are counted
    together and written out again with a number each, so any number of them is dealt without ordering them.
    """
    placed = with_source(sized, sources, sources.count())
    at_cut = (F.col("block") == F.col("cut_block")) & (F.col("_inner_hash") == F.col("cut_hash"))
    before = (F.col("block") < F.col("cut_block")) | ((F.col("block") == F.col("cut_block")) & (F.col("_inner_hash") < F.col("cut_hash")))
    tied = placed.where(at_cut)
    rest = [c for c in placed.columns if c not in equal]
    counted = tied.groupBy(*equal).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in rest))
    # Rows that tie but differ in other columns: at most a few kinds, unless ids or texts are missing on a large scale.
    salt = F.pmod(F.xxhash64(*equal), F.lit(256))
    counted = counted.withColumn("_salt", salt)
    totals = counted.groupBy("src", "_salt").agg(F.sum("_n").alias("_rows"))
    starts = totals.withColumn("_start", F.sum("_rows").over(Window.partitionBy("src").orderBy("_salt")) - F.col("_rows")).drop("_rows")
    ahead = F.sum("_n").over(Window.partitionBy("src", "_salt").orderBy(F.xxhash64(*equal))) - F.col("_n")
    numbered = (
        counted.join(starts, ["src", "_salt"])
        .withColumn("_start", F.col("_start") + ahead)
        .withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .withColumn("_last", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("cut_part") - (F.col("_start") + F.col("_nth")) * F.col("size"))))
        .select(*placed.columns, "_last")
    )
    whole = placed.where(F.coalesce(~at_cut, F.lit(True))).withColumn("_last", F.when(before, F.col("size")).otherwise(F.lit(0).cast("long")))

    def copy(p):
        turn = p * F.col("blocks") + F.col("block")
        at = F.pmod(turn * F.col("step"), F.col("quota"))
        drawn = turn < F.element_at("leaves", -1)
        return F.struct(
            p.alias("pass"),
            F.when(~drawn, F.lit(0).cast("long")).when(p < F.col("passes"), F.col("size")).otherwise(F.col("_last")).alias("words"),
            F.size(F.filter("leaves", lambda end: end <= at)).alias("shard"),
            F.xxhash64(F.lit(seed + 2), F.col("_inner_hash"), p).alias("order"),
        )

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.col("passes")), copy), lambda c: c["words"] > 0)
    own = ("src", "passes", "blocks", "cut_block", "cut_hash", "cut_part", "quota", "step", "leaves", "block", "_block_hash", "_inner_hash", "_last")
    return whole.unionByName(numbered).withColumn("copies", copies).drop(*own)


def taken(docs: DataFrame) -> DataFrame:
    """Digest per document: its size, its source's size and target, the words that the mix takes of it, and from which shards.

    ``shards`` lists shard:words for each pass that takes the document; ``taken`` is their sum.
    """
    sized = stash(measured(docs.select("doc_id", "text", "source")).drop("text"), "mix-sizes")
    return draws(sized, plan(sized), sized.columns).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
        F.aggregate("copies", F.lit(0).cast("long"), lambda acc, c: acc + c["words"]).alias("taken"),
        F.array_join(F.transform("copies", lambda c: F.concat_ws(":", c["shard"].cast("string"), c["words"].cast("string"))), ",").alias("shards"),
        F.transform("copies", lambda c: c["order"]).alias("mix_orders"),
    )


def _tree_sql(shards: int) -> str:
    """CTEs t0 (the quotas) to t<depth>: per node [lo, hi) the counts of its sources, each level folded over the sources."""
    out, level = [], 0
    while shards >> level > 1:
        width = shards >> level
        out.append(f"""
f{level}(lo, i, counts, rest, take, lefts) AS (
 SELECT lo, 0::BIGINT, counts, list_sum(counts)::BIGINT, (list_sum(counts)::BIGINT * {width // 2}) // {width}, CAST([] AS BIGINT[]) FROM t{level}
 UNION ALL SELECT lo, i + 1, counts, rest - n, take - x, list_append(lefts, x) FROM (
  SELECT *, CAST(CASE WHEN take = 0 OR n = 0 THEN 0 WHEN n = rest THEN take ELSE greatest(0, take - rest + n) + least(least(n, take) - greatest(0, take - rest + n),
    (SELECT count(*) FROM (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(rest - n + 1) - lgamma(take - k + 1) - lgamma(rest - n - take + k + 1) - lgamma(rest + 1) + lgamma(take + 1) + lgamma(rest - take + 1))) OVER (ORDER BY k) AS f
      FROM (SELECT unnest(range(greatest(0, take - rest + n), least(n, take) + 1)) AS k)) WHERE f <= u)) END AS BIGINT) AS x FROM (
   SELECT *, counts[i + 1] AS n, CAST('0x' || md5('{SEED}:' || lo || ':' || (lo + {width}) || ':' || i)[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM f{level} WHERE i < len(counts)))),
t{level + 1} AS (SELECT lo + half * {width // 2} AS lo, list_transform(range(len(counts)), lambda j: CASE WHEN half = 0 THEN lefts[j + 1] ELSE counts[j + 1] - lefts[j + 1] END) AS counts
  FROM f{level}, (SELECT unnest([0, 1]) AS half) WHERE i = len(counts))""")
        level += 1
    return ",".join(out) + f", leaf AS (SELECT * FROM t{level})"


#: The digest in DuckDB: capped shares in closed form (who caps first has the least room per weight), each source's documents
#: in the order of its permutation, the tree's draws from the same distribution functions, and every copy's place in it.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS sz, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN {WEIGHTS[0]}::DOUBLE WHEN 1 THEN {WEIGHTS[1]}::DOUBLE ELSE {WEIGHTS[2]}::DOUBLE END AS w, {TOTAL_SHARE}::DOUBLE * sum(sz) OVER () AS t FROM s),
o AS (SELECT *, t - coalesce(sum({MAX_REPEATS}::DOUBLE * sz) OVER (ORDER BY sz / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, sum(w) OVER (ORDER BY sz / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ww FROM w),
c AS (SELECT *, room / ww * w > {MAX_REPEATS}::DOUBLE * sz AS capped FROM o),
g AS (SELECT *, CASE WHEN capped THEN {MAX_REPEATS}::DOUBLE * sz ELSE (SELECT room / ww FROM c WHERE NOT capped ORDER BY sz / w, i LIMIT 1) * w END AS target FROM c),
q AS (SELECT *, CASE WHEN sz > 0 THEN least({int(MAX_REPEATS)}, CAST(floor(target / sz) AS BIGINT)) ELSE 0 END AS passes, least({MAX_BLOCKS}, greatest(1, CAST(ceil(sz / {BLOCK_WORDS}.0) AS BIGINT))) AS blocks FROM g),
r AS (SELECT d.*, q.i, q.sz, q.target, q.passes, q.blocks, greatest(0, CAST(round_even(q.target, 0) AS BIGINT) - q.passes * q.sz) AS rest, CAST('0x' || h[1:10] AS BIGINT) % q.blocks AS block FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY i ORDER BY block, h[11:26], doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
qs AS (SELECT i, any_value(passes) * any_value(blocks) + coalesce(max(block) FILTER (size > 0 AND before < rest) + 1, 0) AS quota FROM b GROUP BY i),
t0 AS (SELECT 0 AS lo, list(quota ORDER BY i)::BIGINT[] AS counts FROM qs),{_tree_sql(OUT_SHARDS)},
step AS (SELECT i, quota, greatest(quota, 1) AS n, coalesce((SELECT min(a) FROM (SELECT unnest(range((quota * 618 // 1000) | 1, quota + 2)) AS a) WHERE gcd(a, greatest(quota, 1)) = 1), 1) AS step FROM qs),
ends AS (SELECT i, list(e ORDER BY lo) AS ends FROM (SELECT step.i, lo, sum(counts[step.i + 1]) OVER (PARTITION BY step.i ORDER BY lo) AS e FROM step, leaf) GROUP BY i),
copies AS (SELECT *, CASE WHEN p * blocks + block >= quota THEN 0 WHEN p < passes THEN size ELSE greatest(0, least(size, rest - before)) END AS words, (p * blocks + block) * step % n AS place
  FROM (SELECT *, unnest(range(passes + 1)) AS p FROM (SELECT row_number() OVER () AS id, * FROM b)) JOIN step USING (i)),
got AS (SELECT id, sum(words) AS taken, string_agg(len(list_filter(ends, lambda e: e <= place)) || ':' || CAST(words AS BIGINT), ',' ORDER BY p) FILTER (words > 0) AS shards, any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(sz) AS source_size, any_value(target) AS target
  FROM copies JOIN ends USING (i) GROUP BY id)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(taken AS BIGINT) AS taken, coalesce(shards, '') AS shards FROM got"""


def mix(docs: DataFrame, out_shards: int = OUT_SHARDS, whole_documents: bool = True) -> DataFrame:
    """The mix itself: every drawn copy of a document with its output shard, to be sorted by ``mix_order`` inside it.

    Where a document is cut (``whole_documents=False``), its text ends after the last word that is taken.  Columns of the
    documents that have the name of an added one (``mix_pass``, ``mix_words``, ``mix_shard``, ``mix_order``) are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("mix_pass", "mix_words", "mix_shard", "mix_order")]
    base = measured(docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source"))
    sizes = stash(base.select("doc_id", "source", "size", "_block_hash", "_inner_hash"), "mix-sizes")
    drawn = draws(base, plan(sizes, out_shards, whole_documents=whole_documents), base.columns).withColumn("_copy", F.explode("copies"))
    first_words = F.concat(F.lit(r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){0,"), F.col("_copy.words").cast("string"), F.lit("}+"))
    text = F.col("text") if whole_documents else F.when(F.col("_copy.words") >= F.col("size"), F.col("text")).otherwise(F.call_function("regexp_extract", F.col("text"), first_words, F.lit(0)))
    return drawn.select(*(text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in keep), F.col("_copy.pass").alias("mix_pass"), F.col("_copy.words").alias("mix_words"), F.col("_copy.shard").alias("mix_shard"), F.col("_copy.order").alias("mix_order"))


def in_order(mixed: DataFrame, lanes: int = 1) -> DataFrame:
    """The mix dealt by output shard and shuffled locally; a shard that is more than one task's work is cut into ``lanes``."""
    lane = F.pmod(F.col("mix_order"), F.lit(lanes))
    return mixed.repartition("mix_shard", lane).sortWithinPartitions("mix_shard", lane, "mix_order")


def write_mix(mixed: DataFrame, path: str, lanes: int = 1) -> None:
    """Write the mix, one folder per output shard, each file of it shuffled locally."""
    in_order(mixed, lanes).write.partitionBy("mix_shard").parquet(path)
