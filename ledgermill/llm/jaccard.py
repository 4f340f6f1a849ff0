"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

1. Every text becomes the set of its 5-word shingles (64-bit hashes) and a MinHash signature, cut into bands; the number
   of bands and rows is chosen for the target recall at the threshold.  Texts with equal sets are copies of one another
   and go on as one representative, so a large group of copies is one row from here.
2. Band hashes are shuffled; in each bucket with more than one representative every member is tied to the smallest one (a
   star, not all pairs).  Connected components of the stars are the candidate groups: two texts that share a bucket are
   in the same group.
3. Only representatives in a candidate group fetch their shingles again.  A group of up to ``BLOCK`` texts is verified
   whole, all its pairs.  A larger one is dealt into blocks by locality: each text belongs to the largest of its buckets, and that to as
   many blocks as it needs.  Two blocks meet only where some bucket has texts of both, so a long chain of groups costs what its
   links cost, not the square of its length.  Of two that meet the smaller one goes to the larger, so the many small blocks
   around a few large ones cost little.  Full sets are intersected there, and what leaves is a row for each text (its links,
   and a root of the links seen), never a pair.  Pairs that share a band are verified at every size; a small group's
   other pairs are too.
4. Links add up per text; components of the roots are the classes.

Result: one row per document with ``class_id`` (smallest id of its class), ``n_links`` (other documents whose set is at
least ``THRESHOLD`` alike, copies included), ``n_text_links`` (different texts among them) and ``n_copies``.

Defined cases: words are runs without ASCII white space, compared as they stand; a text of fewer than five words is one
shingle of all of them; texts without words (null, empty) have the empty set and are copies of one another; documents
with a null id are not compared and come back with class null and no links; repeated rows are copies; an empty table
gives an empty result; other columns are ignored.  Where different texts share an id, their classes may share a ``class_id``;
``keep_one`` tells them apart by id and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import stash
from ledgermill.llm.graph import SALTS, components, spread
from ledgermill.llm.hashing import mix64, seeds, shingles

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9998
MAX_HASHES = 192
#: Most texts of a block; a group is cut into about SPLIT blocks before its blocks get that large.
BLOCK, SPLIT = 1024, 24
#: A block holds about this many shingles at most (unless one text has more), which bounds a task's memory.
BLOCK_SHINGLES = 2_000_000
COLUMNS = 2048
#: The batch of a block's own pairs.
OWN = -1


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that reach ``recall`` at ``threshold``."""
    for rows in range(12, 1, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def signature(items: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """MinHash: the smallest product with each odd multiplier."""
    low = np.full(len(hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(items), 1024):
        np.minimum(low, (items[at : at + 1024, None] * hashes).min(axis=0), out=low)
    return low


def band_hashes(items: np.ndarray, bands: int, rows: int, hashes: np.ndarray, mixers: np.ndarray) -> np.ndarray:
    low = mix64(signature(items, hashes)) * mixers
    return mix64(low.reshape(bands, rows).sum(axis=1, dtype=np.uint64)).view(np.int64)


def set_ids(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set: equal sets have equal ones, and others practically never."""
    return tuple(int(mix64(items ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (0x51ED27, 0xA5A5B3))


def sketch(bands: int, rows: int, words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, mixers = seeds(bands * rows, 101) | np.uint64(1), seeds(bands * rows, 103) | np.uint64(1)
        for pdf in batches:
            h1, h2, sizes, marks = [], [], [], []
            for text in pdf["text"]:
                items = shingles(text or "", words)
                a, b = set_ids(items)
                h1.append(a)
                h2.append(b)
                sizes.append(len(items))
                marks.append(band_hashes(items, bands, rows, hashes, mixers) if len(items) else np.empty(0, np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "mark": pdf["mark"], "node": h1, "check": h2, "n": sizes, "bands": marks})

    return run


def fetch(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t or "", words) for t in pdf["text"]]
            got = pd.DataFrame({"node": pdf["node"], "items": [s.tobytes() for s in sets]})
            yield got[[set_ids(s)[0] == node for s, node in zip(sets, pdf["node"], strict=True)]]

    return run


def shared(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[cols], as a matrix; over the items that two sets share."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, item, times = np.unique(flat, return_inverse=True, return_counts=True)
    held = times[item] > 1
    item, owner = item[held], owner[held]
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    item = np.cumsum(np.concatenate(([0], item[1:] != item[:-1])))[: len(item)] if len(item) else item
    out = np.zeros((len(rows), len(cols)), dtype=np.float32)
    n = int(item[-1]) + 1 if len(item) else 0
    for lo in range(0, n, COLUMNS):
        a, b = np.searchsorted(item, (lo, lo + COLUMNS))
        x = np.zeros((len(sets), min(COLUMNS, n - lo)), dtype=np.float32)
        x[owner[a:b], item[a:b] - lo] = 1
        out += x[rows] @ x[cols].T
    return out


def linked(sets: list[np.ndarray], left: np.ndarray, across: bool, threshold: float) -> np.ndarray:
    """Boolean matrix of the links among sets; ``across`` counts those between ``left`` and the others only."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    if across and (left.all() or not left.any()):  # the other block is empty
        return np.zeros((m, m), dtype=bool)
    rows, cols = (np.flatnonzero(left), np.flatnonzero(~left)) if across else (np.arange(m), np.arange(m))
    if m <= 4:
        inter = np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in cols] for i in rows], dtype=np.float64)
    else:
        inter = shared(sets, rows, cols).astype(np.float64)
    part = inter >= threshold * (sizes[rows][:, None] + sizes[cols][None, :] - inter) - 1e-9
    out = np.zeros((m, m), dtype=bool)
    out[np.ix_(rows, cols)] = part
    if across:
        out[np.ix_(cols, rows)] = part.T
    np.fill_diagonal(out, False)
    return out


def roots(links: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def verify(threshold: float):
    """Rows ordered by (block, batch): each run of equal keys is a block's own pairs, or those with a batch of other blocks."""

    def links_of(nodes: list[int], copies: list[int], sides: list[int], sets: list[bytes], block: int, batch: int) -> pd.DataFrame:
        arrays = [np.frombuffer(s, dtype=np.uint64) for s in sets]
        found = linked(arrays, np.array(sides) == block, batch != OWN, threshold)
        some = np.flatnonzero(found.any(axis=1))
        ids = np.array(nodes)
        return pd.DataFrame({"node": ids[some], "n_text_links": found[some].sum(axis=1).astype(np.int64), "n_doc_links": (found[some] @ np.array(copies, dtype=np.int64)), "root": ids[roots(found)[some]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, ([], [], [], [])
        for pdf in batches:
            for block, batch, node, copies, side, items in zip(*(pdf[c] for c in ("block", "batch", "node", "copies", "side", "items")), strict=True):
                if (block, batch) != key:
                    if len(held[0]) > 1:
                        yield links_of(*held, *key)
                    key, held = (block, batch), ([], [], [], [])
                for x, to in zip((node, copies, side, items), held, strict=True):
                    to.append(x)
        if len(held[0]) > 1:
            yield links_of(*held, *key)

    return run


def dealt(tied: DataFrame, posted: DataFrame, block: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(node, side) of every candidate, and which sides meet in which task; a side is a block's number.

    A task is a (block, batch): the block's own texts and, but for batch OWN, those of other blocks that are held against it.
    """
    groups = tied.groupBy("grp").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
    # Groups of a block at most: cut by hash for the tasks' sake, all parts meet.
    small = groups.where(F.col("texts") <= block).select("grp", F.greatest(F.least(F.lit(SPLIT), F.ceil(F.col("texts") * SPLIT / (2 * block))), F.ceil(F.col("shingles") / block_shingles)).cast("int").alias("blocks"))
    numbered = lambda k: F.xxhash64(F.lit("group"), "grp", k)
    near = tied.join(small, "grp").select("node", numbered(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("side"))
    upto = F.col("blocks") - 1
    met = small.select("grp", "blocks", F.explode(F.sequence(F.lit(0), upto)).alias("i")).select("grp", "i", F.explode(F.sequence("i", upto)).alias("j")).select(numbered(F.col("i")).alias("x"), numbered(F.col("j")).alias("y"))
    # Larger ones: who is in which bucket, and in which of its own a text is at home.
    large = groups.where(F.col("texts") > block).select("grp", F.least(F.lit(block), F.ceil(F.col("texts") / SPLIT)).alias("size"))
    members = tied.join(large, "grp").select("node", "n", "size")
    inside = stash(posted.join(members.hint("merge"), "node").select("node", "n", "size", "bucket"), "large-groups")
    fullness = inside.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    anchor = inside.join(fullness, "bucket").groupBy("node", "n", "size").agg(F.max(F.struct("members", "bucket")).alias("home")).select("node", "n", "size", F.col("home.bucket").alias("home"))
    parts = anchor.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.first("size")), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("parts"))
    far = stash(anchor.join(parts, "home").select("node", F.xxhash64(F.lit("bucket"), "home", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("side")), "large-group-sides")
    joined = inside.select("node", "bucket").join(far, "node").select("bucket", "side").distinct().groupBy("bucket").agg(F.collect_list("side").alias("sides"))
    far_met = joined.select(F.explode("sides").alias("x"), "sides").select("x", F.explode(F.filter("sides", lambda y: y >= F.col("x"))).alias("y"))
    sides = stash(near.unionByName(far), "sides")
    # Of two blocks that meet, the smaller one goes to the larger; what goes to one block comes in batches of a block's size.
    sized = sides.groupBy("side").agg(F.count(F.lit(1)).alias("texts"))
    met = met.unionByName(far_met).distinct()
    for end in ("x", "y"):
        met = met.join(sized.select(F.col("side").alias(end), F.struct("texts", "side").alias(f"of_{end}")), end)
    uneven = met.where("x <> y").select(F.greatest("of_x", "of_y").alias("to"), F.least("of_x", "of_y").alias("from")).select(F.col("to.side").alias("block"), F.col("from.side").alias("side"), "from.texts")
    before = Window.partitionBy("block").orderBy("side").rowsBetween(Window.unboundedPreceding, -1)
    guests = stash(uneven.distinct().select("block", F.floor(F.coalesce(F.sum("texts").over(before), F.lit(0)) / block).cast("int").alias("batch"), "side"), "block-meetings")
    hosts = guests.select("block", "batch").distinct().unionByName(sized.select(F.col("side").alias("block"), F.lit(OWN).alias("batch"))).select("block", "batch", F.col("block").alias("side"))
    return sides, guests.unionByName(hosts)


def classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Every document with an id: doc_id, mark (hash of its text), its class (``root``) and class_id, and the counts of ``join``.

    ``first`` is the (doc_id, mark) that stands first in the class.
    """
    bands, rows = band_plan(threshold, recall)
    base = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    sketched = stash(base.mapInPandas(sketch(bands, rows, words), "doc_id long, mark long, node long, check long, n int, bands array<long>"), "sketches")
    reps = stash(
        sketched.groupBy("node", "check").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "representatives",
    )
    posted = reps.where("n > 0").select("node", F.explode("bands").alias("bucket"))
    buckets = posted.groupBy("bucket").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket", "low")
    stars = posted.join(buckets, "bucket").where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    groups = stash(components(stars, "candidates").select("node", F.col("root").alias("grp")), "groups")
    tied = stash(reps.select("node", "rep", "copies", "n").join(groups, "node"), "candidates")
    sides, tasks = dealt(tied, posted, block, block_shingles)
    texts = base.join(tied.select("node", "rep.*").hint("shuffle_hash"), ["doc_id", "mark"]).select("node", "text")
    items = texts.mapInPandas(fetch(words), "node long, items binary").dropDuplicates(["node"])
    sent = tied.select("node", "copies").join(sides, "node").join(items, "node").join(tasks.groupBy("side").agg(F.collect_list(F.struct("block", "batch")).alias("tasks")), "side")
    sent = sent.select("node", "copies", "side", "items", F.explode("tasks").alias("task")).select("task.*", "node", "copies", "side", "items")
    found = stash(
        sent.repartition("block", "batch").sortWithinPartitions("block", "batch", "node").mapInPandas(verify(threshold), "node long, n_text_links long, n_doc_links long, root long"),
        "links",
    )
    counts = found.groupBy("node").agg(F.sum("n_text_links").alias("n_text_links"), F.sum("n_doc_links").alias("n_doc_links"))
    roots_ = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "classes")
    each = (
        reps.select("node", "check", "rep", "copies")
        .join(counts, "node", "left")
        .join(roots_, "node", "left")
        .select("node", "check", "rep", "copies", F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), F.coalesce("n_doc_links", F.lit(0)).alias("n_doc_links"), F.coalesce("root", "node").alias("root"))
    )
    # Salted: a class may hold a third of all texts.
    names = spread(each.groupBy("root").agg(F.min("rep").alias("first")))
    named = each.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(names, ["root", "salt"])
    told = named.select("node", "check", "root", "first", F.col("first.doc_id").alias("class_id"), (F.col("n_doc_links") + F.col("copies") - 1).alias("n_links"), "n_text_links", F.col("copies").alias("n_copies"))
    return sketched.select("doc_id", "mark", "node", "check").join(told, ["node", "check"]).drop("node", "check")


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links, n_copies of every document; ``options`` are those of ``classes``."""
    zero = F.lit(0).cast("long")
    without = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), F.lit(None).cast("long"), zero, zero, zero + 1)
    return classes(docs, **options).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies").union(without)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without their near-duplicates: of each class the document with the smallest id, columns as they were.

    Rows with a null id stay; of rows that repeat the kept id and its text, one stays, and other texts of that id go by their
    own classes.
    """
    kept = stash(classes(docs, **options).where((F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("times")), "kept")
    own = [F.col(f"_row.{c}").alias(c) for c in docs.columns]
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    once = rows.join(kept.where("times = 1").select("doc_id", "mark").hint("shuffle_hash"), ["doc_id", "mark"], "left_semi")
    again = kept.where("times > 1").select("doc_id", "mark")
    if not again.isEmpty():
        once = once.unionByName(rows.join(again.hint("shuffle_hash"), ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"]))
    return once.select(*own).unionByName(docs.where(F.col("doc_id").isNull()))


#: The same by brute force in DuckDB: full sets, an inverted index, and the closure of the links.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END)) AS s FROM d),
keyed AS (SELECT doc_id, s, md5(array_to_string(s, chr(10))) AS k FROM sets),
reps AS (SELECT k, min(doc_id) AS rep, count(*) AS copies, first(s) AS s, len(first(s)) AS n FROM keyed GROUP BY k),
inv AS (SELECT rep, n, unnest(s) AS g FROM reps),
links AS (SELECT a.rep AS a, b.rep AS b FROM inv a JOIN inv b USING (g) WHERE a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*)) - 1e-9),
reach(node, other) AS (SELECT rep, rep FROM reps UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
class AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
num AS (SELECT l.a AS node, count(*) AS t, sum(r.copies) AS m FROM links l JOIN reps r ON r.rep = l.b GROUP BY l.a)
SELECT doc_id, class_id, CAST(coalesce(m, 0) + copies - 1 AS BIGINT) AS n_links, coalesce(t, 0) AS n_text_links, copies AS n_copies
FROM keyed JOIN reps USING (k) JOIN class ON class.node = rep LEFT JOIN num ON num.node = rep"""
