"""Conversation prefix trie by preorder intervals.

Conversations are rebuilt (the first h turns of the hundred's first conversation, then their own), and each distinct sequence of
first turns is a node.  A node's key is a 128-bit sum over its turns of a hash of (depth, role, text), so keys are running
sums; they are worked out by a scan over the turns in order, whatever the length of a conversation.

A *segment* is a run of nodes with the same members: it begins at a node whose parent branches or ends, its head.  The turns
at the heads of a conversation's way order the conversations lexicographically; the members of a node are an interval of
their ranks.  Segments in the order of (first rank, depth) are the nodes in preorder, a subtree is what lies from a node to
the end of its last rank, and leaves and savings are differences of distributed prefix sums.

What bounds a task: turns, ranks, segments and nodes are sorted over range partitions whose keys are unique, so a long
conversation, or a node with many members, is spread; a conversation's way has at most sqrt(2 * turns) heads, as each of them
loses a member that has that many turns; nodes that many rows or children ask for are looked up by broadcast (see
``scans.lookup``).  Only the digest of a node's ends is made in one place, as SHA-256 is a chain: it reads their ids as joined
chunks, one after the other.

Defined cases: rows without conv_id take no part; a null role or text is empty; turns of one number go by the MD5 of the length of
the role, a colon, the role and the text (rows repeated in full stay turns of their own); conversations of no turns, which rebuilding may leave, are members of the
root and end there; an empty table has no node; other columns are ignored.  ``base`` of a negative id is that of the
remainder that has its sign.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import stash
from ledgermill.llm.hashing import BASE, MIX_B, mix64
from ledgermill.llm.scans import finish, in_order, lookup, running, summaries

HUNDRED, MOST_SHARED = 100, 6
#: Ids that are joined to one text before they are hashed.
CHUNK = 4096
STEP_A, STEP_B = np.uint64(BASE), MIX_B | np.uint64(1)
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["k1", "k2"]
TURNS = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, a long, b long, chars long, is_end boolean"


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its hundred's first."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def coded(df: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, two 60-bit hashes of (role, text), and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part(1).alias("a"), part(16).alias("b"), F.length(text).cast("long").alias("chars"))


def conversations(turns: DataFrame) -> DataFrame:
    """A row per conversation: the turns ``lent`` to it, how many of its own it drops, and its rebuilt length."""
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    heads = turns.where(F.col("conv_id") % HUNDRED == 0).withColumn("at", F.row_number().over(first)).where(F.col("at") < MOST_SHARED)
    lent = heads.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "a", "b", "chars"))).alias("lent"))
    drops = shared_turns(F.col("conv_id"))
    mine = F.slice("lent", F.lit(1), F.col("drops"))
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("drops", drops).withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED)
    met = own.join(lent.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("lent", F.coalesce(mine, F.expr("slice(array(named_struct('at', 0, 'a', 0L, 'b', 0L, 'chars', 0L)), 1, 0)")))
    return met.select("conv_id", "drops", "lent", (F.size("lent") + F.greatest(F.lit(0), F.col("n") - F.col("drops"))).cast("long").alias("length"))


def _hashes(depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    depth, a, b = (v.astype(np.int64).view(np.uint64) for v in (depth, a, b))
    return mix64(mix64(a + depth * STEP_A) + b), mix64(mix64(b + depth * STEP_B) + a)


class _Way:
    """The conversation that a scan is in: what it dropped and was lent, how many own turns were seen, the key so far."""

    def __init__(self, drops: int = 0, lent: int = 0, length: int = 0, seen: int = 0, k1: int = 0, k2: int = 0):
        self.drops, self.lent, self.length, self.seen, self.k1, self.k2 = drops, lent, length, seen, k1, k2


def _walk(batch: pd.DataFrame, way: _Way) -> tuple[pd.DataFrame, _Way]:
    """The nodes on the ways of a batch of rows in order (of each conversation its own row first, then its turns)."""
    is_head = batch["lent"].notna().to_numpy()
    rows, group = np.arange(len(batch)), np.cumsum(is_head)
    at = np.flatnonzero(is_head)
    lists = batch["lent"].to_numpy()[at]
    lent = np.array([way.lent, *map(len, lists)], dtype=np.int64)
    drops = np.array([way.drops, *batch["drops"].to_numpy()[at]], dtype=np.int64)
    length = np.array([way.length, *batch["length"].to_numpy()[at]], dtype=np.int64)
    starts = np.array([-1 - way.seen, *at], dtype=np.int64)
    conv, a, b, chars = (batch[c].to_numpy() for c in ("conv_id", "a", "b", "chars"))
    # turns lent
    flat = [t for turns in lists for t in turns]
    la, lb, lc = (np.array([t[c] for t in flat], dtype=np.int64) for c in ("a", "b", "chars"))
    of = np.repeat(np.arange(1, len(lent)), lent[1:])
    first = np.cumsum(lent[1:]) - lent[1:]
    ld = np.arange(len(flat)) - np.repeat(first, lent[1:]) + 1
    lh = _hashes(ld, la, lb)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)]) for h in lh]
    begin = [np.concatenate([[np.uint64(k)], s[first + lent[1:]] - s[first]]) for k, s in zip((way.k1, way.k2), sums)]
    lk = [s[1:] - np.repeat(s[first], lent[1:]) for s in sums]
    # own turns
    own = ~is_head & (rows - starts[group] - 1 >= drops[group])
    g = group[own]
    depth = rows[own] - starts[g] - 1 - drops[g] + lent[g] + 1
    oh = _hashes(depth, a[own], b[own])
    ends = [np.cumsum(h, dtype=np.uint64) for h in oh]
    before = [np.concatenate([[np.uint64(0)], e]) for e in ends]
    edge = np.searchsorted(g, np.arange(len(lent) + 1))
    ok = [e - f[edge[g]] + k[g] for e, f, k in zip(ends, before, begin)]
    depths = np.concatenate([ld, depth])
    keys = [np.concatenate([x, y]) for x, y in zip(lk, ok)]
    parents = [k - np.concatenate([x, y]) for k, x, y in zip(keys, lh, oh)]
    out = pd.DataFrame(
        {
            "conv_id": np.concatenate([conv[at][of - 1], conv[own]]),
            "depth": depths,
            **{c: v.view(np.int64) for c, v in zip(("k1", "k2", "p1", "p2"), [*keys, *parents])},
            "a": np.concatenate([la, a[own].astype(np.int64)]),
            "b": np.concatenate([lb, b[own].astype(np.int64)]),
            "chars": np.concatenate([lc, chars[own].astype(np.int64)]),
            "is_end": depths == np.concatenate([length[of], length[g]]),
        }
    )
    last = [(int(k[-1]) + int(f[-1]) - int(f[edge[len(lent) - 1]])) % (1 << 64) for k, f in zip(begin, before)]
    return out, _Way(int(drops[-1]), int(lent[-1]), int(length[-1]), len(batch) - 1 - int(starts[-1]), *last)


def ways(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes on every rebuilt conversation's way, but for the root."""
    none = {c: F.lit(None) for c in ("drops", "lent", "length")}
    types = dict(convs.dtypes)
    rows = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "a", "b", "chars", F.monotonically_increasing_id().alias("copy"), *[v.cast(types[c]).alias(c) for c, v in none.items()])
    zero = F.lit(0).cast("long")
    heads = convs.select("conv_id", F.lit(0).alias("kind"), zero.alias("turn"), zero.alias("a"), zero.alias("b"), zero.alias("chars"), zero.alias("copy"), "drops", "lent", "length")
    keys = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "a", "b", "copy"]
    stream = in_order(rows.unionByName(heads), keys, ["conv_id", "a", "b", "chars", "drops", "lent", "length"])

    def tail(batches, _):
        """Whether a conversation begins in the partition, rows, and the last one's state as far as it is known here."""
        way, begins, n = _Way(), False, 0
        for batch in batches:
            begins, n = begins or bool(batch["lent"].notna().any()), n + len(batch)
            way = _walk(batch, way)[1]
        return (begins, n, way) if n else None

    found, carries, way = summaries(stream, tail), {}, _Way()
    for part, (begins, n, last) in found:
        carries[part] = way
        way = last if begins else _Way(way.drops, way.lent, way.length, way.seen + n)
    if not all(begins for _, (begins, _, _) in found):  # keys inside conversations that fill partitions: their sums need the depths
        known = stream.sparkSession.sparkContext.broadcast(carries)

        def part_sum(batches, part):
            at = known.value[part]
            way, begins, n = _Way(at.drops, at.lent, at.length, at.seen), False, 0
            for batch in batches:
                begins, n = begins or bool(batch["lent"].notna().any()), n + len(batch)
                way = _walk(batch, way)[1]
            return (begins, way) if n else None

        k1 = k2 = 0
        for part, (begins, last) in summaries(stream, part_sum):
            carries[part].k1, carries[part].k2 = k1, k2
            k1, k2 = (last.k1, last.k2) if begins else ((k1 + last.k1) % (1 << 64), (k2 + last.k2) % (1 << 64))

    def emit(batches, way):
        for batch in batches:
            out, way = _walk(batch, way)
            yield out

    return stash(finish(stream, carries, emit, TURNS), "trie-ways")


def _nodes(on_ways: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node with members, children, ends, and whether it heads a segment."""
    same = [F.any_value(c).alias(c) for c in ("depth", "p1", "p2", "a", "b", "chars")]
    inner = on_ways.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("m"), F.sum(F.col("is_end").cast("long")).alias("ends"), *same)
    zero = [F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "depth", "a", "b", "chars")]
    no_parent = [F.lit(None).cast("long").alias(c) for c in ("p1", "p2")]
    root = convs.groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("m"), F.sum((F.col("length") == 0).cast("long")).alias("ends")).where(F.col("n") > 0)
    all_nodes = stash(inner.unionByName(root.select("n", "m", "ends", *zero, *no_parent)), "trie-nodes")
    below = all_nodes.where(F.col("depth") > 0).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("children"), F.min(F.struct("k1", "k2")).alias("child"))
    nodes = all_nodes.join(below, KEY, "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))
    goes_on = nodes.where((F.col("children") == 1) & (F.col("ends") == 0)).select("child.k1", "child.k2", F.lit(False).alias("is_head"))
    return stash(nodes.drop("child").join(goes_on, KEY, "left").withColumn("is_head", F.coalesce("is_head", F.lit(True))), "trie-heads")


def _ranks(passed: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, r``: the rank of each conversation's sequence among the distinct ones."""
    path = F.transform(F.sort_array(F.collect_list(F.struct("depth", "a", "b"))), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b")))
    paths = convs.select("conv_id").join(passed.groupBy("conv_id").agg(path.alias("path")), "conv_id", "left")
    hashed = paths.withColumns({"h1": F.xxhash64("path"), "h2": F.xxhash64(F.lit(1), "path")})
    ordered = in_order(hashed, [F.col("path").asc_nulls_first(), "conv_id"], ["conv_id", "h1", "h2"])

    def changes(batch: pd.DataFrame, last) -> np.ndarray:
        h1, h2 = (np.concatenate([[v if last is None else last[i]], v2]) for i, (v, v2) in enumerate((batch[c].iat[0], batch[c].to_numpy()) for c in ("h1", "h2")))
        new = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        return new.astype(np.int64)

    def edge(batch: pd.DataFrame) -> tuple[int, int]:
        return int(batch["h1"].iat[-1]), int(batch["h2"].iat[-1])

    def count(batches, _):
        first, last, n = None, None, 0
        for batch in batches:
            first = first or (int(batch["h1"].iat[0]), int(batch["h2"].iat[0]))
            n, last = n + int(changes(batch, last).sum()), edge(batch)
        return (first, last, n) if first else None

    def number(batches, carry):
        r, last = carry
        for batch in batches:
            at = r + np.cumsum(changes(batch, last))
            r, last = int(at[-1]), edge(batch)
            yield pd.DataFrame({"conv_id": batch["conv_id"], "r": at})

    carries, r, last = {}, 0, None
    for part, (first, end, n) in summaries(ordered, count):
        carries[part] = (r, last)
        r, last = r + n + (last is not None and first != last), end
    return finish(ordered, carries, number, "conv_id long, r long")


def _in_segments(nodes: DataFrame) -> DataFrame:
    """Nodes with ``head_depth``, the depth of their segment's head, and ``w_above``, the savings of its nodes above them."""
    names = ["k1", "k2", "depth", "m", "n", "children", "w", "is_head", "lo", "hi", "parent_m"]
    ordered = in_order(nodes, ["m", "depth"], names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", head_depth long, w_above long"

    def tail(batches, _):
        depth, total, n = None, 0, 0
        for b in batches:
            n, at = n + len(b), np.flatnonzero(b["is_head"].to_numpy())
            if len(at):
                depth, total = int(b["depth"].iat[at[-1]]), 0
            total += int(b["w"].iloc[at[-1] if len(at) else 0 :].sum())
        return (depth, total) if n else None

    def fill(batches, carry):
        depth, total = carry
        for b in batches:
            head, w = b["is_head"].to_numpy(), b["w"].to_numpy()
            at, group = np.flatnonzero(head), np.cumsum(head)
            sums = np.concatenate([[0], np.cumsum(w)])
            starts = np.array([-total, *sums[at]])
            out = b.assign(head_depth=np.array([depth, *b["depth"].to_numpy()[at]])[group], w_above=sums[:-1] - starts[group])
            depth, total = int(out["head_depth"].iat[-1]), int(sums[-1] - starts[-1])
            yield out

    carries, depth, total = {}, 0, 0
    for part, (last, part_total) in summaries(ordered, tail):
        carries[part] = (depth, total)
        depth, total = (depth, total + part_total) if last is None else (last, part_total)
    return stash(finish(ordered, carries, fill, schema), "trie-in-segments")


def _ends(on_ways: DataFrame, convs: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256``: the digest of the conversations that end at a node."""
    ends = on_ways.where("is_end").select(*KEY, "conv_id")
    at_root = convs.where(F.col("length") == 0).select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    ordered = in_order(ends.unionByName(at_root), [*KEY, "conv_id"], [*KEY, "conv_id"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                k1, k2, ids = (b[c].to_numpy() for c in (*KEY, "conv_id"))
                cut = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
                cut = np.unique(np.concatenate([cut, np.arange(0, len(b), CHUNK), [len(b)]]))
                texts = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(cut[:-1], cut[1:])]
                yield pd.DataFrame({"k1": k1[cut[:-1]], "k2": k2[cut[:-1]], "conv_id": ids[cut[:-1]], "ids": texts})

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h = None, None
        for b in batches:
            out = []
            for k1, k2, ids in zip(b["k1"], b["k2"], b["ids"]):
                if (k1, k2) != key:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, h.hexdigest())], columns=[*KEY, "ends_sha256"])

    joined = ordered.mapInPandas(join, "k1 long, k2 long, conv_id long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInPandas(digest, "k1 long, k2 long, ends_sha256 string")


def build(df: DataFrame) -> DataFrame:
    """The nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end``."""
    turns = coded(df)
    convs = stash(conversations(turns), "trie-conversations")
    on_ways = ways(turns, convs)
    nodes = _nodes(on_ways, convs)
    n_ways, n_nodes = on_ways.count(), nodes.count()

    heads = nodes.where("is_head")
    passed = stash(lookup(on_ways.select("conv_id", "depth", "a", "b", *KEY), heads.where("depth > 0").select(*KEY, "n"), KEY, "n", n_ways), "trie-passed")
    ranks = stash(_ranks(passed, convs), "trie-ranks")
    spans = passed.select("conv_id", *KEY).join(ranks, "conv_id").groupBy(*KEY).agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    zero = F.lit(0).cast("long")
    whole = ranks.groupBy().agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where(F.col("lo").isNotNull()).select(zero.alias("k1"), zero.alias("k2"), "lo", "hi")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("m").alias("parent_m"), "children")
    of_heads = lookup(heads.where("depth > 0").select(*KEY, "p1", "p2"), parents, ["p1", "p2"], "children", n_nodes).select(*KEY, "parent_m")
    placed = nodes.withColumn("w", (F.col("n") - 1) * F.col("chars")).join(spans.unionByName(whole), KEY, "left").join(of_heads, KEY, "left")
    inside = _in_segments(placed)

    segments = inside.groupBy("m", "head_depth").agg(F.sum("w").alias("w"), F.sum((F.col("children") == 0).cast("long")).alias("leaves"), F.count(F.lit(1)).alias("nodes"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    ordered = in_order(segments, ["lo", "head_depth"], ["m", "head_depth", "lo", "hi", "w", "leaves", "nodes"])
    summed = stash(running(ordered, ["w", "leaves", "nodes"]), "trie-segments")
    through = summed.groupBy(F.col("lo").alias("hi")).agg(*[F.max(F.col(f"{c}_before") + F.col(c)).alias(f"{c}_end") for c in ("w", "leaves", "nodes")])
    of_segment = summed.join(through, "hi").select("m", "head_depth", (F.col("leaves_end") - F.col("leaves_before")).alias("n_leaves"), (F.col("w_end") - F.col("w_before")).alias("saved"), F.col("nodes_before").alias("start"), (F.col("nodes_end") - 1).alias("subtree_end"), "nodes")
    full = lookup(inside, stash(of_segment, "trie-subtrees"), ["m", "head_depth"], "nodes", n_nodes).join(_ends(on_ways, convs), KEY, "left")
    return full.select(
        F.col("m").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.when(F.col("is_head"), F.col("parent_m")).otherwise(F.col("m"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        "n_leaves",
        (F.col("saved") - F.col("w_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        (F.col("start") + F.col("depth") - F.col("head_depth")).alias("preorder"),
        "subtree_end",
    )


#: The same in DuckDB: every prefix as a list; ancestors through the ways of the smallest members.
ORACLE = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(md5(concat(length(coalesce(role, '')), ':', role, text)), 1, 30)) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {HUNDRED} AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) % {MOST_SHARED} AS h
  FROM (SELECT DISTINCT conv_id FROM o), crc),
r AS (SELECT c.conv_id, p + 1 AS d, role, text FROM c JOIN o ON o.conv_id = c.base AND p < h
  UNION ALL SELECT c.conv_id, p - h + 1 + least(h, coalesce(nb, 0)) AS d, role, text FROM c JOIN o USING (conv_id) LEFT JOIN (SELECT conv_id AS base, count(*) AS nb FROM o GROUP BY 1) USING (base) WHERE p >= h),
l AS (SELECT conv_id, coalesce(max(d), 0) AS len FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
w AS (SELECT conv_id, d, text, list(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r UNION ALL SELECT conv_id, 0, '', [] FROM c),
n AS (SELECT path, min(d) AS d, min(conv_id) AS m, count(*) AS n, any_value(length(text)) AS chars, coalesce(string_agg(CASE WHEN len = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM w JOIN l USING (conv_id) GROUP BY path),
k AS (SELECT a.*, (SELECT m FROM n b WHERE a.d > 0 AND b.path = a.path[1:a.d - 1]) AS pm FROM n a),
ch AS (SELECT pm, d - 1 AS d, count(*) AS children FROM k WHERE d > 0 GROUP BY ALL),
f AS (SELECT k.*, coalesce(children, 0) AS children FROM k LEFT JOIN ch ON ch.pm = k.m AND ch.d = k.d),
up AS (SELECT f.m, f.d, f.n, f.chars, f.children, w.path FROM f JOIN w ON w.conv_id = f.m AND w.d <= f.d),
s AS (SELECT path, sum((n - 1) * chars) AS saved, count(*) FILTER (children = 0) AS leaves FROM up GROUP BY path)
SELECT m AS conv_id, CAST(d AS BIGINT) AS depth, pm AS parent_conv_id, n AS n_convs, children AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM f JOIN s USING (path)"""
