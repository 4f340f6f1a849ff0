"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes proposes boundaries; chunk sizes are normalised: below ``NORMAL`` bytes a boundary must
pass a stricter test than above it, and no chunk is shorter than ``MIN`` or longer than ``MAX``.  An insertion moves only
the chunks around it, so the set of chunk digests, weighted by chunk length, measures how much of a text another one
contains.

To compare each document with the next one by descending id, rows are dealt by id range; an id that fills whole ranges, and
the rows without one, are parted by the hash of the text.  The first document of each range is sent to the range before it as
well (one extra row a range), so every neighbour is met inside one partition and each text is shuffled once.  Range bounds
come from approximate quantiles; they decide only the balance.

Defined cases: a null text is empty, its fingerprint is the empty string, and two empty fingerprints are alike (1.0), an
empty and another are not (0.0); null ids come after all others; rows with equal ids are ordered by a hash of the text
(rows repeated in full stay in one range); a single document is its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.hashing import seeds, span_hashes

MIN, NORMAL, MAX = 24, 48, 192
#: Boundaries need 6 or 4 zero bits at the top of the hash.
STRICT, LOOSE = np.uint32(32 - 6), np.uint32(32 - 4)
GEAR = (seeds(256, 5) >> np.uint64(32)).astype(np.uint32)
#: A task's share of the text; beyond MAX_RANGES times that it grows, so that the bounds (one row a range on the driver) don't.
RANGE_BYTES, MAX_RANGES = 4 << 20, 100_000
#: A text's boundaries are found in windows of this many bytes, so memory does not follow the longest text.
WINDOW = 1 << 22


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: sum of GEAR[byte] << 2 * age in 32 bits, so a byte counts for 16 steps; by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(2 * k)
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of data, ascending; the last is its length."""
    n = len(data)
    if n <= MIN:
        return [n] if n else []
    strict: list[int] = []
    loose: list[int] = []
    for lo in range(0, n, WINDOW):
        from_ = max(0, lo - 15)
        h = gear(data[from_ : lo + WINDOW])[lo - from_ :]
        some = np.flatnonzero((h >> LOOSE) == 0)
        loose += (some + (lo + 1)).tolist()
        strict += (some[(h[some] >> STRICT) == 0] + (lo + 1)).tolist()
    out, s, i, j, ns, nl = [], 0, 0, 0, len(strict), len(loose)
    while n - s > MIN:
        i = bisect_left(strict, s + MIN, i)
        if i < ns and strict[i] < s + NORMAL:
            c = strict[i]
        else:
            j = bisect_left(loose, s + NORMAL, j)
            c = loose[j] if j < nl and loose[j] < s + MAX else s + MAX
        if c >= n:
            break
        out.append(c)
        s = c
    out.append(n)
    return out


def keys_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per chunk: 32 bits of its digest, then its length in 16."""
    return ((span_hashes(data, starts, ends) >> np.uint64(32)) << np.uint64(16)) | (ends - starts).astype(np.uint64)


class Print:
    """A text with its chunks: ``ends`` and ``keys`` in order, ``kinds`` the distinct keys, sorted."""

    def __init__(self, raw: bytes):
        self.data = np.frombuffer(raw, dtype=np.uint8)
        self.ends = np.asarray(boundaries(self.data), dtype=np.int64)
        self.keys = keys_of(self.data, np.concatenate(([0], self.ends[:-1])), self.ends) if len(self.ends) else np.empty(0, dtype=np.uint64)
        self.kinds = np.unique(self.keys)

    def after(self, same: int, tail: bytes) -> np.ndarray:
        """Distinct keys of the text whose first ``same`` bytes are this one's and then comes ``tail``."""
        kept = int(np.searchsorted(self.ends, same, side="right"))
        at = int(self.ends[kept - 1]) if kept else 0
        rest = Print(bytes(self.data[at:same]) + tail)
        return np.unique(np.concatenate((self.keys[:kept], rest.keys)))


def text_of(kinds: np.ndarray) -> str:
    """Twelve hex digits a chunk: digest and length."""
    return kinds.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def kinds_of(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8).reshape(-1, 6)
    return np.concatenate((np.zeros((len(raw), 2), np.uint8), raw), axis=1).reshape(-1).view(">u8").astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's weight (chunk lengths) that b holds too."""
    weight = lambda k: int((k & np.uint64(0xFFFF)).sum())
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return weight(a[b[at] == a]) / weight(a)


def fingerprint(text: str | None) -> str:
    return text_of(Print((text or "").encode("utf-8", "surrogatepass")).kinds)


def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by range and descending id, each range closed by a guest: every row with the one that follows."""
    last = None
    for pdf in batches:
        out = []
        for doc_id, text, rng, guest in zip(pdf["doc_id"], pdf["text"], pdf["rng"], pdf["guest"], strict=True):
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass")
            this = Print(raw)
            if last is not None and last[3] == rng:
                out.append((last[0], *edited(last[1], last[2], text, this)))
                last = None
            if not guest:
                last = (doc_id, text, this, rng)
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited(text: str, own: Print, next_text: str, next_print: Print) -> tuple:
    n = len(text)
    swap = n // 3
    head, tail = text[: n - swap].encode("utf-8", "surrogatepass"), next_text[:swap].encode("utf-8", "surrogatepass")
    other = own.after(len(head), tail)
    sha = hashlib.sha256(head)
    sha.update(tail)
    return n, sha.hexdigest(), text_of(own.kinds), text_of(other), containment(own.kinds, other), containment(own.kinds, next_print.kinds)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to both that and the next document's."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    sizes = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.sum(F.when(F.col("doc_id").isNull(), F.octet_length("text"))).alias("null_bytes")).first()
    ranges = max(1, min(MAX_RANGES, math.ceil((sizes["bytes"] or 0) / range_bytes)))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], min(10 * ranges, 1_000_000)).alias("b")).first()["b"] or [0]
    # An id that takes up whole ranges gets a range of its own, which is parted by the hash of the text.
    hot = {float(b): n + 1 for b, n in Counter(bounds).items() if n > 1 and abs(b) < 1 << 53}
    splits = [-math.inf, *sorted({*map(float, bounds), *(np.nextafter(b, math.inf) for b in hot)}), math.inf]
    pieces = {splits.index(b): n for b, n in hot.items()} | {-1: max(1, math.ceil((sizes["null_bytes"] or 0) / range_bytes))}
    parts = docs.sparkSession.createDataFrame(sorted(pieces.items()), "bucket int, pieces int")
    dealt = Bucketizer(splits=splits, inputCol="at", outputCol="bucket", handleInvalid="keep").transform(rows.withColumn("at", F.col("doc_id").cast("double")))
    dealt = dealt.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("bucket").cast("int"))).join(F.broadcast(parts), "bucket", "left")
    # Ranges by falling id, then by rising hash of the text; those without an id come last.
    piece = F.floor((F.col("mark") / float(1 << 64) + 0.5) * F.col("pieces")).cast("int")
    rng = F.struct((-F.col("bucket")).alias("turn"), F.least(F.coalesce(piece, F.lit(0)), F.coalesce("pieces", F.lit(1)) - 1).alias("piece"))
    dealt = dealt.select("doc_id", "text", "mark", rng.alias("rng"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("fall"), "mark"))
    heads = sorted(((tuple(r["rng"]), r["first"]) for r in dealt.groupBy("rng").agg(first.alias("first")).collect()), key=lambda x: x[0])
    to = [(None if f["no_id"] else ~f["fall"], f["mark"], *heads[k - 1][0]) for k, (_, f) in enumerate(heads)]
    guests = docs.sparkSession.createDataFrame(to, "head long, head_mark long, turn int, piece int")
    own = F.struct("rng", F.lit(False).alias("guest"))
    visit = F.struct(F.struct("turn", "piece").alias("rng"), F.lit(True).alias("guest"))
    sent = (
        dealt.join(F.broadcast(guests), dealt["doc_id"].eqNullSafe(guests["head"]) & (dealt["mark"] == guests["head_mark"]), "left")
        .select("doc_id", "text", "mark", F.explode(F.when(F.col("turn").isNull(), F.array(own)).otherwise(F.array(own, visit))).alias("x"))
        .select("doc_id", "text", "mark", F.xxhash64("x.rng").alias("rng"), "x.guest")
    )
    return (
        sent.repartition(max(2, ranges), "rng")
        .sortWithinPartitions("rng", "guest", F.col("doc_id").desc_nulls_last(), "mark")
        .select(F.col("doc_id").cast("string").alias("doc_id"), "text", "rng", "guest")  # pandas would turn ids with nulls among them into floats
        .mapInPandas(compare, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )
