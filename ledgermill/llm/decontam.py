"""Benchmark decontamination by template windows.

Texts are canonicalised: numbers, names (capitalised words that don't begin a sentence) and units after a number become
typed placeholders, everything else is lower-cased; punctuation is dropped.  Every window of ``WINDOW`` canonical tokens of
a benchmark item is hashed; windows of the documents are hash-joined with them.  A window with fewer than ``LITERALS``
literal tokens says too little as a template and is hashed by its values instead, so it still meets its verbatim copy.  The
windows that meet are lined up by their distance (position in the document less position in the item); a line-up takes in
the equal canonical tokens on either side of its windows.  In each line-up the placeholders' values must be consistent: the
same value in the item is always the same value in the document.  That accepts the verbatim passage and the re-parameterised
one (two values may become one), and refuses texts that merely share a frame.  Where a value of the item stands for two in
the document, the windows that touch a changed one of its places go; of what is left of such a line-up, runs of at least
``LONG`` tokens count.  A document is contaminated by an item if consistent windows cover at least ``COVERAGE`` of the item's
tokens, or a run of ``LONG`` of them (however long the item is).  An item of fewer tokens than ``WINDOW`` is one window; one
of fewer than ``LEAST`` must stand as sentences of its own, word for word.

The hash join runs on the map side where the benchmark is at most ``PART_BYTES`` of text: its index is broadcast, documents
are never shuffled.  A larger one is joined by a shuffle: the documents' windows that pass a bit table of the benchmark's
hashes (of fixed size) meet the benchmark's windows, salted, and each pair of texts that meets is checked by the same code.
Copies of a text are one text there.

Defined cases: null and empty texts are never contaminated; null ids are carried through; items without a token find
nothing; repeated items are told apart by id only; an empty benchmark finds nothing; other columns are ignored (``clean``
keeps them).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import stash
from ledgermill.llm.hashing import PIECE, mix64, pieces, run_hashes, span_hashes

WINDOW = 8
LEAST = 5
LITERALS = 3
COVERAGE = 0.5
LONG = 13
PART_BYTES = 8 << 20
#: Where the benchmark is larger: bits of the table of its window hashes, and how often its windows are dealt against hot ones.
TABLE_BITS, SALTS = 27, 16
#: Words that count as a unit after a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "k c f w kw v a hz khz mhz ghz kb mb gb tb percent degrees dollars dollar euros euro cents cent pence usd eur gbp rub"
).split()
_BITS = 20

WORDY = np.zeros(256, dtype=bool)
WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
STOPS = np.zeros(256, dtype=bool)
STOPS[[ord(c) for c in ".!?:;\n\"("]] = True
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NUM, NAME, UNIT = (np.uint64(k) for k in (1, 2, 3))
#: Told apart from templates: hashes of values, and of whole sentences.
VERBATIM, SENTENCE = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


UNIT_HASHES = np.sort(np.array([_hash_of(u) for u in UNITS], dtype=np.uint64))


def _words(data: np.ndarray, at: int, opening: bool) -> tuple[np.ndarray, ...]:
    """The tokens of a piece that begins at byte ``at``: start, end, value, is it a number, has it a capital, does it begin a sentence, is it behind a comma or point."""
    wordy = np.zeros(len(data) + 2, dtype=np.int8)
    wordy[1:-1] = WORDY[data]
    edge = np.flatnonzero(np.diff(wordy))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), *(none.astype(bool) for _ in range(4))
    low = LOWER[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    upper = (data >= 65) & (data <= 90)
    upper[latin - 1] = True
    low[latin] += 0x20
    value = span_hashes(low, starts, ends)
    number = DIGIT[data[starts]]
    second = starts + np.where(data[starts] == 0xC3, 2, 1)
    titled = upper[starts] & (second < ends) & ~upper[np.minimum(second, len(data) - 1)] & ~number
    # A capital begins a sentence if, blanks aside, a stop or the text's start comes before it.
    solid = np.where(BLANK[data], -1, np.arange(len(data)))
    before = np.maximum.accumulate(solid)
    prev = np.where(starts > 0, before[np.maximum(starts - 1, 0)], -1)
    opens = np.where(prev >= 0, STOPS[data[np.maximum(prev, 0)]], opening)
    comma = (starts > 0) & np.isin(data[np.maximum(starts - 1, 0)], (44, 46))
    return starts + at, ends + at, value, number, titled, opens, comma


def canonical(text: str | None, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's tokens: the canonical ones (1 to 3 are placeholders, anything else is a literal's hash), the values, and which begin a sentence.

    Bytes are read in pieces; what a token is depends on its neighbours, so that is decided over the pieces' seams.
    """
    parts, at, opening = [], 0, True
    for raw in pieces((text or "").encode("utf-8", "surrogatepass"), size):
        data = np.frombuffer(raw, dtype=np.uint8)
        parts.append(_words(data, at, opening))
        at += len(data)
        solid = np.flatnonzero(~BLANK[data])
        if len(solid):
            opening = bool(STOPS[data[solid[-1]]])
    starts, ends, value, number, titled, opens, comma = (np.concatenate(x) for x in zip(*parts, strict=True))
    name = titled & ~opens
    unit = np.zeros(len(starts), dtype=bool)
    if number.any():
        # 1,234.5 is one number: its later parts are dropped, their digits are kept in its value.
        near = np.zeros(len(starts), dtype=bool)
        near[1:] = (starts[1:] == ends[:-1] + 1) & number[1:] & number[:-1] & comma[1:]
        if near.any():
            lead = np.flatnonzero(~near)
            value = np.add.reduceat(value * np.where(near, np.uint64(3), np.uint64(1)), lead)
            number, name, opens, unit = number[lead], name[lead], opens[lead], unit[lead]
        found = np.minimum(np.searchsorted(UNIT_HASHES, value), len(UNIT_HASHES) - 1)
        unit[1:] = (UNIT_HASHES[found] == value)[1:] & number[:-1]
    kind = np.where(number, NUM, np.where(name, NAME, np.where(unit, UNIT, np.uint64(0))))
    return np.where(kind > 0, kind, value | np.uint64(8)), value, opens


class Index:
    """The windows of some benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = []
        hashes, owners, places = [], [], []
        for item_id, text in items:
            tokens, values, opens = canonical(text)
            if not len(tokens):
                continue
            n = min(WINDOW, len(tokens))
            at, got = windows(tokens, values, opens, n)
            if n < LEAST:
                at, got = np.zeros(1, dtype=np.int64), anchored(tokens, values, np.ones(1, dtype=bool), n)[1]
            hashes.append(got)
            owners.append(np.full(len(at), len(self.items), dtype=np.int64))
            places.append(at)
            self.items.append((item_id, tokens, values, n))
        flat = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owners = np.concatenate(owners)[order] if hashes else np.empty(0, dtype=np.int64)
        self.places = np.concatenate(places)[order] if hashes else np.empty(0, dtype=np.int64)
        self.sizes = sorted({n for *_, n in self.items})
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, text: str | None) -> list[tuple]:
        """(item id, item tokens, covered tokens, changed slots) of every item that contaminates the text."""
        if not text or not len(self.hashes):
            return []
        tokens, values, opens = canonical(text)
        met = defaultdict(lambda: defaultdict(list))
        for n in self.sizes:
            if len(tokens) < n:
                continue
            at, hashed = windows(tokens, values, opens, n)
            some = np.flatnonzero(self.bits[(hashed >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(some):
                continue
            lo, hi = np.searchsorted(self.hashes, hashed[some], "left"), np.searchsorted(self.hashes, hashed[some], "right")
            for k in np.flatnonzero(hi > lo):
                q = int(at[some[k]])
                for x in range(lo[k], hi[k]):
                    met[int(self.owners[x])][q - int(self.places[x])].append(int(self.places[x]))
        out = []
        for owner, lines in met.items():
            item_id, item_tokens, item_values, n = self.items[owner]
            covered = np.zeros(len(item_tokens), dtype=bool)
            changed = longest = 0
            for shift, places in lines.items():
                own, moved = consistent(item_tokens, item_values, values, around(item_tokens, tokens, places, n, shift), n, shift)
                covered |= own
                longest = max(longest, *(b - a for a, b in zip(*runs(own), strict=True)), 0)
                changed = max(changed, moved)
            if covered.sum() >= COVERAGE * len(item_tokens) or longest >= LONG:
                out.append((item_id, len(item_tokens), int(covered.sum()), changed))
        return out


def windows(tokens: np.ndarray, values: np.ndarray, opens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of n tokens: of the template, or of the values where literals are few."""
    if n < LEAST:
        return anchored(tokens, values, opens, n)
    literal = np.concatenate(([0], np.cumsum(tokens > 3)))
    few = literal[n:] - literal[:-n] < min(LITERALS, n)
    hashed = run_hashes(mix64(tokens), n)
    if few.any():
        hashed[few] = run_hashes(mix64(values ^ VERBATIM), n)[few]
    return np.arange(len(hashed)), hashed


def anchored(tokens: np.ndarray, values: np.ndarray, opens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of n values that begin and end with a sentence."""
    closed = np.append(opens[n:], True)
    at = np.flatnonzero(opens[: len(tokens) - n + 1] & closed[: len(tokens) - n + 1])
    return at, run_hashes(mix64(values ^ SENTENCE), n)[at]


def around(item_tokens: np.ndarray, tokens: np.ndarray, places: list[int], n: int, shift: int) -> list[int]:
    """The windows of a line-up with those next to them whose canonical tokens are equal too."""
    if n < WINDOW:
        return places
    lo, hi = max(0, -shift), min(len(item_tokens), len(tokens) - shift)
    same = np.zeros(len(item_tokens), dtype=bool)
    same[lo:hi] = item_tokens[lo:hi] == tokens[lo + shift : hi + shift]
    own = np.zeros(len(item_tokens) + 1, dtype=np.int64)
    own[places] = 1
    upto = np.concatenate(([0], np.cumsum(own)))
    more = [p for a, b in zip(*runs(same), strict=True) if b - a >= n and upto[b - n + 1] > upto[a] for p in range(int(a), int(b) - n + 1)]
    return sorted({*places, *more})


def runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def consistent(item_tokens: np.ndarray, item_values: np.ndarray, values: np.ndarray, places: list[int], n: int, shift: int) -> tuple[np.ndarray, int]:
    """The item's tokens that the consistent windows of a line-up cover, and how many placeholders have another value there."""

    def cover(some: list[int]) -> np.ndarray:
        own = np.zeros(len(item_tokens), dtype=bool)
        for p in some:
            own[p : p + n] = True
        return own

    own = cover(places)
    slots = np.flatnonzero(own & (item_tokens <= 3))
    moved = item_values[slots] != values[slots + shift]
    there = defaultdict(set)
    for p in slots:
        there[int(item_tokens[p]), int(item_values[p])].add(int(values[p + shift]))
    torn = [int(p) for p in slots[moved] if len(there[int(item_tokens[p]), int(item_values[p])]) > 1]
    if torn:
        own = cover([p for p in places if not any(p <= t < p + n for t in torn)])
        for a, b in zip(*runs(own), strict=True):
            own[a:b] = b - a >= LONG
    return own, int((own[slots] & moved).sum())


HITS = "item_id long, item_tokens int, covered_tokens int, changed_slots int"


def _items(benchmark: DataFrame) -> tuple[DataFrame, bool]:
    """The benchmark's texts, and whether they are few enough to be broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    return items, (items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0) <= PART_BYTES


def _index(items: DataFrame):
    """The broadcast index of a benchmark of at most PART_BYTES of text."""
    rows = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return items.sparkSession.sparkContext.broadcast(Index(rows))


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, size, hash) of the windows of items, each once an item."""
    for pdf in batches:
        for text in pdf["text"]:
            index = Index([(0, text)])
            yield pd.DataFrame({"hash": np.unique(index.hashes).view(np.int64), "size": index.sizes[0] if index.sizes else 0, "item": text})


def _met(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(digest, HITS) of the texts that a large benchmark contaminates: a shuffle join of window hashes, then a check pair by pair."""
    spark = docs.sparkSession
    wanted = stash(items.select("text").distinct().mapInPandas(_item_windows, "hash long, size int, item string").withColumn("item_key", F.md5(F.col("item").cast("binary"))).drop("item"), "benchmark-windows")
    # The table of hashes is put together from 32-bit words, on executors; its size does not depend on the benchmark's.
    at = F.shiftrightunsigned("hash", 64 - TABLE_BITS)
    words = wanted.groupBy(F.shiftright(at, 5).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod(at, F.lit(32)).cast("int"))).alias("bits")).toPandas()
    table = np.zeros(1 << (TABLE_BITS - 5), dtype=np.uint32)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int32).view(np.uint32)
    sizes = [r["size"] for r in wanted.select("size").distinct().collect()]
    shared = spark.sparkContext.broadcast((table, sorted(sizes)))

    def windows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, sizes = shared.value
        for pdf in batches:
            for digest, text in zip(pdf["digest"], pdf["text"], strict=True):
                tokens, values, opens = canonical(text)
                got = [windows(tokens, values, opens, n)[1] for n in sizes if 0 < n <= len(tokens)]
                hashed = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *got]))
                at = (hashed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                some = hashed[(table[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1]
                if len(some):
                    yield pd.DataFrame({"digest": digest, "hash": some.view(np.int64)})

    texts = docs.select(F.md5(F.col("text").cast("binary")).alias("digest"), "text").where(F.col("text").isNotNull())
    found = texts.mapInPandas(windows_of, "digest string, hash long").distinct().withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    dealt = wanted.select("hash", "item_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = stash(found.join(dealt, ["hash", "salt"]).select("digest", "item_key").distinct(), "benchmark-pairs")
    left = texts.join(pairs.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    right = items.select("text").distinct().select(F.md5(F.col("text").cast("binary")).alias("item_key"), F.col("text").alias("item"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, k, *hit[1:]) for d, k, text, item in zip(*(pdf[c] for c in ("digest", "item_key", "text", "item")), strict=True) for hit in Index([(0, item)]).hits(text)]
            yield pd.DataFrame(rows, columns=["digest", "item_key", "item_tokens", "covered_tokens", "changed_slots"])

    got = pairs.join(left, "digest").join(right, "item_key").mapInPandas(check, "digest string, item_key string, item_tokens int, covered_tokens int, changed_slots int")
    return stash(got.join(items.select("item_id", F.md5(F.col("text").cast("binary")).alias("item_key")), "item_key").select("digest", *(c.split()[0] for c in HITS.split(", "))), "benchmark-hits")


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, item_tokens, covered_tokens, changed_slots."""
    items, small = _items(benchmark)
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if small:
        shared = _index(items)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(d, *hit) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for hit in shared.value.hits(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_tokens", "covered_tokens", "changed_slots"]).astype({"item_id": "Int64"})

        out = base.mapInPandas(run, f"doc_id string, {HITS}")
    else:
        out = base.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")).join(_met(base, items), "digest").drop("digest")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, columns as they were."""
    items, small = _items(benchmark)
    if not small:
        taken = {c.lower() for c in docs.columns}
        hit = next(c for c in ("_hit", *(f"_hit{k}" for k in range(len(taken)))) if c not in taken)
        met = _met(docs.select(F.col("text").cast("string").alias("text")), items).select(F.col("digest").alias(hit)).distinct()
        return docs.join(met, F.md5(F.col("text").cast("string").cast("binary")) == F.col(hit), "left_anti")
    shared = _index(items)

    @F.pandas_udf("boolean")
    def contaminated(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(shared.value.hits(t)) for t in texts], dtype="bool")

    return docs.where(~contaminated(F.col("text").cast("string")))


_UNITS_SQL = ", ".join(f"'{u}'" for u in UNITS)


def _canonical_sql(name: str, source: str, id_col: str) -> str:
    """CTEs that give (id, pos, kind, lit, val) of a table's texts; kind is null for literals."""
    word = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
    return rf"""
{name}_m AS (SELECT {id_col} AS id, regexp_extract_all(text, '([^A-Za-z0-9\x{{80}}-\x{{10FFFF}}]*)({word}+)', 1) AS seps, regexp_extract_all(text, '([^A-Za-z0-9\x{{80}}-\x{{10FFFF}}]*)({word}+)', 2) AS words FROM {source} WHERE text IS NOT NULL),
{name}_t AS (SELECT id, i, seps[i] AS sep, words[i] AS w, rtrim(seps[i], ' ' || chr(9) || chr(13)) AS gap FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM {name}_m)),
{name}_f AS (SELECT id, i, w, w[1] BETWEEN '0' AND '9' AS number, sep, regexp_matches(w, '^[A-ZÀ-ÖØ-Þ][^A-ZÀ-ÖØ-Þ]') AND NOT w[1] BETWEEN '0' AND '9' AS titled,
  CASE WHEN gap = '' THEN i = 1 ELSE right(gap, 1) IN ('.', '!', '?', ':', ';', chr(10), '"', '(') END AS opens FROM {name}_t),
{name}_n AS (SELECT *, coalesce(number AND lag(number) OVER w AND sep IN (',', '.'), false) AS near FROM {name}_f WINDOW w AS (PARTITION BY id ORDER BY i)),
{name}_g AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS pos FROM {name}_n),
{name}_a AS (SELECT id, CAST(pos - 1 AS BIGINT) AS pos, bool_or(number) AS number, bool_or(titled AND NOT opens) AS named, string_agg(lower(w), '|' ORDER BY i) AS val FROM {name}_g GROUP BY id, pos),
{name} AS (SELECT id, pos, val, CASE WHEN number THEN 1 WHEN named THEN 2 WHEN val IN ({_UNITS_SQL}) AND coalesce(lag(number) OVER (PARTITION BY id ORDER BY pos), false) THEN 3 END AS kind FROM {name}_a),
{name}_w AS (SELECT id, pos, CASE WHEN count(*) FILTER (kind IS NULL) OVER v >= {LITERALS} THEN string_agg(coalesce('<' || kind || '>', val), ' ') OVER v ELSE '= ' || string_agg(val, ' ') OVER v END AS win
  FROM {name} WINDOW v AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) QUALIFY count(*) OVER v = {WINDOW})"""


#: The same in DuckDB for items of a window or more.
ORACLE = rf"""
WITH {_canonical_sql('d', 'documents', 'doc_id')}, {_canonical_sql('b', 'benchmark', 'item_id')},
sizes AS (SELECT id, count(*) AS n FROM b GROUP BY id),
met AS (SELECT d_w.id AS doc_id, b_w.id AS item_id, d_w.pos - b_w.pos AS shift, b_w.pos AS p FROM d_w JOIN b_w USING (win)),
line AS (SELECT DISTINCT doc_id, item_id, shift FROM met),
same AS (SELECT l.doc_id, l.item_id, l.shift, b.pos AS p, b.pos - row_number() OVER (PARTITION BY l.doc_id, l.item_id, l.shift ORDER BY b.pos) AS g FROM line l JOIN b ON b.id = l.item_id JOIN d ON d.id = l.doc_id AND d.pos = b.pos + l.shift
  WHERE coalesce('<' || b.kind || '>', b.val) = coalesce('<' || d.kind || '>', d.val) AND (b.kind IS NULL) = (d.kind IS NULL)),
run AS (SELECT doc_id, item_id, shift, min(p) AS a, max(p) + 1 AS e FROM same GROUP BY doc_id, item_id, shift, g HAVING count(*) >= {WINDOW}),
place AS (SELECT doc_id, item_id, shift, unnest(range(a, e - {WINDOW - 1})) AS p FROM run r WHERE EXISTS (SELECT 1 FROM met m WHERE m.doc_id = r.doc_id AND m.item_id = r.item_id AND m.shift = r.shift AND m.p >= r.a AND m.p + {WINDOW} <= r.e) UNION SELECT * FROM met),
first_own AS (SELECT DISTINCT doc_id, item_id, shift, p + k AS p FROM (SELECT *, unnest(range(0, {WINDOW})) AS k FROM place)),
slots AS (SELECT o.doc_id, o.item_id, o.shift, o.p, b.kind, b.val AS a, d.val AS v FROM first_own o JOIN b ON b.id = o.item_id AND b.pos = o.p JOIN d ON d.id = o.doc_id AND d.pos = o.p + o.shift WHERE b.kind IS NOT NULL),
clash AS (SELECT doc_id, item_id, shift, kind, a FROM slots GROUP BY ALL HAVING count(DISTINCT v) > 1),
torn AS (SELECT doc_id, item_id, shift, p AS t FROM slots JOIN clash USING (doc_id, item_id, shift, kind, a) WHERE a <> v),
sound AS (SELECT * FROM place x WHERE NOT EXISTS (SELECT 1 FROM torn y WHERE y.doc_id = x.doc_id AND y.item_id = x.item_id AND y.shift = x.shift AND y.t BETWEEN x.p AND x.p + {WINDOW - 1})),
next_own AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS g FROM (SELECT DISTINCT doc_id, item_id, shift, p + k AS p FROM (SELECT *, unnest(range(0, {WINDOW})) AS k FROM sound))),
runs AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift, g) AS long FROM next_own),
own AS (SELECT r.* FROM runs r LEFT JOIN (SELECT DISTINCT doc_id, item_id, shift, true AS hurt FROM torn) USING (doc_id, item_id, shift) WHERE hurt IS NULL OR long >= {LONG}),
cov AS (SELECT doc_id, item_id, count(DISTINCT p) AS covered, max(long) AS longest FROM own GROUP BY ALL),
moved AS (SELECT doc_id, item_id, max(c) AS changed FROM (SELECT doc_id, item_id, shift, count(*) FILTER (a <> v) AS c FROM slots JOIN own USING (doc_id, item_id, shift, p) GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_tokens, CAST(covered AS INTEGER) AS covered_tokens, CAST(coalesce(changed, 0) AS INTEGER) AS changed_slots
FROM cov JOIN sizes ON sizes.id = item_id LEFT JOIN moved USING (doc_id, item_id) WHERE covered >= {COVERAGE} * n OR longest >= {LONG}"""
