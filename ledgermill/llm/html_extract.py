"""Main text of web pages: markup zones as the prior, a host suffix array as the evidence, for every page.

A page is cut into text blocks.  Markup puts each block in a zone: ``out`` (menus, headers, footers, sidebars, notices,
adverts, forms, comments, by element, role, class or id), ``main`` (inside an article or main element), or ``open``.  An
article or main element inside an ``out`` zone stays out, unless a form is all that it stands in; an article whose class
or id calls it a comment or an advert is out as well.  Inside the main zone a class is a name of boilerplate only as a
whole (``share``, ``share-buttons``): ``social-history`` is what a text is about.

For every host the token streams of its pages (main and open blocks) are concatenated, each page ended by a token of its
own, and sorted as a suffix array (prefix doubling over token ranks, to the depth of the shortest run that counts).
Neighbours in that order that share at least ``RUN`` tokens are repeats; what they cover decides with the zone:

* an open block that is covered for the larger part by runs of at least ``PAGES`` distinct pages goes; an open block of
  fewer than ``RUN`` tokens is a run of its own.  Unique open blocks stay, unless the page has a main zone of at least as
  many tokens: then they are what stands around the article;
* a main block goes if it is covered for the larger part by runs that stand on at least half of the host's pages,
  ``SITE_PAGES`` distinct ones or more: an unlabelled notice inside the article.  A shorter block than ``RUN`` tokens is a
  run of its own there too, but a short heading stays, as articles of one kind share their headings.  Rarer repeats stay,
  as an article may well quote what other pages quote.

A host is dealt by page id into blocks of bounded pages and bytes, and each block has its own suffix array, so a host
with a third of all pages is many tasks.  What a dealt host repeats is counted over the whole host: the blocks ask for the
runs that can matter (those of open blocks; those that half of the block's own pages hold, one of which every run on half
of the host's pages must be), the pages that hold them are counted (each batch gives at most ``SITE_PAGES`` pages a run, so
a run on every page is no hot key), and the counts go back: to the blocks that asked, or to all where a run is on half of
the pages.  So a text does not depend on how its
host is dealt.  Pages are parsed once; only their blocks travel.

Defined cases: a null page is empty; null URLs form one host; repeated rows and pages with equal token streams are one
distinct page (a mirror is no boilerplate); pages without text give an empty string; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import stash
from ledgermill.llm.hashing import mix64, run_hashes, word_hashes

RUN = 8
PAGES = 3
SITE_PAGES, SITE_SHARE = 12, 0.5
COVERED = 0.5
BLOCK_PAGES = 512
BLOCK_BYTES = 8 << 20
#: Asked runs are broadcast up to this many (16 bytes each) and joined by a shuffle beyond it.
BROADCAST_RUNS = 1_000_000
OUT, MAIN, HEAD, OPEN, FORM = "x", "m", "h", "o", "f"

#: A quote opens a value only behind an equals sign; elsewhere it is a character like any other.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|<[!?/][^>]*>""", re.S)
#: Elements by what they mean here.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = frozenset("svg math".split())
DROPPED = frozenset("head nav header footer aside form noscript template button select dialog menu svg object audio video canvas datalist fieldset map".split())
BREAKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead title tr ul".split())
SPACES = frozenset("br td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NESTING = (BREAKS | DROPPED) - frozenset("p hr li dd dt h1 h2 h3 h4 h5 h6 option tr html body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words that a class or id of boilerplate is, begins or ends with; a class that begins with a word of STATES says something of other elements.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners promo promos promoted promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices "
    "newsletter subscribe signup popup modal overlay sidebar side-bar nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar comment comments commentlist replies "
    "respond disqus related recommended share sharing social widget widgets toolbar pagination pager disclaimer copyright".split()
)
#: Names that an article element may have without being the main text.
ARTICLE_NAMES = frozenset("comment comments commentlist reply replies ad ads advert adverts advertisement advertisements advertising promo promoted sponsor sponsored".split())
#: What stands beside such a word in the class of a part of a page; beside any other word, inside the main text, the class says what the text is about.
PARTS = frozenset(
    "area article articles author bar block body bottom box button buttons container content count depth entry form header icon icons inline inner item items left link links list meta "
    "outer page panel post posts reader right section single site slot sticky story text thread top tree unit up user wrap wrapper".split()
)
HEADER_NAMES = frozenset("header page-header site-header".split())
STATES = frozenset("has no with without is not js show hide enable".split())
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def named(a: dict[str, str], words: frozenset[str]) -> bool:
    """Does a class or the id say that the element is one of ``words``?"""
    for token in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        parts = re.split("[-_]+", token)
        if parts[0] not in STATES and (token in words or parts[0] in words or parts[-1] in words):
            return True
    return False


def named_whole(a: dict[str, str], words: frozenset[str]) -> bool:
    """Is a class or the id one of ``words``, alone or among words for parts of a page and numbers?"""
    for token in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        parts = re.split("[-_]+", token)
        if token in words or (not words.isdisjoint(parts) and all(p in words or p in PARTS or not p or p.isdigit() for p in parts)):
            return True
    return False


def zone_of(tag: str, raw: str, zone: str) -> str:
    """Zone inside an element that opens in ``zone``."""
    if zone == OUT or tag in ("html", "body"):
        return zone
    a = attributes(raw)
    role = a.get("role", "").lower()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return OUT
    if tag == "main" or role == "main":
        return MAIN
    if tag == "article" or role == "article":
        return OUT if named_whole(a, ARTICLE_NAMES) else MAIN
    if role in ROLES or (named_whole if zone == MAIN else named)(a, NAMES):
        return OUT
    if tag == "header" or named(a, HEADER_NAMES):
        return MAIN if zone == MAIN else OUT
    if tag == "form" and zone != MAIN:
        return FORM
    return OUT if tag in DROPPED else zone


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of the page's text blocks in order; white space is single spaces, references are decoded."""
    page = page or ""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []
    zone, at, size, heading = OPEN, 0, len(page), False

    def hold(text: str) -> None:
        held.append(unescape(text) if "&" in text else text)

    def close() -> None:
        if held:
            text = "".join(held)
            held.clear()
            text = " ".join(text.split())
            if text:
                out.append((HEAD if heading and zone == MAIN else zone, text))

    while at < size:
        m = TAG.search(page, at)
        if m is None:
            hold(page[at:])
            break
        if m.start() > at:
            hold(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        end, raw = bool(m[1]), m[3] or ""
        if tag in SPACES:
            held.append(" ")
        if tag in BREAKS:
            close()
            heading = tag in HEADINGS and not end
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close()
                    zone = stack[k][1]
                    del stack[k:]
                    break
        elif tag in RAW:
            close() if tag in BREAKS else None
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else size
        elif tag not in VOID and not (tag in FOREIGN and raw.endswith("/")):
            inner = zone_of(tag, raw, zone)
            if tag == "body":  # ends a head that was left open
                close()
                stack.clear()
                zone = inner = OPEN
            if tag in NESTING or inner != zone:
                close()
                stack.append((tag, zone))
                zone = inner
    close()
    return out


def suffix_ranks(tokens: np.ndarray, depth: int = RUN) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` tokens (a power of two): prefix doubling, equal prefixes rank alike."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth:
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-k] = rank[k:] + 1
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return rank


class Page:
    """The blocks of a page that markup leaves: zones, texts, and the token stream of all of them."""

    def __init__(self, zones: str, text: str):
        self.zones, self.texts = zones, text.split("\n") if zones else []
        words = [word_hashes(t) for t in self.texts]
        self.sizes = [len(w) for w in words]
        self.stream = np.concatenate([np.empty(0, dtype=np.uint64), *words])
        self.key = blake2b(self.stream.tobytes(), digest_size=8).digest()
        self.starts = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))

    @cached_property
    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, hash) of the runs of RUN tokens, then of the blocks that are shorter, headings aside."""
        n = len(self.stream)
        long = run_hashes(mix64(self.stream), RUN) if n >= RUN else np.empty(0, dtype=np.uint64)
        short = [k for k, (z, size) in enumerate(zip(self.zones, self.sizes, strict=True)) if z != HEAD and size < RUN]
        own = [run_hashes(mix64(self.stream[self.starts[k] : self.starts[k + 1]]), RUN) for k in short]
        starts = np.concatenate((np.arange(len(long)), self.starts[short])).astype(np.int64)
        lengths = np.concatenate((np.full(len(long), RUN), np.array(self.sizes, dtype=np.int64)[short])).astype(np.int64)
        return starts, lengths, np.concatenate([long, *own])

    def touches(self, zone: str) -> np.ndarray:
        """Which of ``runs`` hold a token of a zone; a heading is of the main zone."""
        at = np.concatenate(([0], np.cumsum(np.repeat([z == zone or (zone == MAIN and z == HEAD) for z in self.zones], self.sizes).astype(np.int64)))) if len(self.stream) else np.zeros(1, dtype=np.int64)
        starts, lengths, _ = self.runs
        return at[starts + lengths] > at[starts]

    def covered(self, some: np.ndarray) -> list[int]:
        """Tokens of each block under the chosen ones of ``runs``."""
        starts, lengths, _ = self.runs
        hit = np.zeros(len(self.stream) + 1, dtype=np.int64)
        np.add.at(hit, starts[some], 1)
        np.add.at(hit, (starts + lengths)[some], -1)
        upto = np.concatenate(([0], np.cumsum(np.cumsum(hit)[:-1] > 0)))
        return [int(upto[b] - upto[a]) for a, b in zip(self.starts, self.starts[1:], strict=False)]


def tally(pages: list[Page]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each page and each of its ``runs``: how many distinct pages hold the run, and how many pages in all."""
    times = Counter(p.key for p in pages)
    distinct = list({p.key: p for p in pages}.values())
    copies = np.array([times[p.key] for p in distinct], dtype=np.int64)
    sizes = np.array([len(p.stream) + 1 for p in distinct])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    page = np.repeat(np.arange(len(distinct)), sizes)
    flat = np.empty(int(sizes.sum()), dtype=np.uint64)
    for p, a in zip(distinct, starts, strict=True):
        flat[a : a + len(p.stream)] = p.stream
    flat[starts + sizes - 1] = mix64(np.arange(len(distinct), dtype=np.uint64) + np.uint64(1 << 40))
    rank = suffix_ranks(flat)
    order = np.lexsort((page, rank))  # the suffix array, ties by page
    r, p = rank[order], page[order]
    new = np.concatenate(([True], r[1:] != r[:-1]))
    fresh = new | np.concatenate(([True], p[1:] != p[:-1]))
    group = np.cumsum(new) - 1
    kinds, rows = np.empty((2, len(flat)), dtype=np.int64)
    kinds[order] = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(new))[group]
    rows[order] = np.add.reduceat(fresh * copies[p], np.flatnonzero(new))[group]
    short: dict[int, list[int]] = {}
    for one, n in zip(distinct, copies, strict=True):
        starts_, lengths, hashes = one.runs
        for h in set(hashes[lengths < RUN].tolist()):
            held = short.setdefault(h, [0, 0])
            held[0] += 1
            held[1] += int(n)
    of = {}
    for one, a in zip(distinct, starts, strict=True):
        starts_, lengths, hashes = one.runs
        whole = lengths == RUN
        at = a + starts_[whole]
        rest = np.array([short[h] for h in hashes[~whole].tolist()], dtype=np.int64).reshape(-1, 2)
        of[one.key] = np.concatenate((kinds[at], rest[:, 0])), np.concatenate((rows[at], rest[:, 1]))
    return [of[p.key] for p in pages]


def main_text(page: Page, often: np.ndarray, wide: np.ndarray) -> str:
    """What stays of a page whose ``runs`` are repeated (``often``) or stand all over the site (``wide``)."""
    hits, site = page.covered(often), page.covered(wide)
    kept = []
    for zone, n, h, s in zip(page.zones, page.sizes, hits, site, strict=True):
        kept.append(h <= COVERED * n if zone == OPEN else (zone == HEAD and n < RUN) or s <= COVERED * n)
    size = lambda open_: sum(n for z, n, k in zip(page.zones, page.sizes, kept, strict=True) if (z == OPEN) == open_ and k)
    lead = not set(page.zones) - {OPEN} or size(True) > size(False)
    return "\n\n".join(t for z, t, k in zip(page.zones, page.texts, kept, strict=True) if k and (z != OPEN or lead))


def site_wide(kinds: np.ndarray, rows: np.ndarray, pages: int) -> np.ndarray:
    return (kinds >= SITE_PAGES) & (rows >= SITE_SHARE * pages)


def main_texts(pages: list[tuple[str, str]], known: tuple[np.ndarray, np.ndarray] | None = None) -> list[str]:
    """Main texts of pages (zones, blocks by line): of a whole host, or of a block of one whose repeated and site-wide runs are known."""
    held = [Page(*p) for p in pages]
    if known is not None:
        return [main_text(p, *(np.isin(p.runs[2], some) for some in known)) for p in held]
    return [main_text(p, kinds >= PAGES, site_wide(kinds, rows, len(held))) for p, (kinds, rows) in zip(held, tally(held), strict=True)]


def left(page: str | None) -> tuple[str, str]:
    """What markup leaves of a page: the zones of its main and open blocks, and the blocks by line."""
    some = [(z, t) for z, t in blocks(page) if z in (MAIN, HEAD, OPEN)]
    return "".join(z for z, _ in some), "\n".join(t for _, t in some)


def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cut = [left(p) for p in pdf["html"]]
        raw = [t.encode("utf-8", "surrogatepass") for _, t in cut]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "host": pdf["host"], "zones": [z for z, _ in cut], "text": [zlib.compress(t, 1) for t in raw], "size": [len(t) for t in raw]})


def unpacked(text: bytes) -> str:
    """Blocks travel deflated: they are dealt up to twice."""
    return zlib.decompress(text).decode("utf-8", "surrogatepass")


def grouped(batches: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal (host, part)."""
    key, held = None, []
    for pdf in batches:
        for host, part, *row in zip(*(pdf[c] for c in ("host", "part", *columns)), strict=True):
            if (host, part) != key:
                if held:
                    yield key, held
                key, held = (host, part), []
            held.append(row)
    if held:
        yield key, held


def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of each block whose counts over the whole host can decide something."""
    for (host, part), rows in grouped(batches, ("zones", "text")):
        pages = [Page(zones, unpacked(text)) for zones, text in rows]
        found = []
        for p, (_, times) in zip(pages, tally(pages), strict=True):
            some = (times >= SITE_SHARE * len(pages)) & p.touches(MAIN)
            found.append(p.runs[2][some | p.touches(OPEN)])
        yield pd.DataFrame({"host": host, "part": part, "run": np.unique(np.concatenate(found)).view(np.int64)})


def held_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, run, page, times): who holds which runs; each run of a batch with at most SITE_PAGES distinct pages, the others added to the first."""
    for pdf in batches:
        for host, some in pdf.groupby("host"):
            pages = [Page(zones, unpacked(text)) for zones, text in zip(some["zones"], some["text"], strict=True)]
            times = Counter(p.key for p in pages)
            each = {p.key: np.unique(p.runs[2]) for p in pages}
            ids = np.array([int.from_bytes(k, "little") for k in each], dtype=np.uint64)
            sizes = [len(x) for x in each.values()]
            got = pd.DataFrame({"host": host, "run": np.concatenate([*each.values()]).view(np.int64), "page": np.repeat(ids, sizes).view(np.int64), "times": np.repeat([times[k] for k in each], sizes)})
            nth = got.groupby("run").cumcount()
            more = got[nth >= SITE_PAGES].groupby("run")["times"].sum()
            got["times"] += np.where(nth == 0, got["run"].map(more).fillna(0), 0).astype(np.int64)
            yield got[nth < SITE_PAGES]


def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ordered by (host, part): each run of equal keys is one block of a host; rows with ``often`` aren't pages."""
    for _, rows in grouped(batches, ("page_id", "url", "zones", "text", "dealt", "often", "wide")):
        known = None
        if rows[0][4]:
            runs = [r[5:] for r in rows if r[5] is not None]
            known = tuple(np.concatenate([np.empty(0, dtype=np.int64), *(np.asarray(r[k], dtype=np.int64) for r in runs)]).view(np.uint64) for k in (0, 1))
        pages = [r for r in rows if r[5] is None]
        got = main_texts([(r[2], unpacked(r[3])) for r in pages], known)
        if pages:
            yield pd.DataFrame({"page_id": [r[0] for r in pages], "url": [r[1] for r in pages], "text": got, "n_chars": [len(t) for t in got]})


def extract(pages: DataFrame, block_pages: int = BLOCK_PAGES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    base = pages.select(
        F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.coalesce(F.regexp_extract(F.lower("url"), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")).alias("host"),
    )
    cut = stash(base.mapInPandas(parse, "page_id string, url string, host string, zones string, text binary, size long"), "page-blocks")
    # One row a host, written: Spark knows then how large the table of large hosts is.
    sizes = stash(cut.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("bytes")), "hosts")
    large = stash(sizes.select("host", "pages", F.greatest(F.ceil(F.col("pages") / block_pages), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("parts")).where("parts > 1"), "large-hosts")
    none = F.lit(None).cast("array<long>")
    dealt = (
        cut.join(large.select("host", "parts"), "host", "left")
        .withColumns({"part": F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")), F.lit(0)).cast("int"), "dealt": F.col("parts").isNotNull(), "often": none, "wide": none})
        .drop("parts", "size")
    )
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * total / block_bytes))
    if not large.isEmpty():
        asked = dealt.where("dealt").select("host", "part", "zones", "text").repartition(tasks, "host", "part").sortWithinPartitions("host", "part")
        wanted = stash(asked.mapInPandas(ask, "host string, part int, run long"), "asked-runs")
        runs = wanted.select("host", "run").distinct()
        small = runs.count() <= BROADCAST_RUNS
        if not wanted.isEmpty():
            # The joins' keys hold the run, so that no host is one task.
            hosts = stash(wanted.select("host").distinct(), "asking-hosts")
            found = cut.join(hosts, "host", "left_semi").select("host", "zones", "text").mapInPandas(held_runs, "host string, run long, page long, times long")
            held = found.join(F.broadcast(runs) if small else runs, ["host", "run"], "left_semi")
            counts = held.groupBy("host", "run", "page").agg(F.sum("times").alias("times")).groupBy("host", "run").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("rows"))
            often = counts.join(large.select("host", "pages"), "host").where(F.col("kinds") >= PAGES).select("host", "run", ((F.col("kinds") >= SITE_PAGES) & (F.col("rows") >= SITE_SHARE * F.col("pages"))).alias("site"))
            often = stash(often, "repeated-runs")
            # Runs on half of the host's pages go to all of its blocks: there are at most twice as many as an average page has.
            site = often.where("site").join(large, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("run"), F.col("run").alias("site"))
            asked_for = wanted.join(often.select("host", "run"), ["host", "run"]).select("host", "part", "run", F.lit(None).cast("long").alias("site"))
            back = asked_for.unionByName(site).groupBy("host", "part").agg(F.collect_list("run").alias("often"), F.collect_list("site").alias("wide"))
            dealt = dealt.unionByName(back.withColumn("dealt", F.lit(True)), allowMissingColumns=True)
    return (
        dealt.repartition(tasks, "host", "part")
        .sortWithinPartitions("host", "part", F.col("often").isNull(), "page_id")
        .mapInPandas(run, "page_id string, url string, text string, n_chars long")
        .withColumn("page_id", F.col("page_id").cast("long"))
    )


#: For pages of the test tables' make (one article of headings and paragraphs) the same text by patterns alone.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'), lambda s: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda s: s <> '') AS l FROM a)
SELECT page_id, url, array_to_string(l, chr(10) || chr(10)) AS text, length(array_to_string(l, chr(10) || chr(10)))::BIGINT AS n_chars FROM b"""
