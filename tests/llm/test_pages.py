import base64
import gzip
import hashlib

import numpy as np
import pytest

from ledgermill.llm import html_extract, warc

PAGES = "page_id long, url string, html string, digest string, host string"


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [
        (1, "http://a.example/x y?é", "<p>same</p>", "d", "h"), (2, None, "<p>same</p>", None, None), (3, "http://b.example/", None, "d", "h"), (4, "", "", "d", "h"),
        (5, "http://c.example/\r\nX: y", "<article><p>é &amp; ü</p></article>", "d", "h"), (None, "http://d.example/", "<p>same</p>", "d", "h"), (6, "http://e.example/", "<p>long " * 60_000, "d", "h"), (2, None, "<p>same</p>", None, None),
    ]
    return spark.createDataFrame(rows, PAGES)


def test_warc_round_trip(spark, odd_pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(odd_pages, path)
    got = [r.asDict() for r in warc.read(spark, path).collect()]
    want = odd_pages.collect()
    assert len(got) == len(want) and all(r["verified"] for r in got)
    assert sorted(map(str, (r["url"] for r in got))) == sorted(map(str, (r["url"] for r in want)))
    for page in want:
        raw = (page["html"] or "").encode()
        for r in (r for r in got if r["page_id"] == page["page_id"]):
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            largest = max(p["page_id"] for p in want if p["page_id"] is not None and (p["html"] or "") == (page["html"] or ""))
            assert (r["record_type"], r["refers_to"]) == (("response", None) if largest == page["page_id"] else ("revisit", largest))
            assert r["payload"] == (raw if r["record_type"] == "response" else None)


def test_warc_hot_payload(spark, tmp_path):
    pages = spark.range(900).selectExpr("id as page_id", "concat('http://h/', id) as url", "if(id % 3 = 0, '<p>everywhere</p>', concat('<p>', id % 250, '</p>')) as html")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path, hot_part=10)
    got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    largest = {r["html"]: r["page_id"] for r in pages.orderBy("page_id").collect()}
    assert len(got) == 900
    for p in pages.collect():
        top = largest[p["html"]]
        assert (got[p["page_id"]]["record_type"], got[p["page_id"]]["refers_to"]) == (("response", None) if top == p["page_id"] else ("revisit", top))


def test_archive_is_plain_gzip(spark, odd_pages, tmp_path):
    path = f"{tmp_path}/w"
    warc.write(odd_pages.where("page_id = 5"), f"file://{path}")
    (file,) = [p for p in __import__("pathlib").Path(path).iterdir() if p.name.startswith("part")]
    data = gzip.decompress(file.read_bytes())
    assert data.count(b"WARC/1.1\r\n") == 2 and "é &amp; ü".encode() in data
    assert len(list(warc.members(file.read_bytes()))) == 2


def test_damage_is_noticed():
    good = warc.member(warc.page_record(1, "http://a", b"payload", 1))
    assert next(warc.parsed(good))[-1]
    bad = warc.member(warc.page_record(1, "http://a", b"payload", 1).replace(b"payload\r\n\r\n", b"paxload\r\n\r\n"))
    assert not next(warc.parsed(bad))[-1]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.parsed(good[:-9]))


def test_warc_query_on_real_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["payload_digest"] for r in warc.round_trip(pages).collect()}
    assert got == {r["page_id"]: base64.b32encode(hashlib.sha1(r["html"].encode()).digest()).decode() for r in pages.collect()}


def test_warc_empty(spark, odd_pages):
    assert warc.round_trip(odd_pages.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
<nav><ul><li>Home</ul></nav><!-- x --><div class="ad">Buy <b>now</b></div><header><h1>Site</h1></header>
<main><article><h1>Title &amp; more</h1><p><b>One
  two.<br><p>Three&nbsp;four &lt;x&gt;<div class="comments"><p>Reader</p></div><p title="a > b">Five</article></main>
<aside>side</aside><form><p>Sign up</form><div id="cookie-notice">Cookies</div><footer>&copy; all"""


def texts(*pages):
    return html_extract.main_texts([html_extract.left(p) for p in pages])


def test_zones():
    assert texts(PAGE) == ["Title & more\n\nOne two.\n\nThree four <x>\n\nFive"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body class="no-sidebar"><article class="post has-sidebar menu">Body<p>text</p></article>', "Body\n\ntext"),
        ('<main><section id="comments"><article>Reader says</article></section><p>Story', "Story"),
        ("<aside><article>Teaser</article></aside><article>Story</article>", "Story"),
        ("<article data-u=https://a.b/>In the article</article><p>outside of it", "In the article"),
        ('<article><p title="' + "x" * 200_000 + ">\">Long attribute</p></article>", "Long attribute"),
        ("<p>don't</p><article title=\"a > b\" data-x='\">'>It's \"so\" <b>bold</b>", 'It\'s "so" bold'),
        ("<form id=aspnetForm><p>search</p><article>Inside a form</article></form>", "Inside a form"),
        ("<article>Story<form><p>Sign up</p></form><p>goes on</article>", "Story\n\ngoes on"),
        ('<div class="wrap ad-slot"><p>Buy</div><div class="upload">Kept</div>', "Kept"),
        ('<div class="with-comments">Kept</div><div class="post comments">Gone</div><ul role=navigation><li>Gone</ul>', "Kept"),
    ],
)
def test_markup_cases(page, want):
    assert texts(page) == [want]


STORY = "<p>The story goes on</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{STORY}</article><article class=comment><p>I agree</article>",
        f"<article>{STORY}<div><article class='comment depth-1'><p>I agree</article></div></article>",
        f"<article>{STORY}</article><div role=article class=comment><p>I agree</div>",
        f"<article>{STORY}</article><article id=comment-17><p>I agree</article>",
        f"<main>{STORY}<article class=advert><p>Buy</article><article class='ad-slot'>Buy</article></main>",
        f"<article>{STORY}<div class=share-buttons>Share</div><div class='social'>Like</div><ul class=related-posts><li>More</ul><ol class=comment-list><li>Yes</ol></article>",
    ],
)
def test_comments_and_adverts_in_articles_go(page):
    assert texts(page) == ["The story goes on"]


@pytest.mark.parametrize("name", ["social-history", "copyright-law", "related-work", "notice-of-death", "menu-item-history"])
def test_compound_names_inside_the_main_text_stay(name):
    assert texts(f'<article>{STORY}<div class="{name}"><p>Of it</div></article>') == ["The story goes on\n\nOf it"]


def test_text_nodes_are_decoded_one_by_one():
    assert texts("<article>super<wbr>cali &<b>amp;</b> &amp;lt; &lt;x</article>") == ["supercali &amp; &lt; <x"]


def test_short_blocks_inside_articles():
    story = lambda i: " ".join(f"s{i}x{k}" for k in range(30))
    pages = [f"<article><h2>In short</h2><p>Share this story</p><p>{story(i)}</p>{'<p>Rare line</p>' if i < 19 else ''}</article>" for i in range(40)]
    assert texts(*pages) == [f"In short\n\n{story(i)}" + ("\n\nRare line" if i < 19 else "") for i in range(40)]


def test_short_blocks_do_not_depend_on_blocks(spark):
    story = lambda i: " ".join(f"s{i}x{k}" for k in range(30))
    pages = [f"<article><p>Share this story</p><p>{story(i)}</p></article>" for i in range(40)]
    docs = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for size in (512, 7):
        assert {r["page_id"]: r["text"] for r in html_extract.extract(docs, block_pages=size).collect()} == {i: story(i) for i in range(40)}


def test_open_pages_lose_what_the_host_repeats():
    menu = " ".join(f"menu{i}" for i in range(12))
    pages = [f"<div>{menu}</div><div>Home About Contact</div><p>unique text of page {i} " + " ".join(f"w{i}x{k}" for k in range(20)) + "</p>" for i in range(5)]
    assert texts(*pages) == [" ".join(p.split("<p>")[1].removesuffix("</p>").split()) for p in pages]
    # a mirror is no boilerplate
    assert all(texts(*[pages[0]] * 5))


def test_a_small_main_zone_leaves_the_open_story():
    menu = " ".join(f"menu{i}" for i in range(12))
    story = lambda i: " ".join(f"s{i}x{k}" for k in range(40))
    pages = [f"<div>{menu}</div><article>Teaser {i}</article><p>{story(i)}</p>" for i in range(4)]
    assert [t.split() for t in texts(*pages)] == [f"Teaser {i} {story(i)}".split() for i in range(4)]
    # open text that is less than the article stays out
    assert texts(f"<p>Read on<article>{story(9)}</article>") == [story(9)]


def notice_site(n, on):
    """Articles with an unlabelled notice on the first ``on`` of n pages."""
    notice = " ".join(f"notice{i}" for i in range(12))
    story = lambda i: " ".join(f"s{i}x{k}" for k in range(30))
    pages = [f"<article><h1>Introduction</h1>{f'<p>{notice}</p>' if i < on else ''}<p>{story(i)}</p></article>" for i in range(n)]
    return pages, [f"Introduction\n\n{notice}\n\n{story(i)}" if i < on else f"Introduction\n\n{story(i)}" for i in range(n)], [f"Introduction\n\n{story(i)}" for i in range(n)]


def test_articles_lose_what_stands_all_over_the_site():
    for n, on in ((30, 30), (30, 15)):
        pages, _, without = notice_site(n, on)
        assert texts(*pages) == without
    for n, on in ((30, 14), (11, 11)):  # a passage that some pages quote, a site too small to tell
        pages, with_it, _ = notice_site(n, on)
        assert texts(*pages) == with_it


def test_site_wide_runs_do_not_depend_on_blocks(spark):
    for on in (20, 19):
        pages, with_it, without = notice_site(40, on)
        docs = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
        for size in (512, 7, 3):
            got = {r["page_id"]: r["text"] for r in html_extract.extract(docs, block_pages=size).collect()}
            assert got == dict(enumerate(without if on == 20 else with_it))


def test_shuffled_runs_count_like_broadcast_ones(spark, monkeypatch):
    pages, _, without = notice_site(40, 40)
    docs = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    monkeypatch.setattr(html_extract, "BROADCAST_RUNS", 0)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(docs, block_pages=7).collect()} == dict(enumerate(without))


def test_counts_by_brute_force():
    rng = np.random.default_rng(2)
    words = "abc"
    kinds = ["".join(rng.choice(["m", "o"], size=k)) for k in (3, 4, 1, 5, 2)]
    pages = [html_extract.Page(z, "\n".join(" ".join(words[i] for i in rng.integers(0, 3, size=rng.integers(1, 25))) for _ in z)) for z in kinds]
    pages += [pages[0], html_extract.Page("", "")]
    lines = [(p.zones, [t.split() for t in p.texts]) for p in pages]
    n = html_extract.RUN

    def holds(run, zones, blocks):
        flat = [w for b in blocks for w in b]
        if len(run) == n:
            return any(flat[i : i + n] == run for i in range(len(flat) - n + 1))
        return any(z != "h" and b == run for z, b in zip(zones, blocks, strict=True))

    for p, (got_kinds, got_rows) in zip(pages, html_extract.tally(pages), strict=True):
        flat = [w for t in p.texts for w in t.split()]
        for start, length, k, r in zip(*p.runs[:2], got_kinds, got_rows, strict=True):
            on = [j for j, x in enumerate(lines) if holds(flat[start : start + length], *x)]
            assert (len({pages[j].key for j in on}), len(on)) == (k, r)


def test_extract_odd_pages(odd_pages):
    got = html_extract.extract(odd_pages, block_pages=2).collect()
    assert len(got) == 8
    assert {r["text"] for r in got if r["page_id"] == 5} == {"é & ü"}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(odd_pages.limit(0)).count() == 0


def test_runs_count_over_the_whole_host(spark):
    notice, menu = (" ".join(f"{w}{i}" for i in range(12)) for w in ("notice", "menu"))
    story = lambda i: " ".join(f"s{i}x{k}" for k in range(30))
    rows = [(i, f"http://a.example/{i}", f"<div>{menu}</div>" + f"<p>{notice}</p>" * (i % 12 == 0) + f"<p>{story(i)}</p>") for i in range(48)]
    # a run on two pages, one of them mirrored, is no boilerplate; neither are runs that other hosts share
    twice = " ".join(f"twice{i}" for i in range(12))
    rows += [(i, "http://a.example/t", f"<p>{twice}</p><p>{story(min(i, 101))}</p>") for i in (100, 101, 102)]
    rows += [(200 + i, f"http://b{i}.example/", f"<p>{notice}</p><p>{story(200 + i)}</p>") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: story(i) for i in range(48)} | {i: f"{twice}\n\n{story(min(i, 101))}" for i in (100, 101, 102)} | {200 + i: f"{notice}\n\n{story(200 + i)}" for i in range(3)}
    for size in (512, 4):
        assert {r["page_id"]: r["text"] for r in html_extract.extract(pages, block_pages=size).collect()} == want
