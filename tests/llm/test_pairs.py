import random
import re
from collections import Counter

from ledgermill.llm import decontam, jaccard
from ledgermill.llm.graph import components


def shingle_sets(rows):
    out = {}
    for d, t in rows:
        w = (t or "").split()
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute(rows, threshold=0.8):
    sets = shingle_sets(rows)
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    n = Counter()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (find(i), n[i]) for i in ids}


def near_copies(seed, groups=12, words=60):
    rng = random.Random(seed)
    rows, doc = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, words))]
        for _ in range(rng.choice((1, 2, 5, 30))):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 2))):
                text[rng.randrange(len(text))] = f"w{rng.randrange(5000)}"
            rows.append((doc, " ".join(text)))
            doc += 1
    return [*rows, (doc, ""), (doc + 1, None), (doc + 2, "one two"), (doc + 3, "one two")]


def test_join_against_brute_force(spark):
    rows = near_copies(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"block": 4}, {"block_shingles": 200}):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(docs, **options).collect()}
        assert got == brute(rows)


def test_join_on_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(documents).collect()} == brute(rows)


def test_band_plan():
    bands, rows = jaccard.band_plan()
    assert 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL and bands * rows <= jaccard.MAX_HASHES


def test_join_odd_rows(odd_docs, no_docs):
    rows = jaccard.join(odd_docs).collect()
    assert len(rows) == 10 and sum(r["class_id"] is None for r in rows) == 2
    assert {(r["class_id"], r["n_links"]) for r in rows if r["doc_id"] in (1, 5)} == {(1, 2)}
    assert {(r["class_id"], r["n_links"]) for r in rows if r["doc_id"] in (2, 3, 7)} == {(2, 2)}
    assert jaccard.join(no_docs).count() == 0
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "6", "None", "None"]


def test_keep_one_of_repeated_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    kept = lambda rows: sorted(tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept([(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert kept([(5, a), (5, b), (5, b)]) == [(5, a), (5, b)]


def test_long_chains_cost_what_their_links_cost(spark):
    """Windows sliding over one word list: neighbours are alike, the ends have nothing in common."""
    words = [f"w{i * 7919 % 100_003}" for i in range(3000)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 200])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(docs, block=16).collect()} == brute(rows)
    tied = spark.range(400).selectExpr("id as node", "0L as grp", "100 as n")
    posted = spark.range(400).selectExpr("id as node", "explode(array(id, id + 1)) as bucket")
    sides, tasks = jaccard.dealt(tied, posted, 16, 1 << 20)
    assert tasks.join(sides, "side").count() <= 6 * 400  # how often texts are sent; each to all others would be 160,000


def test_components(spark):
    rng = random.Random(4)
    edges = [(a, a + 1) for a in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 500)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in top} and len(got) == len(top)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


ITEM = "A farmer called Maria sells 12 kg of apples for 36.50 dollars and later Maria buys 7 kg of pears, how much money is left at the end of the day?"


def test_templates(spark):
    index = decontam.Index([(7, ITEM)])
    verbatim = f"Some words before. {ITEM} And after."
    changed = verbatim.replace("Maria", "Olga").replace("12 kg", "99 kg").replace("36.50", "1,250.75")
    torn = verbatim.replace("later Maria", "later Boris")
    assert [h[0] for h in index.hits(verbatim)] == [7] and index.hits(verbatim)[0][3] == 0
    assert [h[0] for h in index.hits(changed)] == [7] and index.hits(changed)[0][3] >= 4
    assert index.hits(torn) == [] or index.hits(torn)[0][2] < len(decontam.canonical(ITEM)[0])
    for clean in ("", None, "A farmer called the day.", "word " * 500, ITEM[:40]):
        assert index.hits(clean) == []


def test_inconsistent_slots_are_refused():
    item = "give Anna the book and then Anna gives back the same book to the old man"
    assert decontam.Index([(1, item)]).hits(item.replace("then Anna", "then Berta")) == []


def test_a_clash_drops_only_its_windows():
    index = decontam.Index([(7, ITEM)])
    n = len(decontam.canonical(ITEM)[0])
    torn = ITEM.replace("later Maria", "later Boris")
    assert index.hits(f"Some words before. {torn}") == [(7, n, n - 1, 0)]
    both = ITEM.replace("called Maria", "called Olga").replace("later Maria", "later Boris")
    assert [h[0] for h in index.hits(both)] == [7]


def test_two_values_may_become_one():
    item = "she has 3 apples and 5 pears in a basket and gives away two of them"
    assert decontam.Index([(1, item)]).hits(item.replace("3", "4").replace("5", "4")) == [(1, 16, 16, 2)]


def test_a_long_passage_is_a_leak_however_long_the_item():
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    index = decontam.Index([(5, " ".join(words))])
    said = lambda n: index.hits("before it " + " ".join(words[20 : 20 + n]) + " after it")
    assert said(29) == [(5, 59, 29, 0)] and said(13) == [(5, 59, 13, 0)]
    assert said(12) == []


def plain_tokens(text):
    """Values of the tokens as their definition reads: runs of word characters, digits joined by a point or comma are one."""
    return [m[0].lower().replace(",", ".") for m in re.finditer(r"[0-9][A-Za-z0-9\x80-\U0010ffff]*(?:[.,][0-9][A-Za-z0-9\x80-\U0010ffff]*)*|[A-Za-z0-9\x80-\U0010ffff]+", text or "")]


def windows_by_brute_force(docs, items, n=8):
    """Documents that hold at least half of an item's words, or 13 in a row, in runs of n equal words."""
    out = set()
    for d, t in docs:
        w = plain_tokens(t)
        runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, text in items:
            v = plain_tokens(text)
            held = [False] * len(v)
            for i in range(len(v) - n + 1):
                if tuple(v[i : i + n]) in runs:
                    held[i : i + n] = [True] * n
            longest = max(map(len, "".join("x" if h else " " for h in held).split()), default=0)
            if sum(held) >= 0.5 * len(v) or longest >= 13:
                out.add((d, k))
    return out


def test_verbatim_leaks_are_found(spark, sf):
    d = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find(docs, bench).collect()}
    want = windows_by_brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert want and want == got
    kept = {r["doc_id"] for r in decontam.clean(docs, bench).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - {d for d, _ in got}


def test_short_items_are_sentences_of_their_own(spark):
    index = decontam.Index([(1, "name the capital now"), (2, "who is the king of Spain"), (3, "42")])
    said = lambda text: [h[0] for h in index.hits(text)]
    assert said("Before it. Name the capital now! And after") == [1] and said("name the capital now") == [1]
    assert said("please name the capital now") == [] and said("Name the capital now please.") == []
    assert said("They ask who is the king of Spain today") == [2]
    assert said("It is 42 now") == [] and said("The answer: 42.") == [3]


def test_windows_of_placeholders_meet_verbatim_and_beside_others():
    item = "Add 3 4 5 6 7 8 9 10 11 12 13 and tell the whole sum of them"
    index = decontam.Index([(1, item)])
    n = len(decontam.canonical(item)[0])
    assert index.hits("So: " + item) == [(1, n, n, 0)]
    other = "Add 30 40 50 60 70 80 90 100 110 120 130 and tell the whole sum of them"
    assert index.hits("So: " + other) == [(1, n, n, 11)]
    numbers = " ".join(str(k) for k in range(100, 116))
    assert [h[0] for h in decontam.Index([(2, numbers)]).hits(f"table {numbers} end")] == [2]
    assert decontam.Index([(2, numbers)]).hits("table " + " ".join(str(k) for k in range(300, 330))) == []


def test_large_benchmarks_are_joined_by_a_shuffle(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    more = spark.createDataFrame([(-1, ITEM), (None, "name the capital now"), (-3, ITEM), (-4, None), (-5, "")], "item_id long, text string")
    leaks = spark.createDataFrame([(None, ITEM.replace("Maria", "Olga")), (-8, "So: name the capital now."), (-8, "So: name the capital now."), (-9, None)], "doc_id long, text string")
    docs, bench = docs.select("doc_id", "text").union(leaks), bench.select("item_id", "text").union(more)
    found = sorted(map(str, decontam.find(docs, bench).collect()))
    kept = sorted(map(str, decontam.clean(docs, bench).collect()))
    monkeypatch.setattr(decontam, "PART_BYTES", 0)
    assert sorted(map(str, decontam.find(docs, bench).collect())) == found and len(found) > 8
    assert sorted(map(str, decontam.clean(docs, bench).collect())) == kept
    assert decontam.find(docs.limit(0), bench).count() == 0


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, ITEM), (None, None), (2, ""), (3, "tiny one"), (None, ITEM)], "item_id long, text string")
    assert decontam.find(odd_docs, bench).count() == 0 and decontam.find(no_docs, bench).count() == 0
    assert decontam.clean(odd_docs, bench).collect() == odd_docs.collect()
    assert decontam.find(odd_docs, bench.limit(0)).count() == 0
    leak = spark.createDataFrame([(None, ITEM), (8, ITEM)], "doc_id long, text string")
    assert decontam.find(leak, bench).count() == 4


def test_decontamination_over_seams(spark):
    item = "A train runs 5 km to the town of Port Anna. It takes 1,234.5 seconds, 20 minutes or so"
    index = decontam.Index([(1, item), (2, "Name the capital now")])
    frame = "and so on. " + item + ". Name the capital now. Then it ends"
    whole = decontam.canonical(frame)
    for size in range(1, len(frame) + 1):
        for got, want in zip(decontam.canonical(frame, size), whole, strict=True):
            assert got.tolist() == want.tolist(), size
    fill = "word " * ((decontam.PIECE - len(frame)) // 5)
    want = sorted(index.hits("x. " + frame))
    assert [h[0] for h in want] == [1, 2] and want[0][1] == want[0][2]
    gaps = [0, *(m.end() for m in re.finditer(r"\s+", frame)), len(frame)]
    for at in gaps:  # the seam stands before every word in turn
        lead = "w" * (decontam.PIECE - len(fill) - at - 3) + ". "
        text = fill + lead + " " + frame
        assert len(fill + lead) + 1 + at == decontam.PIECE
        assert sorted(index.hits(text)) == want, at


def test_clean_keeps_clashing_columns(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "nothing here", 7)], "doc_id long, text string, _hit int")
    bench = spark.createDataFrame([(1, "Name the capital of the northern land now please")], "item_id long, text string")
    monkeypatch.setattr(decontam, "PART_BYTES", 0)
    assert decontam.clean(docs, bench).collect() == docs.collect()
