import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import retrieval as rt
from ledgermill.operators import text_index
from ledgermill.operators.text_index import TextIndex
from ledgermill.shared import new_path
from tests.plans import most_rows

CHUNK, QUERY = "chunk_id long, body string", "query_id long, text string"


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture
def words():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    return lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=n))


def test_changes_equal_a_rebuild(spark, words, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 4)
    monkeypatch.setattr(text_index, "SEEDS", 2)
    state = {i: words(3 + i % 40) for i in range(150)} | {150: None, 151: "", 152: "w1"}
    queries = spark.createDataFrame([(1, "w1 w2 w55"), (2, "w40 w40 w3"), (3, "absent"), (4, "w0")], QUERY)
    index = TextIndex.create(spark.createDataFrame([], CHUNK), new_path(spark, "test-index"), ())
    assert rows(index.search(queries, 5)) == []
    index.add(spark.createDataFrame(list(state.items()), CHUNK))
    before = rows(index.search(queries, 5))

    def same():
        anew = spark.createDataFrame([(k, v or "") for k, v in state.items()], CHUNK)
        assert rows(index.search(queries, 5)) == rows(rt.bm25(anew, queries, 5, ()))
        want = {r["term"]: r["df"] for r in rt.postings(anew, ()).groupBy("term").count().withColumnRenamed("count", "df").collect()}
        assert {r["term"]: r["df"] for r in index.terms().collect()} == want | {"": len(state)}

    same()
    gone = [i for i in range(150) if i % 4 == 1] + [999]
    index.remove(spark.createDataFrame([(i,) for i in gone * 2], "chunk_id long"))
    state = {k: v for k, v in state.items() if k not in gone}
    same()
    new = {i: words(8) for i in (0, 1, 2, 500)}
    index.add(spark.createDataFrame([*new.items(), (500, "")], CHUNK))
    state |= new
    same()
    index.compact()
    same()
    assert rows(index.search(queries, 5, version=1)) == before


def test_a_text_is_cut_once_and_blocks_bound_it(spark, words, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    texts = {i: words(5 + i % 9) for i in range(60)} | {60: None}
    seen = spark.sparkContext.accumulator(0)

    def noted(text, stopwords):
        @F.udf("string")
        def same(x):
            seen.add(1)
            return x

        return rt.tokens(same(text), stopwords)

    monkeypatch.setattr(text_index, "tokens", noted)
    index = TextIndex.create(spark.createDataFrame([], CHUNK), new_path(spark, "test-index"), ())
    index.add(spark.createDataFrame(list(texts.items()), CHUNK))
    index.remove(spark.createDataFrame([(3,)], "chunk_id long"))
    index.compact()
    index.terms().collect()
    assert seen.value == 61
    at = {r["chunk_id"]: r["block"] for r in spark.read.parquet(f"{index.path}/chunks/version=1").collect()}
    want = {}
    for i, body in texts.items():
        for t, n in Counter((body or "").split()).items():
            tf, length, df, total = want.get((t, at[i]), (0, 99, 0, 0))
            size = len(body.split())
            want[t, at[i]] = (max(tf, n), min(length, size), df + 1, total + size)
    whole = spark.read.parquet(f"{index.path}/blocks/version=1").groupBy("term", "block").agg(F.max("max_tf"), F.min("min_length"), F.sum("df"), F.sum("total"))
    assert {tuple(r)[:2]: tuple(r)[2:] for r in whole.collect()} == want


def test_search_of_versions_gives_on_no_row_for_each_pair(spark, words):
    texts = {i: "w0 " + words(20) for i in range(400)}
    queries = spark.createDataFrame([(i, f"w0 w1 w{i}") for i in range(40)], QUERY)
    index = TextIndex.create(spark.createDataFrame([], CHUNK), new_path(spark, "test-index"), ())
    index.add(spark.createDataFrame(list(texts.items()), CHUNK))
    found = index.search(queries, 6)
    assert rows(found) == rows(rt.bm25(spark.createDataFrame(list(texts.items()), CHUNK), queries, 6, ()))
    assert most_rows(found) < 400 * 40 / 4


def test_an_interrupted_change_is_not_seen(spark, words, monkeypatch):
    index = TextIndex.create(spark.createDataFrame([], CHUNK), new_path(spark, "test-index"), ())
    queries = spark.createDataFrame([(1, "w1 w2")], QUERY)
    index.add(spark.createDataFrame([(i, words(9)) for i in range(20)], CHUNK))
    before = rows(index.search(queries, 5))
    write = TextIndex._write

    def fails(self, name, version, df):
        if name == "log":
            raise OSError("lost")
        write(self, name, version, df)

    monkeypatch.setattr(TextIndex, "_write", fails)
    with pytest.raises(OSError):
        index.add(spark.createDataFrame([(i, "w1 w1 w2") for i in range(10, 30)], CHUNK))
    monkeypatch.undo()
    assert rows(index.search(queries, 5)) == before
    index.remove(spark.createDataFrame([(0,)], "chunk_id long"))
    assert {r[2] for r in rows(index.search(queries, 50))} <= set(range(1, 20))


def test_tokens_by_hand(spark):
    df = spark.createDataFrame([("Что сказано о выручке? и А то_то x ab abcdef_1 что-то",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(rt.tokens(df.t)).collect()]
    assert got == [["выруч", "то_то", "ab", "abcde"], [], None]
    assert df.select(rt.tokens(df.t, ())).first()[0] == ["что", "сказа", "выруч", "то_то", "ab", "abcde", "что", "то"]


def test_words_are_counted_without_a_shuffle(spark, words):
    texts = {i: words(1 + i % 30) for i in range(40)} | {40: "", 41: None}
    chunks = spark.createDataFrame(list(texts.items()), CHUNK)
    found = rt.postings(chunks, ())
    want = {(t, i, n, len(b.split())) for i, b in texts.items() for t, n in Counter((b or "").split()).items()}
    assert {tuple(r) for r in found.collect()} == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    twice = rt.postings(spark.createDataFrame([(1, "ab ab cd"), (1, "ab")], CHUNK), (), every=True)
    assert {(r["term"], r["chunk_id"], r["tf"]) for r in twice.collect()} == {("ab", 1, 3), ("cd", 1, 1), ("", 1, 1)}
    none = rt.postings(spark.createDataFrame([(1, "ab"), (2, None)], CHUNK), (), spark.createDataFrame([("cd",)], "term string"), every=True)
    assert {(r["term"], r["chunk_id"], r["length"]) for r in none.collect()} == {("", 1, 1), ("", 2, 1)}


def test_search_gives_on_no_row_for_each_pair(spark, words):
    texts = {i: "w0 " + words(2 + i % 25) for i in range(600)} | {600: "", 601: None, 602: "w1 w1"}
    chunks = spark.createDataFrame([*texts.items(), *((i, "w0 w5") for i in range(700, 760))], CHUNK).repartition(3)
    queries = spark.createDataFrame([(i, f"w0 w{i} w{i} w{i + 7}") for i in range(40)] + [(99, "absent")], QUERY)
    p, asked = rt.postings(chunks, (), every=True), rt.asked_terms(queries, ())
    n, mean = p.where("term = ''").agg(F.count("*"), F.avg("length")).first()
    df = p.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    score = F.col("qtf") * F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("length") / mean))
    want = rt.top(p.join(asked, "term").join(df, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(score), 9).alias("score")), 6)
    found = rt.bm25(chunks, queries, 6, ())
    assert rows(found) == rows(want)
    assert most_rows(found) < 662 * 40 / 4
    shared = rt.top(p.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.count("*").alias("score")), 6)
    assert rows(rt.by_shared_words(queries, rt.index(chunks, asked, ()), 6, ())) == rows(shared)
    assert rows(rt.bm25(chunks.limit(0), queries, 6, ())) == [] == rows(rt.bm25(chunks, queries.limit(0), 6, ()))


def test_many_queries_have_no_bounds_and_the_same_rows(spark, monkeypatch):
    """A row for each query and block is made for few queries only."""
    chunks = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} w{i % 13} common") for i in range(200)], CHUNK)
    index = TextIndex.create(chunks, new_path(spark, "test-index"), ())
    index.add(chunks)
    index.remove(chunks.where("chunk_id % 5 = 0"))
    queries = spark.createDataFrame([(q, f"w{q % 7} w{q % 13} common") for q in range(text_index.BOUNDED + 8)], QUERY)
    monkeypatch.setattr(text_index, "BOUNDED", 10**9)
    few = rows(index.search(queries, 5))
    monkeypatch.undo()
    monkeypatch.setattr(TextIndex, "_bounded", lambda *_: pytest.fail("bounds of many queries"))
    assert rows(index.search(queries, 5)) == few and len(few) == 5 * (text_index.BOUNDED + 8)
