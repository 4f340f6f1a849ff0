import corpus_pipeline
from ledgermill.llm import decontam, jaccard, quality
from ledgermill.llm.common import id_remainder, stash, table
from ledgermill.llm.queries import QUERIES


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stash(stage(spark, seen[-1], sf), "test-stage"))
        assert set(docs.columns) <= set(seen[-1].columns), name
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen]
    model = quality.train(docs, table(spark, sf, "labels"), id_remainder("doc_id", 4) != 2)
    assert ids[1] == sorted(r["doc_id"] for r in quality.score(docs, model).where("score >= 0.7").collect())
    assert ids[2] == sorted({r["class_id"] for r in jaccard.join(seen[1]).collect()})
    leaks = {r["doc_id"] for r in decontam.find(seen[2], table(spark, sf, "benchmark")).collect()}
    assert ids[3] == [d for d in ids[2] if d not in leaks]
    assert set(ids[4]) <= set(ids[3]) and len(ids[5]) == len(ids[4])
    assert seen[4].columns == docs.columns
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == ids[5]


def test_queries_run_on_whole_tables(spark, sf):
    docs, pages = (table(spark, sf, t).count() for t in ("documents", "pages"))
    for name, query in QUERIES.items():
        n = query(spark, sf).count()
        assert n == (pages if name in ("op5_warc", "op6_html_text") else n if name.startswith("op9") else docs), name


def test_stages_on_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    """Nulls in every column, repeated rows and ids, empty and very long texts, other columns; and no rows at all."""
    for docs in (odd_docs, no_docs):
        columns, before = docs.columns, docs.count()
        for (name, stage), most in zip(corpus_pipeline.STAGES, (before, before, before, 2 * before, 2 * before), strict=True):
            docs = stash(stage(spark, docs, sf), "test-stage")
            assert docs.count() <= most, name
            assert docs.columns == columns if name != "sharding" else set(columns) <= set(docs.columns), name


def test_near_duplicates_of_repeated_ids_keep_one_row_a_text(spark, odd_docs):
    kept = corpus_pipeline.near_duplicate_stage(spark, odd_docs, "")
    rows = [r.asDict() for r in kept.collect()]
    assert len([r for r in rows if r["doc_id"] is not None]) == len({r["text"] for r in rows if r["doc_id"] is not None})
