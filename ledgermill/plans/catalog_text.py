"""Queries of retrieval and text operators over documents, pages, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.operators import retrieval as rt
from ledgermill.operators import store
from ledgermill.operators.text_index import TextIndex
from ledgermill.plans.testdata import table
from ledgermill.shared import new_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The test texts are no Russian questions, so no stop words are taken out.
NONE: tuple[str, ...] = ()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def places(column: str, n: int):
    """Rounded as the SQL does it: scaled, to a whole number, and back; of a half, Spark's own rounding may make another last digit."""
    return (F.round(F.col(column) * 10.0**n) / 10.0**n).alias(column)


def chunks(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(None).cast("string").alias("section"), F.col("text").alias("body"))


TOKS = r"""list_transform(list_filter(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w)), lambda w: length(w) > 1), lambda w: w[1:5])"""
INDEX = f"""toks AS (SELECT doc_id, {TOKS.format('text')} AS t FROM documents), lens AS (SELECT doc_id, greatest(len(t), 1) AS dl FROM toks),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL), st AS (SELECT count(*) AS n, avg(dl) AS a FROM lens), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


@query(f"WITH {INDEX} SELECT p.term, df.df, CAST(sum(tf) AS BIGINT) AS occurrences FROM post p JOIN df USING (term) GROUP BY ALL")
def tokens_stats(spark, sf) -> DataFrame:
    return rt.postings(chunks(spark, sf), NONE).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


@query(f"WITH {INDEX} SELECT n, round(a, 6) AS avgdl FROM st")
def corpus_stats(spark, sf) -> DataFrame:
    return rt.corpus_stats(chunks(spark, sf), NONE).select("n", F.round("avgdl", 6).alias("avgdl"))


BM25 = f"""{INDEX}, q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score
 FROM q JOIN post USING (term) JOIN df USING (term) JOIN lens USING (doc_id), st GROUP BY ALL),
bmr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM bm)"""


def asked(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 12")
def bm25_topk(spark, sf) -> DataFrame:
    return rt.bm25(chunks(spark, sf), asked(spark, sf), 12, NONE).select("query_id", "chunk_id", places("score", 6), "rank")


#: The documents after the changes below: no later copies of a text; texts that are shorter than the mean also name their source.
CHANGED = "fin AS (SELECT doc_id, CASE WHEN n_chars < (SELECT avg(n_chars) FROM documents) THEN text || ' ' || source ELSE text END AS text FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text))"


def changed_index(spark, sf) -> TextIndex:
    """An index of all documents that then loses later copies, gets new texts for short documents and is compacted before the last change."""
    docs = table(spark, sf, "documents")
    index = TextIndex.create(chunks(spark, sf), new_path(spark, "text-index"), NONE)
    index.add(chunks(spark, sf))
    first = docs.groupBy("text").agg(F.min("doc_id").alias("chunk_id"))
    index.remove(chunks(spark, sf).join(first, "chunk_id", "left_anti"))
    index.compact()
    short = docs.join(docs.agg(F.avg("n_chars").alias("mean")), F.col("n_chars") < F.col("mean")).select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", "text", "source").alias("body"))
    index.add(short.join(first, "chunk_id", "left_semi"))
    return index


@query(f"WITH {CHANGED}, {BM25.replace('FROM documents', 'FROM fin')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 12")
def index_search_after_changes(spark, sf) -> DataFrame:
    """Search of an index that has seen additions, removals and replacements: the rows of one built anew."""
    return changed_index(spark, sf).search(asked(spark, sf), 12).select("query_id", "chunk_id", places("score", 6), "rank")


@query(f"WITH {CHANGED}, {INDEX.replace('FROM documents', 'FROM fin')} SELECT term, df, CAST(sum(dl) AS BIGINT) AS total FROM post JOIN df USING (term) JOIN lens USING (doc_id) GROUP BY ALL UNION ALL SELECT '', count(*), CAST(sum(dl) AS BIGINT) FROM lens")
def index_terms_after_changes(spark, sf) -> DataFrame:
    """Statistics that such an index keeps by differences: chunks per term and their length."""
    return changed_index(spark, sf).terms()


COS = """cs AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0),
csr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM cs)"""


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")


@query(f"WITH {COS} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM csr WHERE rank <= 5")
def cosine_topk(spark, sf) -> DataFrame:
    """Every hundredth vector is a query against all."""
    v = vectors(spark, sf)
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    return rt.nearest(v, q, 5).select("query_id", "chunk_id", places("score", 6), "rank")


@query(f"WITH {COS}, l AS (SELECT csr.*, label FROM csr JOIN embeddings e ON e.vec_id = chunk_id) SELECT query_id, label, count(*) AS n, round(max(score), 6) AS best FROM l WHERE rank <= 20 GROUP BY ALL")
def knn_per_label(spark, sf) -> DataFrame:
    v = vectors(spark, sf)
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    near = rt.nearest(v, q, 20).join(v.select("chunk_id", "label"), "chunk_id")
    return near.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")).withColumn("best", places("best", 6))


ALLOWED = "doc AS (SELECT *, label % 3 = 0 AS hidden, label % 5 = 1 AS old FROM embeddings), ok AS (SELECT * FROM doc WHERE NOT (hidden AND label % 2 <> 1) AND NOT old AND vec_id % 4 <> 3)"


def allowed_vectors(spark, sf) -> DataFrame:
    """The vectors that user 1 may search: documents are labels, private by threes, superseded by fives, of user label % 2."""
    v = vectors(spark, sf).withColumn("document_id", F.col("label")).withColumn("kind", F.when(F.col("chunk_id") % 4 == 3, "identifier").otherwise("text"))
    label = F.col("label")
    documents = v.select("label").distinct().select(label.alias("document_id"), (label % 3 == 0).alias("is_private"), F.when(label % 5 == 1, 0).alias("superseded_by_id"), (label % 2).alias("uploaded_by"))
    return rt.searchable(v, documents, 1, ("text",))


@query(f"WITH {ALLOWED}, {COS}, r AS (SELECT cs.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM cs JOIN ok ON ok.vec_id = chunk_id) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def knn_visible(spark, sf) -> DataFrame:
    """Nearest vectors among those that the reader may see, of current documents and of kind text."""
    q = vectors(spark, sf).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    return rt.nearest(allowed_vectors(spark, sf), q, 5).select("query_id", "chunk_id", places("score", 6), "rank")


@query(f"""WITH {ALLOWED}, {COS}, h AS (SELECT query_id, chunk_id, min_by(s, f) AS score FROM (SELECT query_id, chunk_id, score AS s, 0 AS f FROM csr JOIN embeddings e ON e.vec_id = chunk_id WHERE rank <= 10 AND label % 3 <> 0 UNION ALL SELECT query_id, chunk_id, round(score * 0.9, 9), 1 FROM csr WHERE rank <= 10) GROUP BY ALL),
r AS (SELECT h.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM h JOIN ok ON ok.vec_id = chunk_id) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def knn_mirror_merge(spark, sf) -> DataFrame:
    """Hits of a store that lacks some documents, merged with those of a mirror and checked against what may be seen."""
    v = vectors(spark, sf)
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    hits = rt.nearest(v, q, 10).select("query_id", "chunk_id", "score").join(v.select("chunk_id", "label"), "chunk_id")
    own, mirror = hits.where("label % 3 <> 0").drop("label"), hits.drop("label").withColumn("score", F.round(F.col("score") * 0.9, 9))
    return rt.merge_hits(own, mirror, allowed_vectors(spark, sf), 5).select("query_id", "chunk_id", places("score", 6), "rank")


@query("WITH d AS (SELECT DISTINCT conv_id FROM conversations WHERE NOT (conv_id % 3 = 0 AND conv_id % 2 <> 1) AND conv_id % 5 <> 1) SELECT conv_id AS document_id, role AS section, min(turn) AS turn FROM conversations JOIN d USING (conv_id) GROUP BY ALL")
def corpus_first_of_section(spark, sf) -> DataFrame:
    """The search corpus: one chunk a named section of each document that the reader may see."""
    c = table(spark, sf, "conversations").select(F.col("turn").alias("chunk_id"), F.col("conv_id").alias("document_id"), F.col("role").alias("section"), F.col("text").alias("body"))
    d = F.col("document_id")
    documents = c.select("document_id").distinct().select(d, (d % 3 == 0).alias("is_private"), F.when(d % 5 == 1, 0).alias("superseded_by_id"), (d % 2).alias("uploaded_by"))
    return rt.corpus(rt.searchable(c, documents, 1)).select("document_id", "section", F.col("chunk_id").alias("turn"))


SHARED = """sh0 AS (SELECT item_id AS query_id, doc_id AS chunk_id, count(*) AS c FROM q JOIN post USING (term) GROUP BY ALL), sh AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS INTEGER) AS rank FROM sh0 QUALIFY rank <= 12)"""


@query(f"WITH {BM25}, {SHARED}, f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, chunk_id, rank FROM bmr WHERE rank <= 12 UNION ALL SELECT query_id, chunk_id, rank FROM sh) GROUP BY ALL) SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 8")
def rrf_fusion(spark, sf) -> DataFrame:
    """BM25 fused with a list by the number of shared words."""
    c, items = chunks(spark, sf), asked(spark, sf)
    index = rt.index(c, rt.asked_terms(items, NONE), NONE)
    sparse = rt.bm25(c, items, 12, NONE, index).select("query_id", "chunk_id", "rank")
    shared = rt.by_shared_words(items, index, 12, NONE).select("query_id", "chunk_id", "rank")
    return rt.fuse(sparse.unionByName(shared), 8).select("query_id", "chunk_id", places("score", 9), "rank")


@query(f"""WITH {BM25}, c AS (SELECT query_id, chunk_id, list_distinct({TOKS.format('b.text')}) AS q, list_distinct({TOKS.format('d.text')}) AS t, b.text AS qt, d.text AS body FROM bmr JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 12),
 s AS (SELECT query_id, chunk_id, round((0.5 * len(list_intersect(q, t)) / greatest(len(q), 1) + CASE WHEN trim(qt) <> '' AND contains(lower(body), lower(trim(qt))) THEN 0.2 ELSE 0.0 END) * CASE WHEN length(body) < 100 THEN 0.7 ELSE 1.0 END, 9) AS score FROM c)
 SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 8""")
def heuristic_rerank(spark, sf) -> DataFrame:
    found = rt.bm25(chunks(spark, sf), asked(spark, sf), 12, NONE).select("query_id", "chunk_id")
    rows = found.join(asked(spark, sf).withColumnRenamed("text", "query"), "query_id").join(chunks(spark, sf).select("chunk_id", "body", "section"), "chunk_id").withColumn("semantic_score", F.lit(None).cast("double"))
    return rt.rerank(rows, 8, NONE).select("query_id", "chunk_id", places("score", 6), "rank")


HYBRID = f"""{BM25}, tk AS (SELECT 'q' AS s, item_id AS id, term, count(*) AS tf FROM (SELECT item_id, unnest({TOKS.format('text')}) AS term FROM benchmark) GROUP BY ALL UNION ALL SELECT 'd', doc_id, term, tf FROM post),
cell AS (SELECT s, id, CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) % 64 AS spot, sum(CASE WHEN CAST('0x' || h[9:10] AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(tf))) AS w FROM (SELECT *, md5(term) AS h FROM tk) GROUP BY ALL),
vec AS (SELECT s, id, spot, CAST(CAST(w / sqrt(sum(w * w) OVER (PARTITION BY s, id)) AS FLOAT) AS DOUBLE) AS x FROM cell), nrm AS (SELECT s, id, sqrt(sum(x * x)) AS n FROM vec GROUP BY ALL),
dots AS (SELECT a.id AS query_id, b.id AS chunk_id, sum(a.x * b.x) AS dot FROM vec a JOIN vec b USING (spot) WHERE a.s = 'q' AND b.s = 'd' GROUP BY ALL),
sim AS (SELECT i.item_id AS query_id, d.doc_id AS chunk_id, round(coalesce(dot / (x.n * y.n), 0), 9) AS score FROM benchmark i CROSS JOIN documents d LEFT JOIN dots ON dots.query_id = i.item_id AND dots.chunk_id = d.doc_id LEFT JOIN nrm x ON x.s = 'q' AND x.id = i.item_id LEFT JOIN nrm y ON y.s = 'd' AND y.id = d.doc_id),
simr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sim QUALIFY rank <= 24),
f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score, max(v) AS sem FROM (SELECT query_id, chunk_id, rank, NULL AS v FROM bmr WHERE rank <= 24 UNION ALL SELECT query_id, chunk_id, rank, score FROM simr) GROUP BY ALL)"""


@query(f"WITH {HYBRID} SELECT CAST(query_id AS VARCHAR) AS query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, round(sem, 6) AS semantic_score FROM f QUALIFY rank <= 8")
def hybrid_search(spark, sf) -> DataFrame:
    """Benchmark items against documents by words and by hashed vectors, fused."""
    c = chunks(spark, sf)
    vec = rt.hash_embedding(c, 64, NONE)
    items = asked(spark, sf)
    qv = rt.hash_embedding(items.select(F.col("query_id").alias("chunk_id"), F.col("text").alias("body")), 64, NONE).withColumnRenamed("chunk_id", "query_id")
    found = rt.hybrid(c, vec, items.join(qv, "query_id").withColumn("variant", F.lit(0)), 8, NONE)
    return found.select("query_id", "chunk_id", places("score", 9), "rank", places("semantic_score", 6))


@query("SELECT a.doc_id AS file_id, sha256(a.text) AS file_hash, min(b.doc_id) AS original_id FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.source = b.source GROUP BY ALL")
def dedupe_hash(spark, sf) -> DataFrame:
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("org_id"), F.col("text").alias("content"))
    return store.duplicates(files).select("file_id", "file_hash", "original_id")


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS INTEGER) AS links, array_to_string(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1), ' ') AS targets FROM pages")
def html_title_links(spark, sf) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.size(links).alias("links"), F.array_join(links, " ").alias("targets"))


@query("""WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS row, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, row, string_split(trim(line), ' ') AS cells FROM l),
 k AS (SELECT doc_id, row, len(cells) AS n FROM c WHERE len(cells) >= 2) SELECT doc_id, count(*) AS rows, CAST(max(n) AS INTEGER) AS width, CAST(sum(n) AS BIGINT) AS cells FROM k GROUP BY doc_id HAVING count(*) >= 3""")
def text_to_grid(spark, sf) -> DataFrame:
    """Lines cut into cells (here at single blanks, the test texts have no wider gaps) as a grid; fewer than three rows are none."""
    from ledgermill.sources.grids import text_grid

    rows = text_grid(table(spark, sf, "documents").select(F.col("doc_id").alias("doc_id"), "text"), gap=" ")
    return rows.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n").cast("int").alias("width"), F.sum("n").alias("cells"))


@query("UNPIVOT (SELECT l_returnflag AS flag, sum(CAST(l_quantity AS DECIMAL(28,6)))::DOUBLE AS quantity, sum(CAST(l_tax AS DECIMAL(28,6)))::DOUBLE AS tax, sum(CAST(l_discount AS DECIMAL(28,6)))::DOUBLE AS discount FROM lineitem GROUP BY 1) ON quantity, tax, discount INTO NAME metric VALUE value")
def unpivot_wide(spark, sf) -> DataFrame:
    s = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(s("l_quantity").alias("quantity"), s("l_tax").alias("tax"), s("l_discount").alias("discount"))
    return wide.unpivot("flag", ["quantity", "tax", "discount"], "metric", "value")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS remembered FROM conversations")
def dialog_memory_ffill(spark, sf) -> DataFrame:
    """What a turn remembers: the last thing the user said before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col("role") == "user", F.md5(F.col("text").cast("binary")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.last(said, ignorenulls=True).over(w).alias("remembered"))
