"""Queries of resolution, grounding and guarded SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators import grounding, resolve, store
from ledgermill.plans import dispatch, sqlguard
from ledgermill.plans.testdata import FACTS_SQL, ORG, UID, facts, oracle, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ASK = "SELECT year(f.period_end) AS y, count(*) AS n, round(CAST(sum(f.value) AS DOUBLE), 4) AS total FROM facts_visible f JOIN metrics m ON m.name = f.metric WHERE f.variant = 'fact' GROUP BY year(f.period_end) ORDER BY y"


@query(f"WITH {FACTS_SQL}, facts_visible AS (SELECT * FROM facts WHERE org_id = {ORG} AND (NOT is_private OR uploaded_by = {UID}) AND NOT superseded), metrics AS (SELECT DISTINCT metric AS name, parent FROM facts) SELECT CAST(y AS INTEGER) AS y, n, total FROM ({ASK} LIMIT 100)")
def text_to_sql_guarded(spark, sf) -> DataFrame:
    base = facts(spark, sf)
    rows = sqlguard.run(spark, ASK, store.visible(base, ORG, UID), base.select(F.col("metric").alias("name"), "parent").distinct())
    return spark.createDataFrame(rows.collect(), rows.schema)  # a report of at most 100 rows, back in the caller's session


@query("""WITH a AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS yr, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS v FROM orders GROUP BY 1),
 n AS (SELECT o_orderkey AS answer_id, o_totalprice * 100 AS said, CAST(year(o_orderdate) AS VARCHAR) AS yr FROM orders)
 SELECT answer_id, EXISTS (SELECT 1 FROM a WHERE abs(said - v) <= greatest(abs(v) * 0.005, 0.011) OR abs(said * 1e3 - v) <= greatest(abs(v) * 0.005, 0.011) OR abs(said * 1e6 - v) <= greatest(abs(v) * 0.005, 0.011) OR abs(said * 1e9 - v) <= greatest(abs(v) * 0.005, 0.011)) AS known FROM n""")
def tolerance_match(spark, sf) -> DataFrame:
    """Amounts held against the yearly totals, in any scale; the totals are one array of a few rows."""
    o = table(spark, sf, "orders")
    totals = o.groupBy(F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(28,6)")).cast("double").alias("v")).agg(F.collect_list("v").alias("all"))
    said = o.select(F.col("o_orderkey").alias("answer_id"), (F.col("o_totalprice") * 100).alias("said"))
    return said.crossJoin(F.broadcast(totals)).select("answer_id", F.exists("all", lambda v: grounding.same_amount(F.col("said"), v)).alias("known"))


@query("SELECT o_orderkey AS answer_id, CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 0 THEN true ELSE false END AS ok, CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS n_foreign, CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END AS n_wrong_year FROM orders")
def verify_answers(spark, sf) -> DataFrame:
    """Answers that say an order's amount rightly, wrongly, or of the wrong year."""
    o = table(spark, sf, "orders")
    p, y = (F.col("o_orderkey") % 9000 + 1000) * 7919.0, F.lit("1999")
    said = lambda amount, year: F.concat(F.lit("Выручка за "), year, F.lit(": "), F.format_string("%.2f", amount), F.lit(" руб"))
    answer = F.when(F.col("o_orderkey") % 3 == 0, said(p, y)).when(F.col("o_orderkey") % 3 == 1, said(p * 1.37, y)).otherwise(said(p, F.lit("1998")))
    history = F.array(F.struct(y.alias("year"), p.alias("value")), F.struct(F.lit("1998").alias("year"), (p * 3).alias("value")))
    allowed = F.transform(history, lambda h: F.struct(h["value"].alias("value"), F.lit("₽").alias("unit")))
    rows = o.select(F.col("o_orderkey").alias("answer_id"), answer.alias("answer"), F.lit("").alias("template"), allowed.alias("allowed"), history.alias("history"))
    return grounding.review(rows).select("answer_id", "ok", F.size("foreign").alias("n_foreign"), F.size("misattributed").alias("n_wrong_year"))


@query("SELECT p_partkey AS query_id, min(p_partkey) OVER (PARTITION BY lower(trim(p_name))) AS metric_id FROM part")
def resolve_exact(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    metrics = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("metric_id"), F.lit("other").alias("kind"))
    none = metrics.limit(0).select("metric_id", F.col("name").alias("text"))
    asked = part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("metric_query"))
    return resolve.exact(asked, resolve.entries(metrics, none))


_ASKED = "lower('how much ' || p_name || ' ' || p_type)"


@query(f"""WITH d AS (SELECT name, min(metric_id) AS metric_id, any_value(ws) AS ws, replace(lower(name), ' ', '') AS g FROM (SELECT p_name AS name, p_partkey AS metric_id, list_distinct(list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 1), lambda w: w[1:5])) AS ws FROM part) GROUP BY name),
q AS (SELECT p_partkey AS query_id, list_transform(string_split({_ASKED}, ' '), lambda w: w[1:5]) AS ts, replace({_ASKED}, ' ', '') AS g FROM part)
SELECT query_id, metric_id, name FROM q, d WHERE (len(list_filter(d.ws, lambda w: len(list_filter(q.ts, lambda t: t = w OR (length(w) < 5 AND starts_with(t, w)))) > 0)) = len(d.ws)) OR (length(d.g) >= 4 AND contains(q.g, d.g))
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(d.ws) DESC, name) = 1""")
def resolve_lexical(spark, sf) -> DataFrame:
    """Questions about parts, by name and type, against the parts' names as a dictionary."""
    part = table(spark, sf, "part")
    metrics = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("metric_id"), F.lit("other").alias("kind"))
    none = metrics.limit(0).select("metric_id", F.col("name").alias("text"))
    asked = part.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", F.lit("how much"), "p_name", "p_type").alias("metric_query"))
    return resolve.lexical(asked, resolve.entries(metrics, none), ())


@query(oracle("""SELECT metric || CASE k WHEN 0 THEN '?2000' ELSE '?' END AS query_id, metric, 0 AS step, round(CAST(sum(value) AS DOUBLE), 4) AS total, count(*) AS periods
 FROM series, (VALUES (0), (1)) t(k) WHERE k = 1 OR year(period_start) = 2000 GROUP BY ALL"""))
def questions_to_totals(spark, sf) -> DataFrame:
    """Two questions about every metric, from their words to the figures: intent, years and metric come from the text."""
    base = facts(spark, sf)
    metrics = base.select("metric").distinct()
    ids = metrics.select(F.col("metric").alias("name"), F.xxhash64("metric").alias("metric_id"), F.lit("other").alias("kind"))
    none = ids.limit(0).select("metric_id", F.col("name").alias("text"))
    text = F.concat(F.lit("Сколько всего "), "metric", F.when(F.col("k") == 0, " за 2000 год?").otherwise("?"))
    asked = metrics.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.concat("metric", F.when(F.col("k") == 0, "?2000").otherwise("?")).alias("query_id"), text.alias("text"))
    got = dispatch.answer_factual(asked, base, resolve.entries(ids, none), ORG, UID)
    return got.select("query_id", "metric", "step", F.round(F.col("total").cast("double"), 4).alias("total"), "periods")


HINTS = "h AS (SELECT p_partkey AS metric_id, p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey // 10)::VARCHAR WHEN p_partkey % 7 = 0 THEN 'раздел ' || p_partkey END AS section, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey // 2)::VARCHAR END AS parent_hint FROM part)"


@query(f"WITH {HINTS} SELECT h.metric_id, coalesce(s.metric_id, p.metric_id) AS parent_id FROM h LEFT JOIN h s ON s.name = h.section LEFT JOIN h p ON p.name = h.parent_hint WHERE coalesce(s.metric_id, p.metric_id) <> h.metric_id")
def link_sections(spark, sf) -> DataFrame:
    """Parents of metrics from the section and the hint that their facts carry."""
    k = F.col("p_partkey")
    scanned = table(spark, sf, "part").select(
        k.cast("string").alias("metric"), F.when(k % 3 == 0, F.floor(k / 10).cast("string")).when(k % 7 == 0, F.concat(F.lit("раздел "), k.cast("string"))).alias("section"),
        F.when(k % 2 == 0, F.floor(k / 2).cast("string")).alias("parent_hint"), F.lit("A1").alias("cell_ref"),
    )
    dictionary = table(spark, sf, "part").select(k.alias("metric_id"), k.cast("string").alias("name"))
    return resolve.link_hierarchy(scanned, dictionary).select("metric_id", "parent_id")
