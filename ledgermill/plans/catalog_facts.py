"""Queries over the fact store and its analytic operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators import analytics as an
from ledgermill.operators import store
from ledgermill.plans.testdata import FACTS_SQL, ORG, UID, facts, oracle, series, series_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def num(c, digits: int = 4):
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def n(sql: str, alias: str, digits: int = 4) -> str:
    return f"round(CAST({sql} AS DOUBLE), {digits}) AS {alias}"


@query(oracle(f"SELECT metric, period_label, period_end, document_id, {n('value', 'value')} FROM series"))
def series_latest_wins(spark, sf) -> DataFrame:
    return series(spark, sf).select("metric", "period_label", "period_end", "document_id", num("value").alias("value"))


@query(oracle(f"SELECT org_id, variant, needs_review, count(*) AS facts, count(DISTINCT document_id) AS documents, {n('sum(value)', 'value')} FROM facts WHERE (NOT is_private OR uploaded_by = {UID}) AND NOT superseded GROUP BY ALL"))
def visible_facts_acl(spark, sf) -> DataFrame:
    rows = store.visible(facts(spark, sf), uid=UID)
    return rows.groupBy("org_id", "variant", "needs_review").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("document_id").alias("documents"), num(F.sum("value")).alias("value"))


@query(oracle(f"SELECT org_id, count(*) AS facts, {n('sum(value)', 'value')} FROM facts WHERE NOT is_private AND NOT superseded AND NOT needs_review GROUP BY ALL"))
def visible_facts_shared_reviewed(spark, sf) -> DataFrame:
    return store.reviewed(store.visible(facts(spark, sf))).groupBy("org_id").agg(F.count(F.lit(1)).alias("facts"), num(F.sum("value")).alias("value"))


@query(oracle(f"SELECT metric, period_label, {n('value', 'value')} FROM series WHERE year(period_start) IN (1996, 1999)"))
def year_overlap_filter(spark, sf) -> DataFrame:
    return store.in_years(series(spark, sf), (1996, 1999)).select("metric", "period_label", num("value").alias("value"))


@query(oracle(f"SELECT metric, period_label, {n('value', 'value')} FROM series WHERE month(period_start) IN (1, 6)"))
def month_filter(spark, sf) -> DataFrame:
    return store.in_months(series(spark, sf), (1, 6)).select("metric", "period_label", num("value").alias("value"))


@query(oracle(f"SELECT metric, period_label, period_start, period_end, months, {n('value', 'value')} FROM years"))
def yearly_rollup(spark, sf) -> DataFrame:
    return an.yearly(series(spark, sf)).select("metric", "period_label", "period_start", "period_end", "months", num("value").alias("value"))


@query(oracle(f"SELECT metric, {n('sum(value)', 'total')}, count(*) AS periods, min(period_start) AS since, max(period_end) AS until FROM series GROUP BY metric"))
def factual_total(spark, sf) -> DataFrame:
    return an.total(series(spark, sf)).select("metric", num("total").alias("total"), "periods", "since", "until")


@query(oracle(f"""SELECT s.metric, s.parent, s.period_label, {n('s.value', 'value')}, {n('p.v', 'parent_value')}, round(100 * CAST(s.value AS DOUBLE) / nullif(CAST(p.v AS DOUBLE), 0), 6) AS share_pct
 FROM series s JOIN (SELECT parent, period_end, CAST(sum(value) AS DECIMAL(28,6)) AS v FROM series GROUP BY ALL) p ON p.parent = s.parent AND p.period_end = s.period_end"""))
def factual_share_in_parent(spark, sf) -> DataFrame:
    rows = series(spark, sf)
    parents = an.roll_up(rows).withColumn("parent", F.lit(None).cast("string"))
    cols = ["metric", "parent", "period_type", "period_label", "period_end", "value"]
    return an.share_in_parent(rows.select(cols).unionByName(parents.select(cols))).where("parent is not null").select("metric", "parent", "period_label", num("value").alias("value"), num("parent_value").alias("parent_value"), num("share_pct", 6).alias("share_pct"))


@query(oracle(f"""SELECT a.metric, {n('a.value', 'first_value')}, {n('b.value', 'last_value')}, {n('b.value - a.value', 'abs_change')}, round(100 * CAST(b.value - a.value AS DOUBLE) / nullif(CAST(a.value AS DOUBLE), 0), 6) AS change_pct
 FROM years a JOIN years b ON a.metric = b.metric WHERE year(a.period_end) = 1996 AND year(b.period_end) = 1999"""))
def compare_periods(spark, sf) -> DataFrame:
    return an.compare_years(an.yearly(series(spark, sf)), 1996, 1999).select("metric", num("first_value").alias("first_value"), num("last_value").alias("last_value"), num("abs_change").alias("abs_change"), num("change_pct", 6).alias("change_pct"))


@query(oracle(f"""SELECT metric, period_label, {n('value', 'value')}, {n('previous', 'previous')}, round(100 * CAST(value - previous AS DOUBLE) / nullif(CAST(previous AS DOUBLE), 0), 6) AS change_pct
 FROM (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY period_end) AS previous FROM years WHERE months >= 1) WHERE previous IS NOT NULL"""))
def compare_lag(spark, sf) -> DataFrame:
    return an.compare_previous(an.yearly(series(spark, sf)), complete_only=False).select("metric", "period_label", num("value").alias("value"), num("previous").alias("previous"), num("change_pct", 6).alias("change_pct"))


PLAN_FACT = """, pf AS (
 SELECT metric, period_end, max(value) FILTER (variant = 'plan') AS plan, max(value) FILTER (variant = 'fact') AS fact FROM both_ GROUP BY ALL HAVING plan IS NOT NULL AND fact IS NOT NULL)"""


ENDS = """pts AS (SELECT *, count(*) FILTER (months = 12) OVER (PARTITION BY metric) AS f, count(*) OVER (PARTITION BY metric) AS n, row_number() OVER (PARTITION BY metric ORDER BY period_end) AS k, row_number() OVER (PARTITION BY metric, months = 12 ORDER BY period_end DESC) AS r FROM years),
a AS (SELECT * FROM pts WHERE n >= 2 AND CASE WHEN f >= 2 THEN months = 12 AND r = 2 ELSE k = 1 END), b AS (SELECT * FROM pts WHERE n >= 2 AND CASE WHEN f >= 2 THEN months = 12 AND r = 1 ELSE k = n END)"""


@query(oracle(f"SELECT metric, a.period_label AS label_from, b.period_label AS label_to, {n('b.value - a.value', 'abs_change')}, round(100 * CAST(b.value - a.value AS DOUBLE) / nullif(CAST(a.value AS DOUBLE), 0), 6) AS change_pct FROM a JOIN b USING (metric)", ENDS))
def compare_latest(spark, sf) -> DataFrame:
    return an.compare_latest(an.yearly(series(spark, sf))).select("metric", "label_from", "label_to", num("abs_change").alias("abs_change"), F.round("change_pct", 6).alias("change_pct"))


@query(oracle(f"SELECT metric, {n('value', 'value')}, {n('previous', 'previous')} FROM (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY period_end) AS previous FROM years) WHERE previous IS NOT NULL AND year(period_end) = 1999"))
def compare_year(spark, sf) -> DataFrame:
    return an.compare_year(an.yearly(series(spark, sf)), 1999).select("metric", num("value").alias("value"), num("previous").alias("previous"))


@query(oracle("""SELECT asked, parent, count(*) AS items, max_by(metric, (value, metric)) AS "first" FROM (SELECT m.metric AS asked, x.parent, x.metric, x.value, row_number() OVER (PARTITION BY m.metric ORDER BY x.value DESC, x.metric) AS r
 FROM (SELECT DISTINCT metric, parent FROM series UNION SELECT DISTINCT parent, CAST(NULL AS VARCHAR) FROM series) m JOIN last x ON x.parent = coalesce(m.parent, m.metric)) WHERE r <= 12 GROUP BY ALL""",
 "cover AS (SELECT parent, period_end, count(DISTINCT metric) AS n FROM series GROUP BY ALL), whole AS (SELECT parent, count(DISTINCT metric) AS n FROM series GROUP BY ALL), ends AS (SELECT parent, max(period_end) AS period_end FROM cover JOIN whole USING (parent) WHERE cover.n >= least(2, whole.n) GROUP BY parent), last AS (SELECT parent, metric, sum(value) AS value FROM series JOIN ends USING (parent, period_end) GROUP BY ALL)"))
def breakdown_of_any(spark, sf) -> DataFrame:
    """A leaf asked for its parts gives those of its parent, with itself among them."""
    s = series(spark, sf)
    asked = s.select("metric", "parent").union(s.select(F.col("parent").alias("metric"), F.lit(None).cast("string"))).distinct()
    return an.breakdown_of(asked, s).groupBy("asked", "parent").agg(F.count(F.lit(1)).alias("items"), F.min_by("metric", "rank").alias("first"))


@query(oracle(
    f"SELECT metric, period_end, {n('plan', 'plan')}, {n('fact', 'fact')}, {n('fact - plan', 'deviation')}, round(100 * CAST(fact - plan AS DOUBLE) / nullif(CAST(plan AS DOUBLE), 0), 6) AS deviation_pct FROM pf QUALIFY row_number() OVER (PARTITION BY metric ORDER BY period_end DESC) = 1",
    series_sql("plan", "planned"), "both_ AS (SELECT * FROM series UNION ALL SELECT * FROM planned)" + PLAN_FACT,
))
def plan_fact_variance(spark, sf) -> DataFrame:
    base = store.latest_wins(store.visible(facts(spark, sf), ORG, UID).where(F.col("variant").isin("plan", "fact")))
    return an.plan_fact(base).select("metric", "period_end", num("plan").alias("plan"), num("fact").alias("fact"), num("deviation").alias("deviation"), num("deviation_pct", 6).alias("deviation_pct"))


@query(oracle(f"""SELECT parent, metric, period_end, {n('value', 'value')}, {n('total', 'total')}, round(100 * CAST(value AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 6) AS share_pct, rank FROM (
  SELECT *, sum(value) OVER (PARTITION BY parent) AS total, CAST(row_number() OVER (PARTITION BY parent ORDER BY value DESC, metric) AS INTEGER) AS rank FROM (
   SELECT s.parent, s.metric, s.period_end, sum(s.value) AS value FROM series s JOIN (
    SELECT c.parent, max(c.period_end) AS period_end FROM (SELECT parent, period_end, count(DISTINCT metric) AS n FROM series GROUP BY ALL) c
    JOIN (SELECT parent, count(DISTINCT metric) AS a FROM series GROUP BY ALL) k USING (parent) WHERE n >= least(2, a) GROUP BY c.parent) t
   ON t.parent = s.parent AND t.period_end = s.period_end GROUP BY ALL)) WHERE rank <= 12"""))
def breakdown_share_topk(spark, sf) -> DataFrame:
    return an.breakdown(series(spark, sf)).select("parent", "metric", "period_end", num("value").alias("value"), num("total").alias("total"), num("share_pct", 6).alias("share_pct"), "rank")


@query(oracle("""SELECT metric, label_from, label_to, round(growth, 6) AS growth_pct FROM (
 SELECT metric, min_by(period_label, period_end) AS label_from, max_by(period_label, period_end) AS label_to, count(*) AS k,
  100 * CAST(max_by(value, period_end) - min_by(value, period_end) AS DOUBLE) / nullif(abs(CAST(min_by(value, period_end) AS DOUBLE)), 0) AS growth
 FROM (SELECT *, count(*) FILTER (months = 12) OVER (PARTITION BY metric) AS f FROM years) WHERE f < 2 OR months = 12 GROUP BY metric) WHERE k >= 2 AND growth IS NOT NULL ORDER BY growth DESC, metric LIMIT 10"""))
def growth_rank(spark, sf) -> DataFrame:
    return an.growth_rank(an.yearly(series(spark, sf))).select("metric", "label_from", "label_to", num("growth_pct", 6).alias("growth_pct"))


@query(oracle(f"""SELECT metric, period_label, {n('value', 'value')}, round(100 * CAST(value AS DOUBLE) / CAST(t AS DOUBLE), 6) AS share_pct, rank FROM (
 SELECT *, sum(value) OVER (PARTITION BY metric) AS t, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, period_end) AS INTEGER) AS rank FROM series) WHERE rank <= 12"""))
def month_rank(spark, sf) -> DataFrame:
    return an.month_rank(series(spark, sf)).select("metric", "period_label", num("value").alias("value"), num("share_pct", 6).alias("share_pct"), "rank")


TYPES = "types AS (SELECT parent AS metric, period_type, period_end, CAST(sum(value) AS DECIMAL(28,6)) AS value FROM series GROUP BY ALL), two AS (SELECT min(metric) AS l, max(metric) AS r FROM types)"


@query(oracle(f"""SELECT a.period_end, {n('a.value', 'a')}, {n('b.value', 'b')}, {n('a.value - b.value', 'difference')}, round(100 * CAST(a.value - b.value AS DOUBLE) / nullif(CAST(b.value AS DOUBLE), 0), 6) AS pct_of_b, round(CAST(a.value AS DOUBLE) / nullif(CAST(b.value AS DOUBLE), 0), 6) AS ratio
 FROM types a JOIN types b USING (period_end) WHERE a.metric = (SELECT l FROM two) AND b.metric = (SELECT r FROM two) ORDER BY 1 DESC LIMIT 1""", TYPES))
def compare_two_metrics(spark, sf) -> DataFrame:
    rows = an.roll_up(series(spark, sf))
    left, right = rows.agg(F.min("metric"), F.max("metric")).first()
    return an.compare_two(rows, left, right).select("period_end", num("a").alias("a"), num("b").alias("b"), num("difference").alias("difference"), num("pct_of_b", 6).alias("pct_of_b"), num("ratio", 6).alias("ratio"))


@query(oracle(f"""SELECT y.metric, y.period_label, {n('y.value', 'value')}, {n('o.v', 'other')} FROM years y JOIN (
 SELECT p_type || '/' || p_brand AS metric, year(o_orderdate) AS y, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DECIMAL(28,6)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) o
 ON o.metric = y.metric AND o.y = year(y.period_start)"""))
def align_month_to_year(spark, sf) -> DataFrame:
    quantity = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    quantity = quantity.groupBy(F.concat_ws("/", "p_type", "p_brand").alias("metric"), F.year("o_orderdate").alias("y")).agg(F.sum(F.col("l_quantity").cast("decimal(28,6)")).cast("decimal(28,6)").alias("value"))
    by_year = quantity.select("metric", F.lit("year").alias("period_type"), F.col("y").cast("string").alias("period_label"), F.make_date("y", F.lit(1), F.lit(1)).alias("period_start"), F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"), "value")
    a, b = an.align_to_years(series(spark, sf), by_year)
    return a.join(b.select("metric", "period_end", F.col("value").alias("other")), ["metric", "period_end"]).select("metric", "period_label", num("value").alias("value"), num("other").alias("other"))


@query(oracle(f"""SELECT metric, {n('first', 'first')}, {n('last', 'last')}, n, round(mg, 6) AS mean_growth_pct,
  round(CASE WHEN first > 0 AND last > 0 AND n > 1 AND gap > 0 THEN (pow(CAST(last AS DOUBLE) / CAST(first AS DOUBLE), 1 / (gap * (n - 1) / 365.25)) - 1) * 100 END, 6) AS cagr_pct FROM (
 SELECT metric, min_by(value, period_end) AS first, max_by(value, period_end) AS last, count(*) AS n, avg(g) * 100 AS mg, median(gap) AS gap FROM (
  SELECT *, CAST(value AS DOUBLE) / nullif(CAST(lag(value) OVER w AS DOUBLE), 0) - 1 AS g, date_diff('day', lag(period_end) OVER w, period_end) AS gap FROM years WINDOW w AS (PARTITION BY metric ORDER BY period_end)) GROUP BY metric)"""))
def metric_stats_cagr(spark, sf) -> DataFrame:
    return an.growth_stats(an.yearly(series(spark, sf))).select("metric", num("first").alias("first"), num("last").alias("last"), "n", num("mean_growth_pct", 6).alias("mean_growth_pct"), num("cagr_pct", 6).alias("cagr_pct"))


@query(oracle(f"SELECT metric, period_label, {n('sum(value) OVER w', 'trailing')}, count(*) OVER w AS covered FROM series WINDOW w AS (PARTITION BY metric ORDER BY period_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"))
def trailing_12m(spark, sf) -> DataFrame:
    return an.trailing(series(spark, sf)).select("metric", "period_label", num("trailing").alias("trailing"), "covered")


@query(oracle("SELECT metric, period_type, n FROM (SELECT metric, period_type, count(*) AS n, row_number() OVER (PARTITION BY metric ORDER BY count(*) DESC, min(period_end), period_type) AS r FROM (SELECT metric, 'month' AS period_type, period_end FROM series UNION ALL SELECT metric, 'year', period_end FROM years) GROUP BY metric, period_type) WHERE r = 1"))
def dominant_period(spark, sf) -> DataFrame:
    rows = series(spark, sf)
    years = an.yearly(rows).select("metric", "period_type", "period_end")
    return an.dominant_type(rows.select("metric", "period_type", "period_end").unionByName(years))


@query(oracle(f"""SELECT s.parent, s.period_end, {n('t.total', 'total')}, {n('s.v', 'children_sum')}, s.c AS children, round(abs(CAST(s.v - t.total AS DOUBLE) / nullif(CAST(t.total AS DOUBLE), 0)) * 100, 6) AS gap_pct FROM (
 SELECT parent, period_end, CAST(sum(value) AS DECIMAL(28,6)) AS v, count(*) AS c FROM series GROUP BY ALL) s JOIN (
 SELECT parent, period_end, CAST(sum(value) AS DECIMAL(28,6)) AS total FROM facts WHERE org_id = {ORG} AND variant = 'fact' GROUP BY ALL) t USING (parent, period_end)
 WHERE abs(CAST(s.v - t.total AS DOUBLE) / nullif(CAST(t.total AS DOUBLE), 0)) * 100 > 2.0"""))
def totals_reconciliation(spark, sf) -> DataFrame:
    totals = an.roll_up(store.of_variant(facts(spark, sf).where(F.col("org_id") == ORG), "fact"))
    return an.reconcile(series(spark, sf), totals).select("parent", "period_end", num("total").alias("total"), num("children_sum").alias("children_sum"), "children", num("gap_pct", 6).alias("gap_pct"))


@query(oracle(f"""SELECT f.org_id, f.metric, f.document_id, f.period_end, f.variant, {n('f.value', 'value')}, round(m, 4) AS median FROM facts f JOIN (SELECT metric, median(CAST(value AS DOUBLE)) AS m FROM facts GROUP BY metric) USING (metric)
 WHERE CAST(f.value AS DOUBLE) / nullif(m, 0) > 4 OR CAST(f.value AS DOUBLE) / nullif(m, 0) < 0.05"""))
def scale_suspects(spark, sf) -> DataFrame:
    return an.scale_suspects(facts(spark, sf), high=4.0, low=0.05).select("org_id", "metric", "document_id", "period_end", "variant", num("value").alias("value"), num("median").alias("median"))


@query(oracle(f"""SELECT document_id, kind, metric, period_end, {n('value', 'value')}, rank FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY document_id, kind ORDER BY abs(value) DESC, metric) AS INTEGER) AS rank FROM (
  SELECT document_id, metric, split_part(metric, '/', 1) AS kind, max_by(value, period_end) AS value, max(period_end) AS period_end FROM series GROUP BY ALL)) WHERE rank <= 10"""))
def doc_summary_latest(spark, sf) -> DataFrame:
    return an.document_summary(series(spark, sf), F.split_part("metric", F.lit("/"), F.lit(1))).select("document_id", "kind", "metric", "period_end", num("value").alias("value"), "rank")


@query(oracle(f"SELECT metric, max_by(period_label, period_end) AS label, {n('max_by(value, period_end)', 'value')}, count(*) AS periods FROM series GROUP BY metric ORDER BY metric LIMIT 30"))
def digest_last_values(spark, sf) -> DataFrame:
    return an.last_values(series(spark, sf)).orderBy("metric").limit(30).select("metric", "label", num("value").alias("value"), "periods")


@query(oracle("""SELECT metric, 'Показатель «' || metric || '»: ' || string_agg(period_label || ' — ' || CAST(value AS VARCHAR), '; ' ORDER BY period_end) AS body FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY period_end DESC) AS r FROM series) WHERE r <= 24 GROUP BY metric"""))
def metric_cards(spark, sf) -> DataFrame:
    return an.metric_cards(series(spark, sf))


DOCS = "docs AS (SELECT CAST(o_custkey AS BIGINT) AS document_id, CAST(o_custkey % 5 AS INTEGER) AS org_id, max(o_orderdate) AS uploaded_at, list(DISTINCT strftime(o_orderdate, '%m.%Y')) AS periods FROM orders GROUP BY o_custkey)"


@query(f"""WITH {DOCS}
 SELECT org_id, document_id, other_id, CAST(r AS INTEGER) AS rank FROM (SELECT a.org_id, a.document_id, b.document_id AS other_id, row_number() OVER (PARTITION BY a.document_id ORDER BY b.uploaded_at DESC, b.document_id DESC) AS r
  FROM docs a JOIN docs b ON a.org_id = b.org_id AND a.document_id <> b.document_id AND (b.uploaded_at, b.document_id) < (a.uploaded_at, a.document_id) AND list_has_any(a.periods, b.periods)) WHERE r <= 3""")
def supersede_candidates(spark, sf) -> DataFrame:
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("long").alias("document_id"))
    docs = rows.agg(F.max("o_orderdate").alias("uploaded_at"), F.collect_set(F.date_format("o_orderdate", "MM.yyyy")).alias("periods")).withColumn("org_id", (F.col("document_id") % 5).cast("int"))
    return store.supersede_candidates(docs)


DOCUMENTS = "docs AS (SELECT o_orderkey AS document_id, CAST(o_custkey % 3 AS INTEGER) AS org_id, o_orderdate AS uploaded_at, o_custkey % 5 AS uploaded_by, o_orderkey % 4 = 0 AS is_private, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 7 END AS superseded_by_id FROM orders)"


def documents(spark, sf) -> DataFrame:
    """Orders as uploaded documents of three organisations and five users (0 is the system)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        k.alias("document_id"), (c % 3).cast("int").alias("org_id"), F.col("o_orderdate").alias("uploaded_at"), (c % 5).alias("uploaded_by"), (k % 4 == 0).alias("is_private"), F.when(k % 7 == 0, k + 7).alias("superseded_by_id")
    )


@query(f"WITH {DOCUMENTS} SELECT document_id, uploaded_at FROM docs WHERE org_id = 1 AND (NOT is_private OR uploaded_by = 2) ORDER BY uploaded_at DESC, document_id DESC LIMIT 50")
def newest_documents(spark, sf) -> DataFrame:
    return store.newest_documents(documents(spark, sf), 1, 2).select("document_id", "uploaded_at")


@query(f"""WITH {DOCUMENTS}, l AS (SELECT d.*, g.document_id AS gone FROM docs d LEFT JOIN docs g ON g.document_id = d.superseded_by_id AND g.uploaded_by = 2 WHERE d.uploaded_by <> 2)
SELECT 'documents' AS part, org_id, count(*) AS n, count(CASE WHEN gone IS NULL THEN superseded_by_id END) AS superseded FROM l GROUP BY org_id
UNION ALL SELECT 'lines', d.org_id, count(*), 0 FROM lineitem JOIN docs d ON d.document_id = l_orderkey WHERE d.uploaded_by <> 2 GROUP BY d.org_id""")
def delete_user(spark, sf) -> DataFrame:
    """What is left of documents and lines when user 2 is deleted."""
    docs = documents(spark, sf)
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"))
    left, rest = store.delete_user(docs, {"lines": lines}, 2)
    mine = left.groupBy("org_id").agg(F.count(F.lit(1)).alias("n"), F.count("superseded_by_id").alias("superseded")).select(F.lit("documents").alias("part"), "org_id", "n", "superseded")
    kept = rest["lines"].join(docs.select("document_id", "org_id"), "document_id").groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))
    return mine.unionByName(kept.select(F.lit("lines").alias("part"), "org_id", "n", F.lit(0).cast("long").alias("superseded")))


@query("""WITH RECURSIVE used(k) AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT k // 10 FROM used WHERE k >= 10) SELECT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT k FROM used)""")
def orphans_of_a_hierarchy(spark, sf) -> DataFrame:
    """Parts under the part of a tenth of their number: those with no large line in themselves or anything below."""
    k = F.col("p_partkey")
    metrics = table(spark, sf, "part").select(k.cast("string").alias("name"), F.when(k >= 10, F.floor(k / 10).cast("string")).alias("parent"))
    used = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").cast("string").alias("metric"))
    return store.orphans(metrics, used).select(F.col("name").cast("long").alias("part"))


@query("""SELECT p_partkey AS part FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)""")
def orphans_anti(spark, sf) -> DataFrame:
    metrics = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), F.lit(None).cast("string").alias("parent"))
    used = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").cast("string").alias("metric"))
    return store.orphans(metrics, used).select(F.col("name").cast("long").alias("part"))


@query(oracle("SELECT DISTINCT s_suppkey, s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM series WHERE document_id = s_suppkey)"))
def semi_visible_docs(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").join(series(spark, sf), F.col("s_suppkey") == F.col("document_id"), "left_semi").select("s_suppkey", "s_name")


NODES = "nodes AS (SELECT DISTINCT 'all' AS name, CAST(NULL AS VARCHAR) AS parent UNION SELECT r_name, 'all' FROM region UNION SELECT 'n:' || n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT s_name, 'n:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"""WITH RECURSIVE {NODES}, t(name, root, depth, path) AS (SELECT name, name, 0, name FROM nodes WHERE parent IS NULL UNION ALL SELECT n.name, t.root, t.depth + 1, t.path || ' > ' || n.name FROM nodes n JOIN t ON n.parent = t.name)
 SELECT name, root, depth, path FROM t""")
def metric_tree_recursive(spark, sf) -> DataFrame:
    region, nation, supplier = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    nodes = (
        spark.range(1).select(F.lit("all").alias("name"), F.lit(None).cast("string").alias("parent"))
        .union(region.select("r_name", F.lit("all")))
        .union(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n:"), "n_name"), "r_name"))
        .union(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", F.concat(F.lit("n:"), "n_name")))
    )
    return store.tree(spark, nodes)


@query("""SELECT name, min(inner_) AS parent FROM (SELECT DISTINCT p_name AS name FROM part) a JOIN (SELECT DISTINCT p_type AS inner_ FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part) b ON contains(a.name, b.inner_) AND length(a.name) > length(b.inner_) GROUP BY name""")
def containment_parent(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    known = part.select(F.col("p_type").alias("name")).union(part.select(F.split_part("p_name", F.lit(" "), F.lit(1)))).distinct()
    return store.containment_parent(part.select(F.col("p_name").alias("name")).distinct(), known)


@query(f"""WITH {FACTS_SQL}, p AS (SELECT document_id AS answer_id, variant AS unit, CAST(year(period_end) AS INTEGER) AS i, CAST(sum(value) AS DOUBLE) AS value FROM facts GROUP BY ALL)
 SELECT a.answer_id, a.unit, a.i AS a_i, b.i AS b_i, round(a.value + b.value, 4) AS sum, round(a.value - b.value, 4) AS difference, round(a.value / nullif(b.value, 0), 6) AS ratio FROM p a JOIN p b ON a.answer_id = b.answer_id AND a.unit = b.unit AND a.i < b.i""")
def derived_pairs(spark, sf) -> DataFrame:
    payload = facts(spark, sf).groupBy(F.col("document_id").alias("answer_id"), F.col("variant").alias("unit"), F.year("period_end").alias("i")).agg(F.sum("value").cast("double").alias("value"))
    return an.derived_pairs(payload).select("answer_id", "unit", "a_i", "b_i", num("sum").alias("sum"), num("difference").alias("difference"), num("ratio", 6).alias("ratio"))


@query("WITH m AS (SELECT DISTINCT p_type || '/' || p_brand AS metric, p_type AS parent FROM part UNION SELECT DISTINCT p_type, CAST(NULL AS VARCHAR) FROM part) SELECT metric, parent, metric LIKE '% итого' OR EXISTS (SELECT 1 FROM m c WHERE c.parent = m.metric) AS is_aggregate FROM m")
def aggregate_marks(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    metrics = part.select(F.concat_ws("/", "p_type", "p_brand").alias("metric"), F.col("p_type").alias("parent")).union(part.select("p_type", F.lit(None).cast("string"))).distinct()
    return an.is_aggregate(metrics)


@query(oracle(f"SELECT metric, period_label, {n('value', 'value')}, 'документ ' || document_id || ' · ' || period_label AS source FROM series QUALIFY row_number() OVER (PARTITION BY metric ORDER BY period_end DESC) <= 12"))
def history_projection(spark, sf) -> DataFrame:
    return an.history(series(spark, sf)).select("metric", "period_label", num("value").alias("value"), "source")


@query(oracle("""SELECT a.period_end, round(100 * CAST(a.value AS DOUBLE) / nullif(CAST(b.value AS DOUBLE), 0), 6) AS share_pct FROM types a JOIN types b USING (period_end) WHERE a.metric = (SELECT l FROM two) AND b.metric = (SELECT r FROM two) ORDER BY 1 DESC LIMIT 1""", TYPES))
def share_query(spark, sf) -> DataFrame:
    rows = an.roll_up(series(spark, sf))
    part, whole = rows.agg(F.min("metric"), F.max("metric")).first()
    return an.share_of(rows, part, whole).select("period_end", num("share_pct", 6).alias("share_pct"))
