"""The relational test tables bound to the fact model, in Spark and as SQL text for the oracle.

A metric is type/brand of a part, a fact its monthly revenue per supplier; the supplier stands for the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.operators import store

ORG, UID = 1, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly facts per (metric, document, variant).

    The two large tables meet on the order key; part, supplier and nation are joined by size (Spark broadcasts what is
    small enough and shuffles otherwise).
    """
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("decimal(28,6)").alias("v"))
    orders = t("orders").select("o_orderkey", F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("period_start"))
    parts = t("part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("metric"), F.col("p_type").alias("parent"))
    suppliers = t("supplier").select("s_suppkey", "s_nationkey").join(t("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    variant = F.when(F.col("l_returnflag") == "N", "fact").when(F.col("l_returnflag") == "R", "plan").otherwise("budget")
    summed = rows.groupBy(F.col("n_regionkey").alias("org_id"), "metric", "parent", F.col("l_suppkey").alias("document_id"), F.col("s_nationkey").cast("long").alias("uploaded_by"), "period_start", variant.alias("variant")).agg(F.sum("v").cast("decimal(28,6)").alias("value"), (F.max("l_linestatus") == "F").alias("needs_review"))
    return summed.select(
        "org_id", "metric", "parent", "document_id", F.lit("month").alias("period_type"), F.date_format("period_start", "MM.yyyy").alias("period_label"), "period_start",
        F.last_day("period_start").alias("period_end"), "value", F.lit("руб").alias("unit"), F.lit("RUB").alias("currency"), "variant", "needs_review",
        (F.col("document_id") % 7 == 0).alias("is_private"), (F.col("document_id") % 11 == 0).alias("superseded"), "uploaded_by",
    )


def series(spark: SparkSession, sf_dir: str, variant: str = "fact") -> DataFrame:
    return store.series(facts(spark, sf_dir), ORG, UID, variant, review=False)


FACTS_SQL = """facts AS (
 SELECT n_regionkey AS org_id, p_type || '/' || p_brand AS metric, p_type AS parent, l_suppkey AS document_id, CAST(s_nationkey AS BIGINT) AS uploaded_by,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start, CASE l_returnflag WHEN 'N' THEN 'fact' WHEN 'R' THEN 'plan' ELSE 'budget' END AS variant,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DECIMAL(28,6)) AS value, max(l_linestatus) = 'F' AS needs_review,
  l_suppkey % 7 = 0 AS is_private, l_suppkey % 11 = 0 AS superseded, 'month' AS period_type,
  strftime(CAST(date_trunc('month', o_orderdate) AS DATE), '%m.%Y') AS period_label, last_day(CAST(date_trunc('month', o_orderdate) AS DATE)) AS period_end
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 GROUP BY ALL)"""


def series_sql(variant: str = "fact", name: str = "series") -> str:
    return f"""{name} AS (
 SELECT * EXCLUDE rn FROM (
  SELECT *, row_number() OVER (PARTITION BY org_id, metric, variant, period_type, period_end ORDER BY document_id DESC, value DESC) AS rn
  FROM facts WHERE (NOT is_private OR uploaded_by = {UID}) AND NOT superseded AND org_id = {ORG} AND variant = '{variant}') WHERE rn = 1)"""


YEARS_SQL = """years AS (
 SELECT metric, CAST(year(period_start) AS VARCHAR) || CASE WHEN count(*) = 12 THEN '' ELSE ' (' || count(*) || ' мес.)' END AS period_label,
  make_date(year(period_start), 1, 1) AS period_start, make_date(year(period_start), 12, 31) AS period_end, CAST(sum(value) AS DECIMAL(28,6)) AS value, count(*) AS months
 FROM series GROUP BY metric, year(period_start))"""


def oracle(select: str, *ctes: str) -> str:
    return f"WITH {', '.join((FACTS_SQL, series_sql(), YEARS_SQL, *ctes))}\n{select}"
