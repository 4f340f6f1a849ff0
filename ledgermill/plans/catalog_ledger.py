"""Queries over the transaction ledger (orders and events) and the usage journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators import ledger
from ledgermill.plans.testdata import table

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


def ops(spark, sf) -> DataFrame:
    """Orders as operations: header is the status, category the priority."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("op_id"), F.concat(F.lit("Header "), "o_orderstatus").alias("header"), F.col("o_orderdate").cast("date").alias("when"), F.col("o_totalprice").cast("decimal(28,6)").alias("value"),
        F.col("o_orderpriority").alias("category"), F.concat(F.lit("sheet"), (F.col("o_custkey") % 3).cast("string")).alias("sheet"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"),
        F.date_format("o_orderdate", "yyyy").alias("label"), F.when(F.col("o_orderstatus") == "F", "income").otherwise("expense").alias("kind"),
    )


V = "CAST(o_totalprice AS DECIMAL(28,6))"
M = "CAST(date_trunc('month', o_orderdate) AS DATE)"


@query(f"SELECT lower('Header ' || o_orderstatus) AS header, {M} AS period_start, round(CAST(sum({V}) AS DOUBLE), 4) AS value, count(*) AS n, array_to_string(list_sort(list(DISTINCT 'sheet' || (o_custkey % 3))), ', ')[1:120] AS sheets FROM orders GROUP BY ALL")
def ledger_month_facts(spark, sf) -> DataFrame:
    return ledger.month_facts(ops(spark, sf)).select("header", "period_start", num("value").alias("value"), "n", "sheets")


@query(f"SELECT month, category, round(CAST(value AS DOUBLE), 4) AS value, n, round(CAST(value AS DOUBLE) / CAST(sum(value) OVER (PARTITION BY month) AS DOUBLE) * 100, 6) AS share_pct, CAST(row_number() OVER (PARTITION BY month ORDER BY value DESC, category) AS INTEGER) AS rank FROM (SELECT {M} AS month, o_orderpriority AS category, sum({V}) AS value, count(*) AS n FROM orders GROUP BY ALL)")
def ledger_category_share(spark, sf) -> DataFrame:
    return ledger.category_share(ops(spark, sf)).select("month", "category", num("value").alias("value"), "n", num("share_pct", 6).alias("share_pct"), "rank")


@query("SELECT o_orderpriority AS category, " + ", ".join(f"round(CAST(sum(CASE WHEN year(o_orderdate) = {y} THEN {V} END) AS DOUBLE), 4) AS y{y}" for y in range(1995, 2002)) + " FROM orders GROUP BY 1")
def ledger_pivot(spark, sf) -> DataFrame:
    years = [str(y) for y in range(1995, 2002)]
    return ledger.pivot(ops(spark, sf), years).select("category", *(num(y).alias(f"y{y}") for y in years))


@query(f"SELECT month, category, round(CAST(sum(v) AS DOUBLE), 4) AS value, count(*) AS n, CAST(grouping_id(month, category) AS INTEGER) AS level FROM (SELECT {M} AS month, o_orderpriority AS category, {V} AS v FROM orders) GROUP BY CUBE (month, category)")
def ledger_cube_totals(spark, sf) -> DataFrame:
    return ledger.totals(ops(spark, sf)).select("month", "category", num("value").alias("value"), "n", "level")


@query(f"SELECT month, round(CAST(sum(e) AS DOUBLE), 4) AS expense, round(CAST(sum(i) AS DOUBLE), 4) AS income, count(*) AS n, round(CAST(sum(e) - sum(i) AS DOUBLE), 4) AS balance FROM (SELECT {M} AS month, CASE WHEN o_orderstatus <> 'F' THEN {V} ELSE 0 END AS e, CASE WHEN o_orderstatus = 'F' THEN {V} ELSE 0 END AS i FROM orders) GROUP BY ROLLUP (month)")
def ledger_rollup_totals(spark, sf) -> DataFrame:
    return ledger.month_report(ops(spark, sf)).select("month", num("expense").alias("expense"), num("income").alias("income"), "n", num("balance_expense_minus_income").alias("balance"))


@query(f"SELECT header, count(*) AS n, max(op_id) AS last_id, round(CAST(sum(v) AS DOUBLE), 4) AS value FROM (SELECT 'Header ' || o_orderstatus AS header, o_orderkey AS op_id, {V} AS v, max(o_orderkey) OVER (PARTITION BY o_orderstatus) AS m FROM orders) WHERE op_id <> m GROUP BY header")
def ledger_undo_last(spark, sf) -> DataFrame:
    return ledger.undo_last(ops(spark, sf)).groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.max("op_id").alias("last_id"), num(F.sum("value")).alias("value"))


PRICES = ledger.parse_prices("click=0.5/1.5, view=0.1, broken, purchase=2/4, error=x")


def calls(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(F.col("event_type").alias("model"), F.concat(F.lit("task"), (F.col("user_id") % 4).cast("string")).alias("task"), k.alias("prompt_tokens"), (k * 2).alias("completion_tokens"), "ts")


@query("SELECT event_type AS model, count(*) AS calls, CAST(sum(k) AS BIGINT) AS prompt_tokens, CAST(sum(2 * k) AS BIGINT) AS completion_tokens, round(sum(k) / 1e6 * CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.1 WHEN 'purchase' THEN 2.0 ELSE 0.0 END + sum(2 * k) / 1e6 * CASE event_type WHEN 'click' THEN 1.5 WHEN 'view' THEN 0.1 WHEN 'purchase' THEN 4.0 ELSE 0.0 END, 9) AS cost FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def usage_snapshot_cost(spark, sf) -> DataFrame:
    return ledger.usage_snapshot(calls(spark, sf), PRICES).withColumn("cost", F.round("cost", 9))


@query("SELECT 'task' || (user_id % 4) AS task, count(*) AS calls, CAST(sum(k) AS BIGINT) AS prompt_tokens, CAST(sum(2 * k) AS BIGINT) AS completion_tokens FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL")
def usage_by_task(spark, sf) -> DataFrame:
    return ledger.usage_snapshot(calls(spark, sf), {}, "task").drop("cost")


COST = "CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.1 WHEN 'purchase' THEN 2.0 ELSE 0.0 END + 2 * CASE event_type WHEN 'click' THEN 1.5 WHEN 'view' THEN 0.1 WHEN 'purchase' THEN 4.0 ELSE 0.0 END"


@query(f"WITH s AS (SELECT sum(k / 1e6 * ({COST})) AS spent, count(*) FILTER (user_id % 4 = 1) AS questions FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) SELECT round(spent, 9) AS spent, questions, round(50 - spent, 6) AS \"left\", round(spent / questions, 9) AS per_question, round(greatest(50 - spent, 0) / (spent / questions), 3) AS questions_left FROM s")
def usage_budget_left(spark, sf) -> DataFrame:
    """What is left of a budget of 50, and for how many questions (calls of task 1) it will do."""
    row = ledger.budget_left(calls(spark, sf), PRICES, 50.0, "task1")
    return row.select(F.round("spent", 9).alias("spent"), "questions", F.round("left", 6).alias("left"), F.round("per_question", 9).alias("per_question"), F.round("questions_left", 3).alias("questions_left"))


@query("SELECT event_type AS kind, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def incident_counts(spark, sf) -> DataFrame:
    return ledger.incident_counts(table(spark, sf, "events").select(F.col("event_type").alias("kind"), "ts"))


@query(f"SELECT category, value, n, round(value / sum(value) OVER () * 100, 4) AS share_pct FROM (SELECT o_orderpriority AS category, round(CAST(sum({V}) AS DOUBLE), 4) AS value, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)")
def expense_report_shares(spark, sf) -> DataFrame:
    return ledger.expense_report(ops(spark, sf))["categories"].select("category", num("value").alias("value"), "n", num("share_pct").alias("share_pct"))


@query(f"SELECT category, month, round(CAST(sum(v) AS DOUBLE), 4) AS value FROM (SELECT o_orderpriority AS category, {M} AS month, {V} AS v FROM orders WHERE o_orderstatus <> 'F') GROUP BY ROLLUP (category, month) HAVING category IS NOT NULL")
def expense_report_months(spark, sf) -> DataFrame:
    return ledger.expense_report(ops(spark, sf))["category_months"].select("category", "month", num("value").alias("value"))
