"""Transaction ledger: month facts, category shares, pivots, totals; and the usage ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_facts(ops: DataFrame) -> DataFrame:
    """Operations (header, when, value, sheet) as monthly facts per header: sum, count, the sheets' names."""
    return ops.groupBy(F.lower("header").alias("header"), F.trunc("when", "MM").alias("period_start")).agg(
        F.sum("value").cast("decimal(28,6)").alias("value"), F.count(F.lit(1)).alias("n"), F.substring(F.array_join(F.array_sort(F.collect_set("sheet")), ", "), 1, 120).alias("sheets")
    )


def category_share(ops: DataFrame, top: int = 12) -> DataFrame:
    """Categories of each month by value, with their share of the month."""
    sums = ops.groupBy(F.trunc("when", "MM").alias("month"), "category").agg(F.sum("value").cast("decimal(28,6)").alias("value"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("month")
    rank = F.row_number().over(w.orderBy(F.col("value").desc(), "category"))
    return sums.withColumn("share_pct", F.col("value").cast("double") / F.nullif(F.sum("value").over(w).cast("double"), F.lit(0.0)) * 100).withColumn("rank", rank).where(F.col("rank") <= top)


def pivot(ops: DataFrame, months: list[str]) -> DataFrame:
    """Category x month, with the named months as columns; naming them saves the pass that would look for them."""
    return ops.groupBy("category").pivot("label", months).agg(F.sum("value").cast("decimal(28,6)"))


def totals(ops: DataFrame) -> DataFrame:
    """Sums by month and category with subtotals of both and the grand total; level 0 is the finest."""
    return ops.cube("month", "category").agg(F.sum("value").cast("decimal(28,6)").alias("value"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def month_report(ops: DataFrame) -> DataFrame:
    """Expense, income, their balance (expense − income) and count per month, and a total row with a null month."""
    sums = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("value")).otherwise(0)).cast("decimal(28,6)")
    rows = ops.rollup("month").agg(sums("expense").alias("expense"), sums("income").alias("income"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("balance_expense_minus_income", F.col("expense") - F.col("income"))


def journal(ops: DataFrame) -> DataFrame:
    """Operations in order, as the journal shows them."""
    return ops.orderBy("when", "op_id")


def undo_last(ops: DataFrame) -> DataFrame:
    """Without each journal's newest entry; journals are few and large, so only their newest ids are grouped."""
    newest = ops.groupBy(F.col("header").alias("_header")).agg(F.max("op_id").alias("_last"))
    return ops.join(newest, ops["header"].eqNullSafe(F.col("_header")) & (ops["op_id"] == F.col("_last")), "left_anti")


def usage_snapshot(calls: DataFrame, prices: dict[str, tuple[float, float]], by: str = "model") -> DataFrame:
    """Calls, tokens and cost of each model or task; prices are per million input and output tokens.

    Cached and reasoning tokens are summed as well where the journal has them.
    """
    rate: Column = F.lit(0.0)
    counters = [c for c in ("prompt_tokens", "completion_tokens", "cached_tokens", "reasoning_tokens") if c in calls.columns]
    sums = calls.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), *(F.sum(c).alias(c) for c in counters))
    for name, (per_in, per_out) in sorted(prices.items()):
        rate = F.when(F.col(by) == name, F.col("prompt_tokens") / 1e6 * per_in + F.col("completion_tokens") / 1e6 * per_out).otherwise(rate)
    return sums.withColumn("cost", rate)


def budget_left(calls: DataFrame, prices: dict[str, tuple[float, float]], budget: float, task: str = "compose") -> DataFrame:
    """One row: what is spent and left of a budget, the mean price of a question (a call of ``task``) and how many more it pays for."""
    spent = usage_snapshot(calls, prices).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent"))
    asked = calls.where(F.col("task") == task).agg(F.count(F.lit(1)).alias("questions"))
    one = spent.crossJoin(asked).withColumn("left", F.lit(budget) - F.col("spent")).withColumn("per_question", F.col("spent") / F.nullif("questions", F.lit(0)))
    return one.withColumn("questions_left", F.greatest("left", F.lit(0.0)) / F.nullif("per_question", F.lit(0.0)))


def parse_prices(text: str) -> dict[str, tuple[float, float]]:
    """«model=in/out, …»; the output price defaults to the input's, items that don't parse are skipped."""
    out = {}
    for item in text.split(","):
        name, eq, price = item.partition("=")
        first, _, second = price.partition("/")
        try:
            if eq and name.strip():
                out[name.strip()] = (float(first), float(second or first))
        except ValueError:
            continue
    return out


def incident_counts(events: DataFrame) -> DataFrame:
    """Occurrences, first and last time of each kind."""
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def add_entries(ops: DataFrame, new: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The journal with new entries, and the month facts with the months that they touch summed anew.

    Months are recomputed from all their operations, so late entries and corrections come out right.
    """
    all_ = ops.unionByName(new)
    touched = new.select(F.lower("header").alias("header"), F.trunc("when", "MM").alias("period_start")).distinct()
    fresh = month_facts(all_).join(touched, ["header", "period_start"], "left_semi")
    return all_, facts.join(touched, ["header", "period_start"], "left_anti").unionByName(fresh.select(*facts.columns))


def ensure_journal(documents: DataFrame, orgs: DataFrame, name: str) -> DataFrame:
    """Documents with one system journal per organisation; it belongs to no user."""
    want = orgs.select("org_id", F.sha2(F.concat(F.lit("journal:"), F.col("org_id").cast("string")).cast("binary"), 256).alias("file_hash"), F.lit(name).alias("original_name"), F.lit(0).cast("long").alias("uploaded_by"))
    return documents.unionByName(want.join(documents, ["org_id", "file_hash"], "left_anti"), allowMissingColumns=True)


def expense_report(ops: DataFrame) -> dict[str, DataFrame]:
    """Sheets of the expense report: months with totals, shares of categories, categories by month."""
    spent = ops.where(F.col("kind") == "expense")
    months = month_report(ops).orderBy(F.col("month").isNull(), "month")
    shares = spent.groupBy("category").agg(F.sum("value").cast("decimal(28,6)").alias("value"), F.count(F.lit(1)).alias("n"))
    whole = spent.agg(F.sum("value").cast("double").alias("_all"))
    shares = shares.crossJoin(F.broadcast(whole)).withColumn("share_pct", F.col("value").cast("double") / F.nullif("_all", F.lit(0.0)) * 100).drop("_all").orderBy(F.col("value").desc(), "category")
    by_month = spent.rollup("category", "month").agg(F.sum("value").cast("decimal(28,6)").alias("value")).where("category is not null")
    return {"months": months, "categories": shares, "category_months": by_month}
