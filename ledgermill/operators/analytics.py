"""Analytic operators over series of facts; each is a lazy plan over all metrics at once.

A series row has metric, parent, period_type, period_start, period_end, period_label, value.  Money stays decimal; it
becomes double only where a ratio is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 12


def as_double(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def yearly(series: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Months summed up to years, for series that hold nothing but months; others pass as they are.

    A year of fewer than 12 months says so in its label.
    """
    only = Window.partitionBy(*keys)
    rows = series.withColumn("_monthly", F.min((F.col("period_type") == "month").cast("int")).over(only) == 1)
    y = F.year("period_start")
    of_year = lambda year, own: F.when(F.col("_monthly"), year).otherwise(F.col(own))
    # One grouping for both: months fall into their year, any other row (a series has one a period) is its own group.
    groups = (
        F.col("_monthly"), of_year(F.lit("year"), "period_type").alias("period_type"), of_year(y.cast("string"), "period_label").alias("_label"),
        of_year(F.make_date(y, F.lit(1), F.lit(1)), "period_start").alias("period_start"), of_year(F.make_date(y, F.lit(12), F.lit(31)), "period_end").alias("period_end"),
    )
    summed = rows.groupBy(*keys, *groups).agg(F.sum("value").cast("decimal(28,6)").alias("value"), F.count(F.lit(1)).alias("months"))
    label = F.when(~F.col("_monthly") | (F.col("months") == 12), F.col("_label")).otherwise(F.format_string("%s (%d мес.)", "_label", "months"))
    return summed.select(*keys, "period_type", label.alias("period_label"), "period_start", "period_end", "value", "months")


def total(series: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Sum and number of periods of each series, with its bounds."""
    return series.groupBy(*keys).agg(F.sum("value").cast("decimal(28,6)").alias("total"), F.count(F.lit(1)).alias("periods"), F.min("period_start").alias("since"), F.max("period_end").alias("until"))


def share_in_parent(series: DataFrame) -> DataFrame:
    """Each row with its parent's value of the same period, and its share of it in percent.

    Where the series say unit and currency, the parent's must be the same (both may be missing).
    """
    measured = [c for c in ("unit", "currency") if c in series.columns]
    parents = series.select(F.col("metric").alias("_metric"), F.col("period_type").alias("_type"), F.col("period_end").alias("_end"), F.col("value").alias("parent_value"), *(F.col(c).alias(f"_{c}") for c in measured))
    same = (F.col("parent") == F.col("_metric")) & (F.col("period_type") == F.col("_type")) & (F.col("period_end") == F.col("_end"))
    for c in measured:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return series.join(parents, same, "left").drop("_metric", "_type", "_end", *(f"_{c}" for c in measured)).withColumn("share_pct", ratio(F.col("value"), F.col("parent_value")) * 100)


def roll_up(series: DataFrame) -> DataFrame:
    """Series of the parents: sums of their children per period."""
    return series.groupBy(F.col("parent").alias("metric"), "period_type", "period_label", "period_start", "period_end").agg(F.sum("value").cast("decimal(28,6)").alias("value"))


def compare_years(years: DataFrame, first: int, last: int) -> DataFrame:
    """Change of each metric between two years; percent of the signed first value."""
    at = lambda y: F.max_by("value", F.when((F.year("period_start") <= y) & (F.year("period_end") >= y), F.col("period_end")))
    both = years.groupBy("metric").agg(at(first).alias("first_value"), at(last).alias("last_value")).where("first_value is not null and last_value is not null")
    return both.withColumn("abs_change", F.col("last_value") - F.col("first_value")).withColumn("change_pct", ratio(F.col("abs_change"), F.col("first_value")) * 100)


def compare_previous(years: DataFrame, complete_only: bool = True) -> DataFrame:
    """Each period against the one before it in its series; with complete years only, those of 12 months."""
    rows = years.where("months = 12") if complete_only else years
    before = Window.partitionBy("metric").orderBy("period_end")
    out = rows.withColumn("previous", F.lag("value").over(before)).where("previous is not null")
    return out.withColumn("abs_change", F.col("value") - F.col("previous")).withColumn("change_pct", ratio(F.col("abs_change"), F.col("previous")) * 100)


def compare_latest(years: DataFrame) -> DataFrame:
    """Without named years: each metric's last two full years or, where it has fewer, its first and last period."""
    full = F.filter("_p", lambda x: x["months"] == 12)
    points = years.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("period_end", "period_label", "value", "months"))).alias("_p")).withColumn("_full", full).where(F.size("_p") >= 2)
    two = F.when(F.size("_full") >= 2, F.slice("_full", -2, 2)).otherwise(F.array(F.element_at("_p", 1), F.element_at("_p", -1)))
    ends = points.select("metric", two.alias("_e")).select("metric", F.col("_e")[0].alias("a"), F.col("_e")[1].alias("b"))
    out = ends.select("metric", F.col("a.period_label").alias("label_from"), F.col("b.period_label").alias("label_to"), F.col("a.value").alias("first_value"), F.col("b.value").alias("last_value"))
    return out.withColumn("abs_change", F.col("last_value") - F.col("first_value")).withColumn("change_pct", ratio(F.col("abs_change"), F.col("first_value")) * 100)


def compare_year(years: DataFrame, year: int) -> DataFrame:
    """A single named year against the period before it, complete or not."""
    return compare_previous(years, complete_only=False).where(F.year("period_end") == year)


def breakdown_of(asked: DataFrame, series: DataFrame, own: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """Breakdowns of the metrics asked for (metric, parent): of its own children or, for a total or a leaf without any, of its parent's."""
    parents = series.where("parent is not null").select(F.col("parent").alias("metric")).distinct().withColumn("_has", F.lit(True))
    target = asked.join(parents, "metric", "left").select(F.col("metric").alias("asked"), F.when(F.col("_has"), F.col("metric")).otherwise(F.col("parent")).alias("parent"))
    return target.join(breakdown(series, own, top), "parent")


def plan_fact(facts: DataFrame) -> DataFrame:
    """Plan and fact of the last period that has both, and the deviation in percent of the plan."""
    both = (
        facts.where(F.col("variant").isin("plan", "fact")).groupBy("metric", "period_end")
        .agg(F.max(F.when(F.col("variant") == "plan", F.col("value"))).alias("plan"), F.max(F.when(F.col("variant") == "fact", F.col("value"))).alias("fact"))
        .where("plan is not null and fact is not null")
    )
    last = both.groupBy("metric").agg(F.max("period_end").alias("period_end"), F.max_by("plan", "period_end").alias("plan"), F.max_by("fact", "period_end").alias("fact"))
    return last.withColumn("deviation", F.col("fact") - F.col("plan")).withColumn("deviation_pct", ratio(F.col("deviation"), F.col("plan")) * 100)


def breakdown(series: DataFrame, own: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """Children of each parent in its last period that enough of them cover, with shares, the largest first.

    Enough is two children, or all if there are fewer.  The total is the parent's own value (``own``) of that period if
    there is one, else the children's sum.
    """
    kids = series.where("parent is not null and not endswith(metric, ' итого')")
    cover = kids.groupBy("parent", "period_end").agg(F.count_distinct("metric").alias("n"))
    sizes = kids.groupBy("parent").agg(F.count_distinct("metric").alias("all"))
    target = cover.join(sizes, "parent").where(F.col("n") >= F.least(F.lit(2), F.col("all"))).groupBy("parent").agg(F.max("period_end").alias("period_end"))
    rows = kids.join(target, ["parent", "period_end"]).groupBy("parent", "metric", "period_end").agg(F.sum("value").cast("decimal(28,6)").alias("value"))
    if own is not None:
        rows = rows.join(own.select(F.col("metric").alias("parent"), "period_end", F.col("value").alias("_own")), ["parent", "period_end"], "left")
    else:
        rows = rows.withColumn("_own", F.lit(None).cast("decimal(28,6)"))
    all_ = Window.partitionBy("parent")
    rows = rows.withColumn("total", F.coalesce("_own", F.sum("value").over(all_).cast("decimal(28,6)")))
    rank = F.row_number().over(all_.orderBy(F.col("value").desc(), "metric"))
    return rows.withColumn("share_pct", ratio(F.col("value"), F.col("total")) * 100).withColumn("rank", rank).where(F.col("rank") <= top).drop("_own")


def growth_rank(years: DataFrame, top: int = 10) -> DataFrame:
    """Metrics by growth from their first to their last full year, in percent of the first value's size.

    Two full years are needed; otherwise all rows of the metric count.
    """
    w = Window.partitionBy("metric")
    rows = years.withColumn("_full", F.sum((F.col("months") == 12).cast("int")).over(w)).where("_full < 2 or months = 12")
    ends = rows.groupBy("metric").agg(F.min_by("value", "period_end").alias("first"), F.max_by("value", "period_end").alias("last"), F.min_by("period_label", "period_end").alias("label_from"), F.max_by("period_label", "period_end").alias("label_to"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    grown = ends.withColumn("growth_pct", ratio(F.col("last") - F.col("first"), F.abs("first")) * 100).where("growth_pct is not null")
    return grown.orderBy(F.col("growth_pct").desc(), "metric").limit(top).drop("n")


def month_rank(series: DataFrame, top: int = TOP) -> DataFrame:
    """Months of each metric by value, with their share of the metric's sum."""
    w = Window.partitionBy("metric")
    rows = series.where("period_type = 'month'").withColumn("share_pct", ratio(F.col("value"), F.sum("value").over(w)) * 100)
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.col("value").desc(), "period_end"))).where(F.col("rank") <= top)


def align_to_years(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two series of one shape: where one is by month and the other by year, the months are summed."""
    return yearly(a), yearly(b)


def compare_two(series: DataFrame, left: str, right: str) -> DataFrame:
    """Two metrics in their last common period: difference, percent of the second, ratio."""
    side = lambda m, name: series.where(F.col("metric") == m).select("period_type", "period_end", F.col("value").alias(name))
    met = side(left, "a").join(side(right, "b"), ["period_type", "period_end"])
    last = met.agg(F.max("period_end").alias("period_end"), F.max_by("a", "period_end").alias("a"), F.max_by("b", "period_end").alias("b"))
    return last.withColumn("difference", F.col("a") - F.col("b")).withColumn("pct_of_b", ratio(F.col("difference"), F.col("b")) * 100).withColumn("ratio", ratio(F.col("a"), F.col("b")))


def growth_stats(series: DataFrame) -> DataFrame:
    """First, last, mean growth and compound annual growth of each metric.

    The span in years is the median gap between ends times the number of gaps.
    """
    w = Window.partitionBy("metric").orderBy("period_end")
    rows = series.withColumn("_prev", F.lag("value").over(w)).withColumn("_gap", F.datediff("period_end", F.lag("period_end").over(w)))
    rows = rows.withColumn("_g", ratio(F.col("value"), F.col("_prev")) - 1)
    out = rows.groupBy("metric").agg(F.min_by("value", "period_end").alias("first"), F.max_by("value", "period_end").alias("last"), F.count(F.lit(1)).alias("n"), (F.avg("_g") * 100).alias("mean_growth_pct"), F.median("_gap").alias("gap"))
    span = F.col("gap") * (F.col("n") - 1) / 365.25
    cagr = F.when((F.col("first") > 0) & (F.col("last") > 0) & (F.col("n") > 1) & (span > 0), (F.pow(ratio(F.col("last"), F.col("first")), 1 / span) - 1) * 100)
    return out.withColumn("cagr_pct", cagr)


def trailing(series: DataFrame, n: int = 12) -> DataFrame:
    """Sum of the last n periods up to each row."""
    w = Window.partitionBy("metric").orderBy("period_end").rowsBetween(-(n - 1), 0)
    return series.withColumn("trailing", F.sum("value").over(w).cast("decimal(28,6)")).withColumn("covered", F.count(F.lit(1)).over(w))


def dominant_type(series: DataFrame) -> DataFrame:
    """The period type most rows of a metric have; on a tie, the one seen first."""
    seen = series.groupBy("metric", "period_type").agg(F.count(F.lit(1)).alias("n"), F.min("period_end").alias("since"))
    best = Window.partitionBy("metric").orderBy(F.col("n").desc(), "since", "period_type")
    return seen.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("metric", "period_type", "n")


def reconcile(children: DataFrame, totals: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Totals that differ from the sum of their children by more than the tolerance."""
    sums = children.groupBy("parent", "period_end").agg(F.sum("value").cast("decimal(28,6)").alias("children_sum"), F.count(F.lit(1)).alias("children"))
    met = totals.select(F.col("metric").alias("parent"), "period_end", F.col("value").alias("total")).join(sums, ["parent", "period_end"])
    return met.withColumn("gap_pct", F.abs(ratio(F.col("children_sum") - F.col("total"), F.col("total"))) * 100).where(F.col("gap_pct") > tolerance * 100)


def scale_suspects(facts: DataFrame, high: float = 50.0, low: float = 0.02) -> DataFrame:
    """Facts that are far from the median of their metric's other documents; sign flips count as far."""
    med = facts.groupBy("metric").agg(F.median(as_double("value")).alias("median"))
    return facts.join(med, "metric").withColumn("scale", ratio(F.col("value"), F.col("median"))).where((F.col("scale") > high) | (F.col("scale") < low))


def last_values(series: DataFrame) -> DataFrame:
    """Last value, its label and the number of periods of each metric."""
    return series.groupBy("metric").agg(F.max_by("value", "period_end").alias("value"), F.max_by("period_label", "period_end").alias("label"), F.count(F.lit(1)).alias("periods"))


def document_summary(facts: DataFrame, kind: Column, per_kind: int = 10) -> DataFrame:
    """Latest fact of each metric in a document, the largest per kind."""
    latest = facts.groupBy("document_id", "metric").agg(F.max_by("value", "period_end").alias("value"), F.max("period_end").alias("period_end"))
    w = Window.partitionBy("document_id", "kind").orderBy(F.abs("value").desc(), "metric")
    return latest.withColumn("kind", kind).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_kind)


def metric_cards(series: DataFrame, periods: int = 24) -> DataFrame:
    """A text of each metric's last values, oldest first."""
    w = Window.partitionBy("metric").orderBy(F.col("period_end").desc())
    last = series.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= periods)
    parts = F.array_sort(F.collect_list(F.struct("period_end", F.concat_ws(" — ", "period_label", F.col("value").cast("string")).alias("t"))))
    return last.groupBy("metric").agg(parts.alias("p")).select("metric", F.concat(F.lit("Показатель «"), F.col("metric"), F.lit("»: "), F.array_join(F.transform("p", lambda x: x["t"]), "; ")).alias("body"))


def derived_pairs(payload: DataFrame) -> DataFrame:
    """Sum, difference and ratio of every two values of one answer that share a unit.

    ``payload``: answer_id, i, unit, value; one answer holds a few dozen values, so pairs are made inside it.
    """
    a, b = (payload.select("answer_id", "unit", F.col("i").alias(f"{n}_i"), F.col("value").alias(n)) for n in ("a", "b"))
    return a.join(b, ["answer_id", "unit"]).where("a_i < b_i").select("answer_id", "unit", "a_i", "b_i", (F.col("a") + F.col("b")).alias("sum"), (F.col("a") - F.col("b")).alias("difference"), ratio(F.col("a"), F.col("b")).alias("ratio"))


def is_aggregate(metrics: DataFrame) -> DataFrame:
    """Metrics (metric, parent) with a mark for totals: by name, or by having children."""
    parents = metrics.where("parent is not null").select(F.col("parent").alias("metric"), F.lit(True).alias("_p")).distinct()
    return metrics.join(parents, "metric", "left").withColumn("is_aggregate", F.endswith("metric", F.lit(" итого")) | F.coalesce("_p", F.lit(False))).drop("_p")


def history(series: DataFrame, last: int | None = 12) -> DataFrame:
    """The last points of each metric with the unit and currency of its newest point, and where each came from."""
    w = Window.partitionBy("metric")
    newest = w.orderBy(F.col("period_end").desc())
    rows = series.withColumn("_r", F.row_number().over(newest)).withColumn("unit", F.max_by("unit", "period_end").over(w)).withColumn("currency", F.max_by("currency", "period_end").over(w))
    rows = rows.where(F.col("_r") <= last) if last else rows
    return rows.withColumn("source", F.concat_ws(" · ", F.concat(F.lit("документ "), F.col("document_id").cast("string")), "period_label")).drop("_r")


def share_of(series: DataFrame, part: str, whole: str) -> DataFrame:
    """Share of one metric in another in their last common period, in percent."""
    return compare_two(series, part, whole).select("period_end", F.col("a").alias("part"), F.col("b").alias("whole"), (F.col("ratio") * 100).alias("share_pct"))


def forecast_effects(forecasts: DataFrame, series: DataFrame) -> DataFrame:
    """What follows from a forecast: its change against the last fact and the width of its interval."""
    last = last_values(series).select("metric", as_double("value").alias("last_fact"))
    met = forecasts.join(last, "metric")
    return met.select(
        "metric", "base", "last_fact", (F.col("base") - F.col("last_fact")).alias("vs_fact_abs"), ((F.col("base") - F.col("last_fact")) / F.nullif("last_fact", F.lit(0.0)) * 100).alias("vs_fact_pct"),
        (F.col("high") - F.col("low")).alias("interval_width"), ((F.col("high") - F.col("low")) / F.nullif(F.abs("base"), F.lit(0.0)) * 100).alias("interval_width_pct"),
    )


def daily_digest(series: DataFrame, kinds: DataFrame, shown: int = 5, ranked: int = 3) -> DataFrame:
    """Lines of a digest (part, metric, value): last values of the first revenue and expense metrics, best growth."""
    wanted = kinds.where(F.col("kind").isin("revenue", "expense")).select("metric")
    last = last_values(series).join(wanted, "metric", "left_semi")
    values = last.orderBy("metric").limit(shown).select(F.lit("last").alias("part"), "metric", as_double("value").alias("value"))
    best = growth_rank(yearly(series), ranked).select(F.lit("growth").alias("part"), "metric", F.col("growth_pct").alias("value"))
    return values.unionByName(best)
