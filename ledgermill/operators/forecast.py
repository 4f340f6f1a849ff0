"""Ensemble forecast with walk-forward back-tests, as one JVM-side plan over all series at once.

A series is one array per metric (tens of points), so its methods are array expressions: flat, geometric mean growth, least
squares line, value of a season ago.  Every series is exploded into its folds (0 is the forecast itself, the others end 1 to
3 points before the target window), all folds are predicted by the same expressions, and errors, weights and the ensemble
are aggregates over a handful of rows a metric.  A fold needs two points to train on and a full window to be held against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z80 = 1.28
DEFAULT_ERROR = 0.15
FLAT_LONG_ERROR = 0.5
METHODS = ("naive", "mean_growth", "linear_trend", "seasonal_naive")
PER_YEAR = {"year": 1, "quarter": 4, "month": 12}


def _path(v: Column, steps: Column, window: Column, step_value) -> Column:
    """Sum of the last ``window`` of ``steps`` values of a path."""
    return F.aggregate(F.sequence(steps - window + 1, steps), F.lit(0.0), lambda acc, i: acc + step_value(i))


def predictions(v: Column, steps: Column, window: Column, season: int) -> dict[str, Column]:
    """Each method's sum over the target window, from the training values ``v``; null where it can't be built."""
    n = F.size(v)
    last = F.element_at(v, -1)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.element_at(v, i + 1) / F.nullif(F.element_at(v, i), F.lit(0.0)))
    rates = F.filter(pairs, lambda r: r.isNotNull())
    sum_ln = F.aggregate(rates, F.lit(0.0), lambda acc, r: acc + F.ln(F.when(r > 0, r)))
    growth = F.when(F.size(rates) > 0, F.exp(sum_ln / F.size(rates)))
    mean_x = (n - 1) / 2.0
    mean_y = F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y) / n
    centred = F.aggregate(F.transform(v, lambda y, i: (i - mean_x) * (y - mean_y)), F.lit(0.0), lambda acc, x: acc + x)
    slope = centred / F.aggregate(F.transform(v, lambda y, i: (i - mean_x) * (i - mean_x)), F.lit(0.0), lambda acc, x: acc + x)
    out = {
        "naive": last * window,
        "mean_growth": F.when(n >= 2, _path(v, steps, window, lambda i: last * F.pow(growth, i))),
        "linear_trend": F.when(n >= 2, _path(v, steps, window, lambda i: mean_y + slope * (n - 1 + i - mean_x))),
    }
    if season > 1:
        out["seasonal_naive"] = F.when(n >= season, _path(v, steps, window, lambda i: F.element_at(v, F.when(n >= season, n - season + 1 + (i - 1) % season).otherwise(1).cast("int"))))
    return out


def forecast(series: DataFrame, period_type: str = "year", target_year: int | None = None, growth_multiplier: float | None = None) -> DataFrame:
    """One row per metric with at least two points: base, low, high, methods, weights, error, confidence.

    ``series``: metric, period_start, period_end, value, all of one period type.
    """
    per_year = PER_YEAR[period_type]
    months = 12 // per_year
    points = series.groupBy("metric").agg(
        F.array_sort(F.collect_list(F.struct("period_end", F.col("value").cast("double").alias("v"), F.year("period_start").alias("y")))).alias("p")
    )
    points = points.where(F.size("p") >= 2).select("metric", F.transform("p", lambda x: x["v"]).alias("v"), F.col("p"), F.element_at("p", -1)["period_end"].alias("last_end"))
    start = F.add_months(F.trunc("last_end", "MM"), 1)
    if target_year is None:
        steps, window = F.lit(1), F.lit(1)
    elif period_type == "year":
        steps = F.greatest(F.lit(target_year) - (F.year("last_end") + 1) + 1, F.lit(1))
        window = F.when(F.lit(target_year) > F.year("last_end"), F.least(F.lit(1), steps)).otherwise(steps)
    else:
        left = (F.lit(target_year) - F.year(start)) * 12 + 13 - F.month(start)
        steps = F.greatest(F.round(left / months).cast("int"), F.lit(1))
        window = F.when(F.lit(target_year) > F.year("last_end"), F.least(F.lit(per_year), steps)).otherwise(steps)
    points = points.withColumn("steps", steps.cast("int")).withColumn("window", window.cast("int")).withColumn("n", F.size("v"))
    folds = points.withColumn("f", F.explode(F.concat(F.array(F.lit(0)), F.when(F.col("n") >= 3, F.sequence("window", F.col("window") + 2)).otherwise(F.array().cast("array<int>")))))
    folds = folds.where("f = 0 or n - f >= 2").withColumn("train", F.when(F.col("f") == 0, F.col("v")).otherwise(F.slice("v", 1, F.col("n") - F.col("f"))))
    folds = folds.withColumn("ahead", F.when(F.col("f") == 0, F.col("steps")).otherwise(F.col("window")))
    actual = F.aggregate(F.slice("v", F.col("n") - F.col("f") + 1, F.col("window")), F.lit(0.0), lambda acc, x: acc + x)
    season = per_year if per_year > 1 else 1
    made = predictions(F.col("train"), F.col("ahead"), F.col("window"), season)
    if "seasonal_naive" in made:
        made["seasonal_naive"] = F.when(F.col("n") >= 2 * season, made["seasonal_naive"])
    long = folds.select("metric", "f", actual.alias("actual"), F.explode(F.array(*(F.struct(F.lit(m).alias("method"), p.alias("pred")) for m, p in made.items()))).alias("m")).select("metric", "f", "actual", "m.*")
    long = long.where("pred is not null and not isnan(pred) and abs(pred) < double('infinity')")
    error = F.when(F.col("f") > 0, F.abs(F.col("pred") - F.col("actual")) / F.greatest(F.abs("actual"), F.lit(1e-9)))
    each = long.groupBy("metric", "method").agg(F.max(F.when(F.col("f") == 0, F.col("pred"))).alias("pred"), F.avg(error).alias("err")).where("pred is not null")
    head = points.select("metric", "n", "steps", "window", "last_end", "v", "p")
    each = each.join(head.select("metric", "steps"), "metric").withColumn("err", F.coalesce("err", F.when((F.col("method") == "naive") & (F.col("steps") > 1), F.lit(FLAT_LONG_ERROR)))).drop("steps")
    got = each.groupBy("metric").agg(F.sort_array(F.collect_list(F.struct("method", "pred", "err"))).alias("m"), F.max("err").alias("worst"))
    weight = lambda x: F.when(F.col("worst").isNull(), 1.0).otherwise(1.0 / (F.coalesce(x["err"], F.greatest("worst", F.lit(DEFAULT_ERROR))) + 0.05))
    got = got.withColumn("w", F.transform("m", weight))
    got = got.withColumn("w", F.transform("w", lambda w: w / F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x)))
    dot = lambda pick, keep=None: F.aggregate(F.zip_with("m", "w", lambda a, w: pick(a) * w if keep is None else F.when(keep(a), pick(a) * w).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)
    known = lambda a: a["err"].isNotNull()
    got = got.withColumn("plain", dot(lambda a: a["pred"])).withColumn(
        "rel_err", F.when(F.col("worst").isNull(), F.lit(DEFAULT_ERROR)).otherwise(dot(lambda a: F.coalesce(a["err"], F.lit(0.0)), known) / dot(lambda a: F.lit(1.0), known))
    )
    got = got.join(head, "metric")
    got = got.withColumn("reference", F.aggregate(F.slice("v", F.greatest(F.col("n") - F.col("window") + 1, F.lit(1)), F.col("window")), F.lit(0.0), lambda acc, x: acc + x))
    base = F.col("plain") if growth_multiplier is None else F.col("reference") + (F.col("plain") - F.col("reference")) * growth_multiplier
    wide = F.abs("base") * F.col("rel_err") * Z80 * (F.sqrt("steps") if period_type == "year" else F.lit(1.0))
    to_date = F.lit(0.0)
    if target_year is not None and period_type != "year":
        to_date = F.when(F.year("last_end") == target_year, F.aggregate(F.filter("p", lambda x: x["y"] == target_year), F.lit(0.0), lambda acc, x: acc + x["v"])).otherwise(0.0)
    got = got.withColumn("base", base).withColumn("half", wide).withColumn("to_date", to_date)
    low = F.when(F.col("base") > 0, F.greatest(F.col("base") - F.col("half"), F.lit(0.0))).otherwise(F.col("base") - F.col("half"))
    confidence = F.when((F.col("n") >= 12) & (F.col("rel_err") <= 0.07), "высокая").when((F.col("n") >= 4) & (F.col("rel_err") <= 0.2), "средняя").otherwise("низкая")
    last_value = F.element_at("v", -1)
    notes = F.filter(F.array(
        F.when(F.col("n") < 4, F.format_string("короткий ряд (%d точек) — интервал широкий", "n")),
        F.when(F.col("rel_err") > 0.2, F.format_string("высокая ошибка на исторической проверке (%.0f%%)", F.col("rel_err") * 100)),
        F.when(F.exists("v", lambda x: x <= 0), F.lit("ряд содержит нулевые/отрицательные значения — темповые модели ограничены")),
        F.when((F.col("base") < 0) & (last_value > 0), F.lit("ансамбль ушёл в минус (резкий спад при коротком ряде) — отнеситесь к прогнозу осторожно")),
    ), lambda x: x.isNotNull())
    return got.select(
        "metric", "n", "steps", notes.alias("notes"), (F.col("base") + F.col("to_date")).alias("base"), (low + F.col("to_date")).alias("low"), (F.col("base") + F.col("half") + F.col("to_date")).alias("high"), "reference",
        F.col("to_date").alias("fact_to_date"), F.col("base").alias("rest_forecast"), (F.col("rel_err") * 100).alias("backtest_error_pct"), confidence.alias("confidence"),
        F.map_from_arrays(F.transform("m", lambda a: a["method"]), F.transform("m", lambda a: a["pred"] + F.col("to_date"))).alias("methods"),
        F.map_from_arrays(F.transform("m", lambda a: a["method"]), F.col("w")).alias("weights"),
    )
