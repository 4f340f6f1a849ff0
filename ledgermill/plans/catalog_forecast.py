"""Forecast queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators import analytics as an
from ledgermill.operators import forecast as fc
from ledgermill.plans.testdata import oracle, series

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Yearly points numbered from 0, their folds, and each method's one-step prediction from the fold's points.
FOLDS = """pts AS (SELECT metric, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY metric ORDER BY period_end) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM years),
folds AS (SELECT DISTINCT metric, n, f FROM pts, (VALUES (0), (1), (2), (3)) t(f) WHERE n >= 2 AND (f = 0 OR (n >= 3 AND n - f >= 2))),
train AS (SELECT p.metric, p.n, f.f, p.i, p.v, p.v / nullif(lag(p.v) OVER (PARTITION BY p.metric, f.f ORDER BY p.i), 0) AS r FROM pts p JOIN folds f ON f.metric = p.metric AND p.i < p.n - f.f),
agg AS (SELECT metric, f, n, count(*) AS k, max_by(v, i) AS last, exp(avg(CASE WHEN r > 0 THEN ln(r) END)) AS g, min(r) AS low_r, regr_slope(v, i) AS s, regr_intercept(v, i) AS c FROM train GROUP BY ALL),
preds AS (SELECT metric, f, n, 'naive' AS method, last AS pred FROM agg UNION ALL SELECT metric, f, n, 'mean_growth', last * g FROM agg WHERE low_r > 0 UNION ALL SELECT metric, f, n, 'linear_trend', c + s * k FROM agg),
errs AS (SELECT p.metric, p.n, p.method, max(CASE WHEN f = 0 THEN pred END) AS pred, avg(CASE WHEN f > 0 THEN abs(pred - a.v) / greatest(abs(a.v), 1e-9) END) AS err FROM preds p LEFT JOIN pts a ON a.metric = p.metric AND a.i = p.n - p.f GROUP BY ALL),
wts AS (SELECT *, CASE WHEN max(err) OVER m IS NULL THEN 1.0 ELSE 1 / (coalesce(err, greatest(max(err) OVER m, 0.15)) + 0.05) END AS w FROM errs WHERE pred IS NOT NULL WINDOW m AS (PARTITION BY metric)),
ens AS (SELECT metric, n, sum(w * pred) / sum(w) AS base, CASE WHEN max(err) IS NULL THEN 0.15 ELSE sum(CASE WHEN err IS NOT NULL THEN w * err END) / sum(CASE WHEN err IS NOT NULL THEN w END) END AS rel FROM wts GROUP BY ALL)"""


def _years(spark, sf) -> DataFrame:
    return an.yearly(series(spark, sf))


def forecast_methods(spark, sf) -> DataFrame:
    """One step ahead by each method."""
    rows = fc.forecast(_years(spark, sf))
    return rows.select("metric", *(F.round(F.col("methods")[m], 3).alias(m) for m in fc.METHODS[:3]))


def forecast_ensemble(spark, sf) -> DataFrame:
    rows = fc.forecast(_years(spark, sf))
    return rows.select("metric", *(F.round(c, 3).alias(c) for c in ("base", "low", "high", "backtest_error_pct")), "confidence")


def forecast_scenario(spark, sf) -> DataFrame:
    rows = fc.forecast(_years(spark, sf), growth_multiplier=0.5)
    return rows.select("metric", F.round("base", 3).alias("base"), F.round("reference", 3).alias("reference"))


def forecast_months_to_year(spark, sf) -> DataFrame:
    """Monthly series, the rest of the last year and fact so far; seasonal baseline included."""
    rows = fc.forecast(series(spark, sf).select("metric", "period_start", "period_end", "value"), "month", target_year=2001)
    return rows.select("metric", "n", "steps", *(F.round(c, 2).alias(c) for c in ("base", "low", "high", "fact_to_date")), "confidence")


def forecast_seasonal(spark, sf) -> DataFrame:
    """Value of the same month a year ago, for series of two years or more."""
    rows = fc.forecast(series(spark, sf).select("metric", "period_start", "period_end", "value"), "month")
    return rows.where(F.col("methods")["seasonal_naive"].isNotNull()).select("metric", F.round(F.col("methods")["seasonal_naive"], 3).alias("seasonal_naive"))


QUERIES.update({f.__name__: f for f in (forecast_methods, forecast_ensemble, forecast_scenario, forecast_months_to_year, forecast_seasonal)})
ORACLES["forecast_methods"] = oracle("SELECT metric, " + ", ".join(f"round(max(pred) FILTER (method = '{m}'), 3) AS {m}" for m in fc.METHODS[:3]) + " FROM wts GROUP BY metric", FOLDS)
ORACLES["forecast_ensemble"] = oracle(
    "SELECT metric, round(base, 3) AS base, round(CASE WHEN base > 0 THEN greatest(base - h, 0.0) ELSE base - h END, 3) AS low, round(base + h, 3) AS high, round(rel * 100, 3) AS backtest_error_pct, "
    "CASE WHEN n >= 12 AND rel <= 0.07 THEN 'высокая' WHEN n >= 4 AND rel <= 0.2 THEN 'средняя' ELSE 'низкая' END AS confidence FROM (SELECT *, abs(base) * rel * 1.28 AS h FROM ens)",
    FOLDS,
)
ORACLES["forecast_scenario"] = oracle("SELECT e.metric, round(p.v + (e.base - p.v) * 0.5, 3) AS base, round(p.v, 3) AS reference FROM ens e JOIN pts p ON p.metric = e.metric AND p.i = p.n - 1", FOLDS)
ORACLES["forecast_seasonal"] = oracle("SELECT metric, round(v[len(v) - 11], 3) AS seasonal_naive FROM (SELECT metric, list(CAST(value AS DOUBLE) ORDER BY period_end) AS v FROM series GROUP BY metric) WHERE len(v) >= 24")


def forecast_effects(spark, sf) -> DataFrame:
    years = _years(spark, sf)
    rows = an.forecast_effects(fc.forecast(years), years)
    return rows.select("metric", *(F.round(c, 3).alias(c) for c in ("vs_fact_abs", "vs_fact_pct", "interval_width", "interval_width_pct")))


QUERIES["forecast_effects"] = forecast_effects
ORACLES["forecast_effects"] = oracle(
    "SELECT e.metric, round(base - v, 3) AS vs_fact_abs, round((base - v) / nullif(v, 0) * 100, 3) AS vs_fact_pct, round(base + h - low, 3) AS interval_width, round((base + h - low) / nullif(abs(base), 0) * 100, 3) AS interval_width_pct "
    "FROM (SELECT *, abs(base) * rel * 1.28 AS h, CASE WHEN base > 0 THEN greatest(base - abs(base) * rel * 1.28, 0.0) ELSE base - abs(base) * rel * 1.28 END AS low FROM ens) e JOIN pts p ON p.metric = e.metric AND p.i = p.n - 1",
    FOLDS,
)

#: Monthly series towards the end of 2001, each fold with its training values, steps ahead and the months that count.
MONTHLY = """m AS (SELECT metric, list(CAST(value AS DOUBLE) ORDER BY period_end) AS v, count(*) AS n, max(period_end) AS last_end, coalesce(sum(CAST(value AS DOUBLE)) FILTER (year(period_start) = 2001), 0) AS own FROM series GROUP BY metric HAVING count(*) >= 2),
st AS (SELECT *, greatest((2001 - year(last_end + INTERVAL 1 DAY)) * 12 + 13 - month(last_end + INTERVAL 1 DAY), 1) AS steps FROM m), wi AS (SELECT *, CASE WHEN year(last_end) < 2001 THEN least(12, steps) ELSE steps END AS win FROM st),
fo AS (SELECT * FROM (SELECT *, unnest(CASE WHEN n >= 3 THEN [0, win, win + 1, win + 2] ELSE [0] END) AS f FROM wi) WHERE f = 0 OR n - f >= 2),
tr AS (SELECT metric, n, steps, win, f, v[1:n - f] AS t, n - f AS k, CASE WHEN f = 0 THEN steps ELSE win END AS ahead, list_sum(v[n - f + 1:n - f + win]) AS actual FROM fo),
tg AS (SELECT *, exp(list_sum(list_transform(range(1, k), lambda i: ln(t[i + 1] / t[i]))) / (k - 1)) AS g, list_avg(t) AS my, (k - 1) / 2.0 AS mx, range(ahead - win + 1, ahead + 1) AS path FROM tr),
ts AS (SELECT *, list_sum(list_transform(range(1, k + 1), lambda i: (i - 1 - mx) * (t[i] - my))) / list_sum(list_transform(range(1, k + 1), lambda i: (i - 1 - mx) * (i - 1 - mx))) AS s FROM tg),
mp AS (SELECT metric, n, steps, f, actual, 'naive' AS method, t[k] * win AS pred FROM ts UNION ALL SELECT metric, n, steps, f, actual, 'mean_growth', list_sum(list_transform(path, lambda i: t[k] * pow(g, i))) FROM ts
 UNION ALL SELECT metric, n, steps, f, actual, 'linear_trend', list_sum(list_transform(path, lambda i: my + s * (k - 1 + i - mx))) FROM ts UNION ALL SELECT metric, n, steps, f, actual, 'seasonal_naive', list_sum(list_transform(path, lambda i: t[k - 11 + (i - 1) % 12])) FROM ts WHERE k >= 12 AND n >= 24),
me AS (SELECT metric, steps, method, max(pred) FILTER (f = 0) AS pred, coalesce(avg(abs(pred - actual) / greatest(abs(actual), 1e-9)) FILTER (f > 0), CASE WHEN method = 'naive' AND steps > 1 THEN 0.5 END) AS err FROM mp GROUP BY metric, steps, method),
mw AS (SELECT *, CASE WHEN max(err) OVER q IS NULL THEN 1.0 ELSE 1 / (coalesce(err, greatest(max(err) OVER q, 0.15)) + 0.05) END AS w FROM me WHERE pred IS NOT NULL WINDOW q AS (PARTITION BY metric)),
ma AS (SELECT metric, sum(w * pred) / sum(w) AS base, CASE WHEN max(err) IS NULL THEN 0.15 ELSE sum(CASE WHEN err IS NOT NULL THEN w * err END) / sum(CASE WHEN err IS NOT NULL THEN w END) END AS rel FROM mw GROUP BY metric),
mr AS (SELECT metric, n, steps, base, rel, abs(base) * rel * 1.28 AS h, CASE WHEN year(last_end) = 2001 THEN own ELSE 0 END AS own FROM ma JOIN wi USING (metric))"""
ORACLES["forecast_months_to_year"] = oracle(
    "SELECT metric, CAST(n AS INTEGER) AS n, CAST(steps AS INTEGER) AS steps, round(base + own, 2) AS base, round(CASE WHEN base > 0 THEN greatest(base - h, 0.0) ELSE base - h END + own, 2) AS low, round(base + h + own, 2) AS high, round(CAST(own AS DOUBLE), 2) AS fact_to_date, "
    "CASE WHEN n >= 12 AND rel <= 0.07 THEN 'высокая' WHEN n >= 4 AND rel <= 0.2 THEN 'средняя' ELSE 'низкая' END AS confidence FROM mr",
    MONTHLY,
)
