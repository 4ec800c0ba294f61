"""Queries: time series preparation, folds, errors and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wideloom.operators import timeseries as ts
from wideloom.plans.registry import query, rounded, table, union_sql

# One row per event type and day, every day present; two days in five are emptied.
_DAILY = """d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY 1, 2),
s AS (SELECT event_type, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
c AS (SELECT event_type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM s),
r AS (SELECT c.event_type, c.day, d.value FROM c LEFT JOIN d ON c.event_type = d.event_type AND c.day = d.day)"""
_GAPS = _DAILY + ", g AS (SELECT event_type, day, CASE WHEN day(day) % 5 IN (1, 2) THEN NULL ELSE value END AS value FROM r)"
_DAY = "CAST(day AS VARCHAR) AS day"


def _daily(spark, d):
    return ts.resample(table(spark, d, "events"), ["event_type"], "ts", "value")


def _gaps(spark, d):
    return _daily(spark, d).withColumn("value", F.when(~(F.dayofmonth("day") % 5).isin(1, 2), F.col("value")))


def _text_day(df):
    return df.withColumn("day", F.col("day").cast("string"))


@query("ts_resample", f"WITH {_DAILY} SELECT event_type, {_DAY}, round(value, 4) AS value FROM r")
def ts_resample(spark, d):
    return rounded(_text_day(_daily(spark, d)), 4, "value")


@query("ts_resample_users", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY 1, 2),
s AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
c AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM s)
SELECT c.user_id, CAST(c.day AS VARCHAR) AS day, round(d.value, 4) AS value FROM c LEFT JOIN d ON c.user_id = d.user_id AND c.day = d.day""")
def ts_resample_users(spark, d):
    return rounded(_text_day(ts.resample(table(spark, d, "events"), ["user_id"], "ts", "value")), 4, "value")


@query("ts_ffill", f"WITH {_GAPS} SELECT event_type, {_DAY}, round(value, 4) AS value, round(last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day), 4) AS filled FROM g")
def ts_ffill(spark, d):
    return rounded(_text_day(ts.fill_forward(_gaps(spark, d), ["event_type"])), 4, "value", "filled")


@query("ts_linear", f"""WITH {_GAPS}, n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER p AS pd, last_value(value IGNORE NULLS) OVER p AS pv,
 first_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER f AS nd, first_value(value IGNORE NULLS) OVER f AS nv FROM g
 WINDOW p AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, {_DAY}, round(value, 4) AS value, round(coalesce(value, pv + (nv - pv) * date_diff('day', pd, n.day) / date_diff('day', pd, nd), pv, nv), 4) AS filled FROM n""")
def ts_linear(spark, d):
    return rounded(_text_day(ts.fill_linear(_gaps(spark, d), ["event_type"])), 4, "value", "filled")


@query("ts_lags", f"WITH {_DAILY} SELECT event_type, {_DAY}, round(value, 4) AS value, " + ", ".join(
    f"round(lag(value, {k}) OVER (PARTITION BY event_type ORDER BY r.day), 4) AS lag_{k}" for k in range(1, 8)) + " FROM r")
def ts_lags(spark, d):
    out = _text_day(ts.lags(_daily(spark, d), ["event_type"]))
    return rounded(out, 4, "value", *[f"lag_{k}" for k in range(1, 8)])


_ROLLS = [(f, n, size) for size in (7, 30) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]


@query("ts_rolling", f"WITH {_DAILY} SELECT event_type, {_DAY}, round(value, 4) AS value, " + ", ".join(
    f"round({f}(value) OVER (PARTITION BY event_type ORDER BY r.day ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW), 4) AS {n}_{size}" for f, n, size in _ROLLS) + " FROM r")
def ts_rolling(spark, d):
    return rounded(_text_day(ts.rolling(_daily(spark, d), ["event_type"])), 4, "value", *[f"{n}_{size}" for _, n, size in _ROLLS])


@query("ts_parts", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS day_of_week, CAST(month(o_orderdate) AS INTEGER) AS month, "
       "CAST(year(o_orderdate) AS INTEGER) AS year, dayofweek(o_orderdate) IN (0, 6) AS is_weekend FROM orders")
def ts_parts(spark, d):
    return ts.date_parts(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("ts_diff", f"WITH {_DAILY} SELECT event_type, {_DAY}, round(ln(value) - lag(ln(value), 1) OVER w, 6) AS log_diff, round(ln(value) - lag(ln(value), 7) OVER w, 6) AS seasonal_diff "
       "FROM r WINDOW w AS (PARTITION BY event_type ORDER BY r.day)")
def ts_diff(spark, d):
    return rounded(_text_day(ts.differences(_daily(spark, d), ["event_type"])).drop("value"), 6, "log_diff", "seasonal_diff")


_FOLDS = """b AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) + 1 AS days FROM orders),
w AS (SELECT lo, days, CAST(least(365, floor(days * 0.8)) AS INTEGER) AS size FROM b),
f AS (SELECT CAST(unnest(generate_series(0, CAST(floor((days - size - 30) / 7) AS INTEGER))) AS INTEGER) AS fold, lo, size FROM w),
k AS (SELECT fold, CAST(lo + CAST(fold * 7 AS INTEGER) AS DATE) AS train_start, CAST(lo + CAST(fold * 7 + size AS INTEGER) AS DATE) AS train_end,
      CAST(lo + CAST(fold * 7 + size + 30 AS INTEGER) AS DATE) AS test_end FROM f)"""


@query("ts_folds", f"WITH {_FOLDS} SELECT fold, CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end, CAST(test_end AS VARCHAR) AS test_end FROM k")
def ts_folds(spark, d):
    out = ts.folds(table(spark, d, "orders"), "o_orderdate")
    return out.select("fold", *[F.col(c).cast("string").alias(c) for c in ("train_start", "train_end", "test_end")])


def _fold_rows(spark, d):
    orders = table(spark, d, "orders")
    bounds = ts.folds(orders, "o_orderdate").orderBy("fold").collect()
    daily = orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return ts.assign_folds(daily, bounds)


@query("ts_fold_sizes", f"""WITH {_FOLDS} SELECT fold, CASE WHEN CAST(o_orderdate AS DATE) < train_end THEN 'train' ELSE 'test' END AS role, count(*) AS n
FROM orders JOIN k ON CAST(o_orderdate AS DATE) >= train_start AND CAST(o_orderdate AS DATE) < test_end GROUP BY 1, 2""")
def ts_fold_sizes(spark, d):
    return _fold_rows(spark, d).groupBy("fold", "role").agg(F.sum("n").alias("n"))


@query("ts_errors", f"""WITH {_FOLDS}, x AS (SELECT fold, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) < train_end AS is_train, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
 FROM orders JOIN k ON CAST(o_orderdate AS DATE) >= train_start AND CAST(o_orderdate AS DATE) < test_end GROUP BY 1, 2, 3),
p AS (SELECT fold, CAST(sum(CAST(total AS DECIMAL(28,2))) AS DOUBLE) / count(*) AS p FROM x WHERE is_train GROUP BY fold), e AS (SELECT x.fold, total AS y, p FROM x JOIN p ON x.fold = p.fold WHERE NOT is_train)
SELECT fold, count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg(power(y - p, 2))), 4) AS rmse, round(avg(abs(y - p) / nullif(abs(y), 0)) * 100, 4) AS mape,
 round(avg(2 * abs(y - p) / nullif(abs(y) + abs(p), 0)) * 100, 4) AS smape FROM e GROUP BY fold""")
def ts_errors(spark, d):
    """Mean forecast per walk-forward fold."""
    rows = _fold_rows(spark, d)
    mean = rows.where("role = 'train'").groupBy("fold").agg((F.sum(F.col("total").cast("decimal(28,2)")).cast("double") / F.count("*")).alias("forecast"))
    out = ts.errors(rows.where("role = 'test'").join(mean, "fold"), "total", "forecast", ["fold"])
    return rounded(out, 4, "mae", "rmse", "mape", "smape")


@query("ts_granularity", "WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events), g AS (SELECT event_type, date_diff('day', lag(day) OVER (PARTITION BY event_type ORDER BY day), day) AS gap FROM d) "
       "SELECT event_type, CAST(median(gap) AS DOUBLE) AS median_gap, CASE WHEN median(gap) <= 1 THEN 'daily' WHEN median(gap) BETWEEN 6 AND 8 THEN 'weekly' WHEN median(gap) BETWEEN 28 AND 31 THEN 'monthly' ELSE 'irregular' END AS granularity "
       "FROM g WHERE gap IS NOT NULL GROUP BY event_type")
def ts_granularity(spark, d):
    return ts.granularity(table(spark, d, "events"), "ts", ["event_type"])


_ACF = union_sql(f"SELECT event_type, {k} AS lag, corr(b, value) AS acf FROM (SELECT event_type, value, lag(value, {k}) OVER (PARTITION BY event_type ORDER BY r.day) AS b FROM r) t WHERE b IS NOT NULL GROUP BY event_type"
                 for k in range(1, 15))


@query("ts_autocorrelation", f"WITH {_DAILY}, a AS ({_ACF}) SELECT event_type, lag, round(acf, 6) AS acf FROM a")
def ts_autocorrelation(spark, d):
    return rounded(ts.autocorrelations(_daily(spark, d), ["event_type"]), 6, "acf")


@query("ts_seasonality", f"WITH {_DAILY}, a AS ({_ACF}), m AS (SELECT event_type, lag, acf, row_number() OVER (PARTITION BY event_type ORDER BY round(acf, 9) DESC, lag) AS k FROM a WHERE lag >= 2) "
       "SELECT event_type, lag AS period, round(acf, 6) AS acf FROM m WHERE k = 1")
def ts_seasonality(spark, d):
    return rounded(ts.seasonality(_daily(spark, d), ["event_type"]), 6, "acf")


@query("ts_stationarity", f"""WITH {_DAILY}, x AS (SELECT event_type, lag(value) OVER w AS l, value - lag(value) OVER w AS d FROM r WINDOW w AS (PARTITION BY event_type ORDER BY r.day)),
o AS (SELECT event_type, count(*) AS n, regr_slope(d, l) AS b, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy FROM x WHERE l IS NOT NULL AND d IS NOT NULL GROUP BY event_type)
SELECT event_type, n, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 4) AS t_stat, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) < -2.86 AS stationary FROM o""")
def ts_stationarity(spark, d):
    return rounded(ts.stationarity(_daily(spark, d), ["event_type"]), 4, "t_stat")


@query("ts_stationarity_lagged")
def ts_stationarity_lagged(spark, d):
    return rounded(ts.stationarity(_daily(spark, d), ["event_type"], n_lags=2), 4, "t_stat")


@query("ts_ar1", f"""WITH {_DAILY}, x AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY event_type ORDER BY r.day) AS l FROM r)
SELECT event_type, regr_count(y, l) AS n, round(regr_intercept(y, l), 4) AS intercept, round(regr_slope(y, l), 6) AS slope FROM x GROUP BY event_type""")
def ts_ar1(spark, d):
    fit = ts.fit_ar(_daily(spark, d), ["event_type"], order=1)
    return rounded(rounded(fit.select("event_type", "n", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("slope")), 4, "intercept"), 6, "slope")


@query("ts_forecast", f"""WITH RECURSIVE {_DAILY}, x AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY event_type ORDER BY r.day) AS l FROM r),
m AS (SELECT event_type, regr_intercept(y, l) AS a, regr_slope(y, l) AS b FROM x GROUP BY event_type),
e AS (SELECT event_type, arg_max(value, day) AS v, max(day) AS last_day FROM r GROUP BY event_type),
z(event_type, h, v) AS (SELECT e.event_type, 0, v FROM e UNION ALL SELECT z.event_type, h + 1, a + b * z.v FROM z JOIN m ON z.event_type = m.event_type WHERE h < 90)
SELECT z.event_type, CAST(CAST(last_day + h AS DATE) AS VARCHAR) AS day, round(z.v, 3) AS forecast FROM z JOIN e ON z.event_type = e.event_type WHERE h > 0""")
def ts_forecast(spark, d):
    fit = ts.fit_ar(_daily(spark, d), ["event_type"], order=1)
    return rounded(_text_day(ts.forecast_ar(fit, ["event_type"], order=1)), 3, "forecast")


@query("ts_forecast_ar7")
def ts_forecast_ar7(spark, d):
    return _text_day(ts.forecast_ar(ts.fit_ar(_daily(spark, d), ["event_type"]), ["event_type"]))


@query("ts_lag_forecast")
def ts_lag_forecast(spark, d):
    """Daily series, so 90 days ahead."""
    rows = _daily(spark, d).na.fill(0.0, ["value"])
    fitted, _ = ts.lag_regression(rows, ["event_type"])
    return _text_day(ts.forecast_lags(fitted, rows, ["event_type"], horizon=ts.weekly_horizon("daily")))


@query("ts_lag_regression")
def ts_lag_regression(spark, d):
    fitted = ts.lag_regression(ts.fill_forward(ts.resample(table(spark, d, "events"), ["user_id"], "ts", "value"), ["user_id"])
                               .withColumn("value", F.col("filled")).drop("filled"), ["user_id"])[1]
    return ts.errors(fitted, "actual", "prediction")
