"""Catalog entries for F-01..F-06 and W-04/W-05 (orders: 80 months of order values)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import forecast as fc
from tabulon.plans.catalog.common import ORDERS_DIRTY_SQL, orders_dirty, t, with_sql

QUERIES = {}
SQL = {}


def f03_order_value_trend(spark, sf_dir):
    return fc.trend(t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", periods=6)


QUERIES["f03_order_value_trend"] = f03_order_value_trend
SQL["f03_order_value_trend"] = """
WITH m AS (
  SELECT last_day(o_orderdate) AS month_end, avg(o_totalprice) AS value_mean, count(*) AS n_rows
  FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)
  GROUP BY 1),
i AS (SELECT *, CAST(row_number() OVER (ORDER BY month_end) - 1 AS DOUBLE) AS month_idx FROM m),
fit AS (
  SELECT regr_slope(value_mean, month_idx) AS slope, regr_intercept(value_mean, month_idx) AS intercept,
         count(*) AS n_months, CAST(sum(n_rows) AS BIGINT) AS n_dated_rows, avg(value_mean) AS hist_avg,
         arg_max(value_mean, month_end) AS last_actual, max(month_end) AS last_month
  FROM i HAVING sum(n_rows) >= 5 AND count(*) >= 3)
SELECT step,
       last_day(last_month + to_months(CAST(step AS INTEGER))) AS month_end,
       round(intercept + slope * (n_months - 1 + step), 4) AS forecast,
       round(slope, 4) AS slope, round(intercept, 4) AS intercept,
       CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
       n_months, round(hist_avg, 4) AS hist_avg, round(last_actual, 4) AS last_actual,
       round((intercept + slope * (n_months - 1 + 6) - last_actual) / greatest(abs(last_actual), 1.0) * 100, 4)
         AS change_pct
FROM fit, range(1, 7) r(step)
"""


def f03_trend_by_status(spark, sf_dir):
    return fc.trend(t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", periods=3, by=["o_orderstatus"])


QUERIES["f03_trend_by_status"] = f03_trend_by_status
SQL["f03_trend_by_status"] = """
WITH m AS (
  SELECT o_orderstatus, last_day(o_orderdate) AS month_end, avg(o_totalprice) AS value_mean, count(*) AS n_rows
  FROM orders GROUP BY 1, 2),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY month_end) - 1 AS DOUBLE) AS month_idx
      FROM m),
fit AS (
  SELECT o_orderstatus, regr_slope(value_mean, month_idx) AS slope, regr_intercept(value_mean, month_idx) AS intercept,
         count(*) AS n_months, CAST(sum(n_rows) AS BIGINT) AS n_dated_rows, avg(value_mean) AS hist_avg,
         arg_max(value_mean, month_end) AS last_actual, max(month_end) AS last_month
  FROM i GROUP BY o_orderstatus HAVING sum(n_rows) >= 5 AND count(*) >= 3)
SELECT o_orderstatus, step,
       last_day(last_month + to_months(CAST(step AS INTEGER))) AS month_end,
       round(intercept + slope * (n_months - 1 + step), 4) AS forecast,
       round(slope, 4) AS slope, round(intercept, 4) AS intercept,
       CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
       n_months, round(hist_avg, 4) AS hist_avg, round(last_actual, 4) AS last_actual,
       round((intercept + slope * (n_months - 1 + 3) - last_actual) / greatest(abs(last_actual), 1.0) * 100, 4)
         AS change_pct
FROM fit, range(1, 4) r(step)
"""


def f02_monthly_mean(spark, sf_dir):
    m = fc.monthly(t(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice")
    return m.select("month_end", F.round("value_mean", 4).alias("value_mean"), "n_rows")


QUERIES["f02_monthly_mean"] = f02_monthly_mean
SQL["f02_monthly_mean"] = """
SELECT last_day(l_shipdate) AS month_end, round(avg(l_extendedprice), 4) AS value_mean, count(*) AS n_rows
FROM lineitem GROUP BY 1
"""


def f01_date_columns(spark, sf_dir):
    return fc.date_columns(orders_dirty(spark, sf_dir))


QUERIES["f01_date_columns"] = f01_date_columns
SQL["f01_date_columns"] = with_sql(ORDERS_DIRTY_SQL, body="""
SELECT 'ship_date_text' AS column_name, 'parsed_text' AS kind,
       round(count(try_strptime(ship_date_text, '%Y-%m-%d')) / count(*), 4) AS parsed_fraction
FROM orders_dirty
HAVING count(try_strptime(ship_date_text, '%Y-%m-%d')) > 0.5 * count(*)
""")


def f05_guards_by_priority(spark, sf_dir):
    return fc.forecast_guards(t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice",
                              by=["o_orderpriority"], min_rows=5, min_months=3)


QUERIES["f05_guards_by_priority"] = f05_guards_by_priority
SQL["f05_guards_by_priority"] = """
WITH m AS (SELECT o_orderpriority, last_day(o_orderdate) AS month_end, count(*) AS n_rows FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, CAST(sum(n_rows) AS BIGINT) AS n_dated_rows, count(*) AS n_months,
       CASE WHEN sum(n_rows) < 5 THEN 'not enough dated rows' WHEN count(*) < 3 THEN 'not enough months' END AS reason,
       (sum(n_rows) >= 5 AND count(*) >= 3) AS ok
FROM m GROUP BY 1
"""


def f05_guards_events(spark, sf_dir):
    """Events span one month only, so the month guard must fail."""
    return fc.forecast_guards(t(spark, sf_dir, "events"), "ts", "value", by=["event_type"])


QUERIES["f05_guards_events"] = f05_guards_events
SQL["f05_guards_events"] = """
WITH m AS (SELECT event_type, last_day(ts) AS month_end, count(*) AS n_rows FROM events GROUP BY 1, 2)
SELECT event_type, CAST(sum(n_rows) AS BIGINT) AS n_dated_rows, count(*) AS n_months,
       CASE WHEN sum(n_rows) < 5 THEN 'not enough dated rows' WHEN count(*) < 3 THEN 'not enough months' END AS reason,
       (sum(n_rows) >= 5 AND count(*) >= 3) AS ok
FROM m GROUP BY 1
"""


def w04_month_index(spark, sf_dir):
    m = fc.month_index(t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", by=["o_orderstatus"])
    return m.select("o_orderstatus", "month_end", "month_idx", F.round("value_mean", 4).alias("value_mean"))


QUERIES["w04_month_index"] = w04_month_index
SQL["w04_month_index"] = """
SELECT o_orderstatus, month_end,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY month_end) - 1 AS month_idx,
       round(value_mean, 4) AS value_mean
FROM (SELECT o_orderstatus, last_day(o_orderdate) AS month_end, avg(o_totalprice) AS value_mean
      FROM orders GROUP BY 1, 2)
"""


def w05_latest_value(spark, sf_dir):
    m = fc.latest_value(t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", by=["o_orderpriority"])
    return m.select("o_orderpriority", "month_end", F.round("latest_value", 4).alias("latest_value"))


QUERIES["w05_latest_value"] = w05_latest_value
SQL["w05_latest_value"] = """
SELECT o_orderpriority, max(month_end) AS month_end, round(arg_max(value_mean, month_end), 4) AS latest_value
FROM (SELECT o_orderpriority, last_day(o_orderdate) AS month_end, avg(o_totalprice) AS value_mean
      FROM orders GROUP BY 1, 2)
GROUP BY 1
"""


def f06_available_analyses(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    classes = sorted(r[0] for r in o.select("o_orderstatus").distinct().collect())  # class labels only
    return fc.available_analyses(o, "o_orderstatus", classes)


QUERIES["f06_available_analyses"] = f06_available_analyses
SQL["f06_available_analyses"] = """
WITH nums(k, value) AS (VALUES (1, 'o_orderkey'), (2, 'o_custkey'), (3, 'o_totalprice')),
opts AS (
  SELECT k AS place, 'forecast' AS kind, value, 'o_orderdate' AS date_column FROM nums
  UNION ALL SELECT 4, 'classify', 'o_orderstatus', NULL WHERE EXISTS (SELECT 1 FROM orders)
  UNION ALL SELECT 4 + k, 'regress', value, NULL FROM nums
  UNION ALL SELECT 8, 'custom', NULL, NULL)
SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS rank, kind, value, date_column FROM opts
"""


def f04_projected_change(spark, sf_dir):
    """Historical average and projected end-of-horizon change of the shipped-value series."""
    tr = fc.trend(t(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice", periods=6)
    return tr.where(F.col("step") == 6).select("n_months", "hist_avg", "last_actual", "forecast", "change_pct",
                                               "direction")


QUERIES["f04_projected_change"] = f04_projected_change
SQL["f04_projected_change"] = """
WITH m AS (SELECT last_day(l_shipdate) AS month_end, avg(l_extendedprice) AS value_mean, count(*) AS n_rows
           FROM lineitem GROUP BY 1),
i AS (SELECT *, CAST(row_number() OVER (ORDER BY month_end) - 1 AS DOUBLE) AS month_idx FROM m),
fit AS (SELECT regr_slope(value_mean, month_idx) AS slope, regr_intercept(value_mean, month_idx) AS intercept,
               count(*) AS n_months, avg(value_mean) AS hist_avg, arg_max(value_mean, month_end) AS last_actual
        FROM i)
SELECT n_months, round(hist_avg, 4) AS hist_avg, round(last_actual, 4) AS last_actual,
       round(intercept + slope * (n_months - 1 + 6), 4) AS forecast,
       round((intercept + slope * (n_months - 1 + 6) - last_actual) / greatest(abs(last_actual), 1.0) * 100, 4)
         AS change_pct,
       CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction
FROM fit"""
