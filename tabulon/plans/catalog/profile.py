"""Catalog entries for the profiling operators A-01..A-20."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import profile as pr
from tabulon.plans.catalog.common import (
    LINEITEM_NULLS_SQL, ORDERS_DIRTY_SQL, lineitem_nulls, orders_dirty, t, with_sql,
)

QUERIES = {}
SQL = {}

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def a01_overview(spark, sf_dir):
    return pr.overview(t(spark, sf_dir, "lineitem"), target="l_returnflag")


QUERIES["a01_overview"] = a01_overview
SQL["a01_overview"] = """
SELECT count(*) AS n_rows, 11 AS n_cols, 8 AS n_numeric, 3 AS n_categorical,
  'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax' AS numeric_columns,
  'l_returnflag,l_linestatus,l_shipdate' AS categorical_columns, 'l_returnflag' AS target
FROM lineitem
"""


def a02_missing_top8(spark, sf_dir):
    return pr.missing(lineitem_nulls(spark, sf_dir), top=8)


QUERIES["a02_missing_top8"] = a02_missing_top8
SQL["a02_missing_top8"] = with_sql(LINEITEM_NULLS_SQL, body="""
SELECT column_name, n_missing FROM (
  SELECT 'l_quantity' AS column_name, count(*) - count(l_quantity) AS n_missing, 2 AS pos FROM lineitem_nulls
  UNION ALL SELECT 'l_linestatus', count(*) - count(l_linestatus), 7 FROM lineitem_nulls)
WHERE n_missing > 0 ORDER BY n_missing DESC, pos LIMIT 8
""")


def a03_missing_percent(spark, sf_dir):
    return pr.missing(lineitem_nulls(spark, sf_dir), top=10, with_percent=True)


QUERIES["a03_missing_percent"] = a03_missing_percent
SQL["a03_missing_percent"] = with_sql(LINEITEM_NULLS_SQL, body="""
SELECT column_name, n_missing, round(n_missing / n * 100, 2) AS pct_missing FROM (
  SELECT 'l_quantity' AS column_name, count(*) - count(l_quantity) AS n_missing, count(*) AS n FROM lineitem_nulls
  UNION ALL SELECT 'l_linestatus', count(*) - count(l_linestatus), count(*) FROM lineitem_nulls)
WHERE n_missing > 0
""")


def a17_missing_exact(spark, sf_dir):
    return pr.missing_counts(lineitem_nulls(spark, sf_dir)).select("column_name", "n_missing", "n_rows")


_LN_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]
QUERIES["a17_missing_exact"] = a17_missing_exact
SQL["a17_missing_exact"] = with_sql(LINEITEM_NULLS_SQL, body="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, count(*) AS n_rows FROM lineitem_nulls"
    for c in _LN_COLS))


def a04_numeric_stats(spark, sf_dir):
    return pr.numeric_stats(t(spark, sf_dir, "lineitem"), LI_NUM)


QUERIES["a04_numeric_stats"] = a04_numeric_stats
SQL["a04_numeric_stats"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, round_even(avg({c}), 3) AS mean, round_even(stddev_samp({c}), 3) AS std, "
    f"round_even(min({c}), 3) AS min, round_even(max({c}), 3) AS max FROM lineitem" for c in LI_NUM)


def a05_describe(spark, sf_dir):
    d = pr.describe(t(spark, sf_dir, "lineitem"), LI_NUM)
    return d.select("column_name", "count", *[F.round(c, 6).alias(c) for c in
                                               ("mean", "std", "min", "p25", "p50", "p75", "max")])


QUERIES["a05_describe"] = a05_describe
SQL["a05_describe"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem" for c in LI_NUM)


def a06_column_read(spark, sf_dir):
    r = pr.column_read(t(spark, sf_dir, "orders"), "o_totalprice")
    return r.select("column_name", *[F.round(c, 4).alias(c) for c in ("mean", "median", "min", "max")])


QUERIES["a06_column_read"] = a06_column_read
SQL["a06_column_read"] = """
SELECT 'o_totalprice' AS column_name, round(avg(o_totalprice), 4) AS mean,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(min(o_totalprice), 4) AS min,
       round(max(o_totalprice), 4) AS max FROM orders
"""


def a07_value_counts(spark, sf_dir):
    return pr.value_counts(t(spark, sf_dir, "part"), "p_brand", top=5)


QUERIES["a07_value_counts"] = a07_value_counts
SQL["a07_value_counts"] = """
SELECT p_brand AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part) * 100, 1) AS pct
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY n DESC, value LIMIT 5
"""


def a07_target_distribution(spark, sf_dir):
    """Top-8 of the target as text, with nulls present in the data."""
    return pr.value_counts(lineitem_nulls(spark, sf_dir), "l_linestatus", top=8, as_string=True)


QUERIES["a07_target_distribution"] = a07_target_distribution
SQL["a07_target_distribution"] = with_sql(LINEITEM_NULLS_SQL, body="""
SELECT l_linestatus AS value, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM lineitem_nulls) * 100, 1) AS pct
FROM lineitem_nulls WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 8
""")


def a08_class_balance(spark, sf_dir):
    return pr.class_balance(t(spark, sf_dir, "orders"), "o_orderpriority")


QUERIES["a08_class_balance"] = a08_class_balance
SQL["a08_class_balance"] = """
SELECT o_orderpriority AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders) * 100, 2) AS pct
FROM orders GROUP BY 1
"""


def a09_distinct_counts(spark, sf_dir):
    return pr.distinct_counts(lineitem_nulls(spark, sf_dir), ["l_quantity", "l_linestatus", "l_returnflag", "l_tax"])


QUERIES["a09_distinct_counts"] = a09_distinct_counts
SQL["a09_distinct_counts"] = with_sql(LINEITEM_NULLS_SQL, body="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, "
    f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct_with_null FROM lineitem_nulls"
    for c in ["l_quantity", "l_linestatus", "l_returnflag", "l_tax"]))


def a10_correlation(spark, sf_dir):
    return pr.correlations(t(spark, sf_dir, "lineitem"), LI_NUM).select("col_a", "col_b", "r")


def _corr_sql():
    parts = []
    for i, a in enumerate(LI_NUM):
        for j, b in enumerate(LI_NUM):
            if i == j:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, 1.0 AS r")
            else:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 2) AS r FROM lineitem")
    return "\nUNION ALL\n".join(parts)


QUERIES["a10_correlation"] = a10_correlation
SQL["a10_correlation"] = _corr_sql()


# 30 columns over lineitem, some with gaps: value, multiplier, divisor of each
WIDE = [(v, m, 3 + (7 * i + 5 * m) % 11) for i, v in enumerate(["l_quantity", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"])
        for m in range(1, 7)]


def _wide_columns():
    """name -> SQL text of the column, the same in both engines: (value * m) % d, null where the value meets d."""
    return {f"w{k:02d}": f"CASE WHEN CAST({v} AS BIGINT) % {d + 4} = 0 THEN NULL "
                         f"ELSE CAST({v} * {m} AS BIGINT) % {d} + {v} / 1e3 END" for k, (v, m, d) in enumerate(WIDE)}


def a10_wide_correlation(spark, sf_dir):
    """More columns than one aggregate takes: Gram matrices by blocks."""
    li = t(spark, sf_dir, "lineitem")
    wide = li.select(*[F.expr(x).alias(c) for c, x in _wide_columns().items()])
    return pr.correlations(wide, digits=6).select("col_a", "col_b", "r")


QUERIES["a10_wide_correlation"] = a10_wide_correlation
SQL["a10_wide_correlation"] = (
    "WITH w AS (SELECT " + ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in _wide_columns().items())
    + " FROM lineitem),\nc AS (SELECT "
    + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for a in _wide_columns() for b in _wide_columns() if a < b)
    + " FROM w)\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + ("1.0" if a == b else f"round({min(a, b)}_{max(a, b)}, 6)")
        + " AS r FROM c" for a in _wide_columns() for b in _wide_columns()))


def a11_strongest_pair(spark, sf_dir):
    return pr.strongest_pair(t(spark, sf_dir, "lineitem"), LI_NUM).select(
        "col_a", "col_b", F.round("r", 6).alias("r"), F.round("abs_r", 6).alias("abs_r"))


def _strongest_sql():
    parts = []
    for i, a in enumerate(LI_NUM):
        for j, b in enumerate(LI_NUM):
            if i < j:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r, {i} AS pa, {j} AS pb FROM lineitem")
    return ("SELECT col_a, col_b, round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM (\n"
            + "\nUNION ALL\n".join(parts) + ") ORDER BY abs(r) DESC, pa, pb LIMIT 1")


QUERIES["a11_strongest_pair"] = a11_strongest_pair
SQL["a11_strongest_pair"] = _strongest_sql()


def a12_iqr_outliers(spark, sf_dir):
    o = pr.iqr_outliers(t(spark, sf_dir, "lineitem"), LI_NUM)
    return o.select("column_name", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "lower", "upper")], "n_outliers")


QUERIES["a12_iqr_outliers"] = a12_iqr_outliers
SQL["a12_iqr_outliers"] = "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS lower,
       round(q3 + 1.5 * (q3 - q1), 6) AS upper,
       (SELECT count(*) FROM lineitem WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""" for c in LI_NUM)


def a13_histogram(spark, sf_dir):
    h = pr.histogram(t(spark, sf_dir, "lineitem"), "l_extendedprice", bins=30)
    return h.select("bin", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "n")


QUERIES["a13_histogram"] = a13_histogram
SQL["a13_histogram"] = """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n
      FROM lineitem, s GROUP BY 1)
SELECT g.bin, round(lo + (hi - lo) / 30 * g.bin, 4) AS lower, round(lo + (hi - lo) / 30 * (g.bin + 1), 4) AS upper,
       coalesce(c.n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) g CROSS JOIN s LEFT JOIN c ON g.bin = c.bin
"""


def a14_crosstab_share(spark, sf_dir):
    return pr.crosstab(t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", normalize=True)


QUERIES["a14_crosstab_share"] = a14_crosstab_share
SQL["a14_crosstab_share"] = """
SELECT l_returnflag AS row_value, l_linestatus AS col_value, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 2) AS share
FROM lineitem GROUP BY 1, 2
"""


def a15_crosstab_counts(spark, sf_dir):
    return pr.crosstab(t(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


QUERIES["a15_crosstab_counts"] = a15_crosstab_counts
SQL["a15_crosstab_counts"] = """
SELECT o_orderstatus AS row_value, o_orderpriority AS col_value, count(*) AS n FROM orders GROUP BY 1, 2
"""


def a16_column_metadata(spark, sf_dir):
    return pr.column_metadata(orders_dirty(spark, sf_dir).drop("ship_date_text"), ["o_orderkey"])


_OD_COLS = [("o_orderkey", "int64"), ("price_text", "object"), ("o_orderpriority", "object"),
            ("o_orderstatus", "object"), ("constant_col", "object"), ("empty_col", "float64"),
            ("Unnamed: 0", "int64"), ("o_totalprice", "float64")]
QUERIES["a16_column_metadata"] = a16_column_metadata
SQL["a16_column_metadata"] = with_sql(ORDERS_DIRTY_SQL, body="\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, '{d}' AS dtype, round_even((count(*) - count("{c}")) / count(*), 3) AS nulls_pct,
  count(DISTINCT "{c}") AS nunique,
  (SELECT nullif(string_agg(v, ' | ' ORDER BY o_orderkey), '') FROM (
     SELECT CAST("{c}" AS VARCHAR) AS v, o_orderkey FROM orders_dirty WHERE "{c}" IS NOT NULL
     ORDER BY o_orderkey LIMIT 3)) AS examples
FROM orders_dirty""" for c, d in _OD_COLS))


def a20_column_summary(spark, sf_dir):
    return pr.column_summary(t(spark, sf_dir, "customer"), ["c_custkey"])


_CU_COLS = [("c_custkey", "int64"), ("c_name", "object"), ("c_nationkey", "int64"), ("c_acctbal", "float64"),
            ("c_mktsegment", "object")]
QUERIES["a20_column_summary"] = a20_column_summary
SQL["a20_column_summary"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, '{d}' AS dtype, count(DISTINCT {c}) AS nunique,
  CAST(arg_min({c}, c_custkey) AS VARCHAR) AS first_value FROM customer""" for c, d in _CU_COLS)


def a18_schema_report(spark, sf_dir):
    rules = {"target": "l_returnflag", "drop": ["l_partkey", "l_suppkey"], "rename": {}, "cast": {},
             "impute": {"l_quantity": "median"}}
    return pr.schema_report(lineitem_nulls(spark, sf_dir), rules)


QUERIES["a18_schema_report"] = a18_schema_report
SQL["a18_schema_report"] = with_sql(LINEITEM_NULLS_SQL, body="""
SELECT 'n_rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM lineitem_nulls
UNION ALL SELECT 'n_cols', '9'
UNION ALL SELECT 'columns', 'l_orderkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate'
UNION ALL SELECT 'numeric', 'l_orderkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax'
UNION ALL SELECT 'categorical', 'l_returnflag,l_linestatus,l_shipdate'
UNION ALL SELECT 'target', 'l_returnflag'
UNION ALL SELECT 'flagged.dropped', 'l_partkey,l_suppkey'
UNION ALL SELECT 'flagged.renamed', ''
UNION ALL SELECT 'flagged.cast', ''
UNION ALL SELECT 'flagged.imputed', 'l_quantity:median'
UNION ALL SELECT 'missing.l_quantity', CAST(count(*) - count(l_quantity) AS VARCHAR) FROM lineitem_nulls
UNION ALL SELECT 'missing.l_linestatus', CAST(count(*) - count(l_linestatus) AS VARCHAR) FROM lineitem_nulls
""")


def a19_dataset_context(spark, sf_dir):
    return pr.dataset_context(t(spark, sf_dir, "customer"), ["c_custkey"], target="c_mktsegment")


def _context_sql():
    parts = []
    for c in ("c_custkey", "c_nationkey", "c_acctbal"):
        stats = [f"format('{{:,.2f}}', CAST({f}({c}) AS DOUBLE))" for f in ("min", "max", "avg")]
        parts.append(f"SELECT 'numeric' AS section, '{c}' AS column_name, unnest(['min', 'max', 'avg', 'unique']) AS key, "
                     f"unnest(v) AS value FROM (SELECT [{', '.join(stats)}, CAST(count(DISTINCT {c}) AS VARCHAR)] AS v "
                     f"FROM customer)")
    for section, c, k in (("text", "c_name", 5), ("text", "c_mktsegment", 5), ("target", "c_mktsegment", 10)):
        parts.append(f"""SELECT '{section}', '{c}', CASE WHEN length(v) > 40 THEN v[1:40] || '…' ELSE v END,
  CAST(n AS VARCHAR) || ' (' || CAST(round(n / (SELECT count(*) FROM customer) * 100, 1) AS VARCHAR) || '%)'
FROM (SELECT {c} AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT {k})""")
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"):
        parts.append(f"""SELECT 'sample', '{c}', CAST(r AS VARCHAR), substring(coalesce(CAST({c} AS VARCHAR), 'nan'), 1, 30)
FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r <= 20""")
    return "\nUNION ALL\n".join(parts)


QUERIES["a19_dataset_context"] = a19_dataset_context
SQL["a19_dataset_context"] = _context_sql()


def a17_missing_scaled(spark, sf_dir):
    return pr.missing_scaled(lineitem_nulls(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_shipdate"], 200)


QUERIES["a17_missing_scaled"] = a17_missing_scaled
SQL["a17_missing_scaled"] = with_sql(LINEITEM_NULLS_SQL, """
s AS (SELECT * FROM lineitem_nulls
      ORDER BY md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                             CAST(l_shipdate AS VARCHAR))) LIMIT 200)""", body="""
SELECT column_name, CAST(round_even(m * (SELECT count(*) FROM lineitem_nulls) / 200.0, 0) AS BIGINT)
         AS n_missing_estimate
FROM (SELECT 'l_quantity' AS column_name, count(*) - count(l_quantity) AS m FROM s
      UNION ALL SELECT 'l_linestatus', count(*) - count(l_linestatus) FROM s) WHERE m > 0""")
