"""Catalog entries for the cleaning operators C-01..C-26 over injected-dirt views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import clean as cl
from tabulon.plans.catalog.common import (
    LINEITEM_NULLS_SQL, ORDERS_DIRTY_SQL, PART_DIRTY_SQL, lineitem_nulls, orders_dirty, part_dirty, t, with_sql,
)

QUERIES = {}
SQL = {}

MARKERS_SQL = ", ".join("'" + m.replace("'", "''") + "'" for m in cl.NA_MARKERS)


def _trim(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _na(x):
    return f"CASE WHEN {_trim(x)} IN ({MARKERS_SQL}) THEN NULL ELSE {_trim(x)} END"


def _num_text(x):
    return (f"TRY_CAST({_trim(f'''regexp_replace(regexp_replace({x}, '[$£€¥₹,\\s%]', '', 'g'), '[A-Za-z]+', '', 'g')''')}"
            " AS DOUBLE)")


def c01_strip_names(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(" o_orderkey "),
                                          F.col("o_totalprice").alias("o_totalprice\t"))
    return cl.strip_names(o)


QUERIES["c01_strip_names"] = c01_strip_names
SQL["c01_strip_names"] = "SELECT o_orderkey, o_totalprice FROM orders"


def c02_drop_unnamed(spark, sf_dir):
    return cl.drop_unnamed(orders_dirty(spark, sf_dir).select("o_orderkey", "`Unnamed: 0`", "o_totalprice"))


QUERIES["c02_drop_unnamed"] = c02_drop_unnamed
SQL["c02_drop_unnamed"] = "SELECT o_orderkey, o_totalprice FROM orders"


def c03_dedupe_names(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").toDF("k", "k", "k")
    return cl.dedupe_names(o)


QUERIES["c03_dedupe_names"] = c03_dedupe_names
SQL["c03_dedupe_names"] = "SELECT o_orderkey AS k, o_custkey AS k_1, o_totalprice AS k_2 FROM orders"


def _orders_holes(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    hole = F.col("o_orderkey") % 9 == 0
    return o.select(*[F.when(hole, F.lit(None)).otherwise(F.col(c)).alias(c)
                      for c in ("o_orderkey", "o_orderstatus", "o_totalprice")])


def c04_drop_empty_rows(spark, sf_dir):
    return cl.drop_empty_rows(_orders_holes(spark, sf_dir))


QUERIES["c04_drop_empty_rows"] = c04_drop_empty_rows
SQL["c04_drop_empty_rows"] = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 9 <> 0"


def c05_drop_empty_columns(spark, sf_dir):
    return cl.drop_empty_columns(orders_dirty(spark, sf_dir).select("o_orderkey", "empty_col", "o_totalprice"))


QUERIES["c05_drop_empty_columns"] = c05_drop_empty_columns
SQL["c05_drop_empty_columns"] = "SELECT o_orderkey, o_totalprice FROM orders"


def c06_missing_markers(spark, sf_dir):
    return cl.normalize_missing(orders_dirty(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_orderstatus"))


QUERIES["c06_missing_markers"] = c06_missing_markers
SQL["c06_missing_markers"] = with_sql(ORDERS_DIRTY_SQL, body=f"""
SELECT o_orderkey, {_na('o_orderpriority')} AS o_orderpriority, {_na('o_orderstatus')} AS o_orderstatus
FROM orders_dirty""")


def c07_numeric_text(spark, sf_dir):
    od = orders_dirty(spark, sf_dir).select("o_orderkey", "price_text", "o_orderpriority", "ship_date_text")
    return cl.coerce_numeric_text(cl.normalize_missing(od))


QUERIES["c07_numeric_text"] = c07_numeric_text
SQL["c07_numeric_text"] = with_sql(ORDERS_DIRTY_SQL, body=f"""
SELECT o_orderkey, {_num_text(_na('price_text'))} AS price_text, {_na('o_orderpriority')} AS o_orderpriority,
       {_na('ship_date_text')} AS ship_date_text
FROM orders_dirty""")


def c07_unit_suffix(spark, sf_dir):
    return cl.coerce_numeric_text(part_dirty(spark, sf_dir).select("p_partkey", "weight_text", "p_brand"))


QUERIES["c07_unit_suffix"] = c07_unit_suffix
SQL["c07_unit_suffix"] = with_sql(PART_DIRTY_SQL, body=f"""
SELECT p_partkey, {_num_text('weight_text')} AS weight_text, p_brand FROM part_dirty""")


def c08_bool_to_int(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("big_order"))
    return cl.bool_to_int(o)


QUERIES["c08_bool_to_int"] = c08_bool_to_int
SQL["c08_bool_to_int"] = "SELECT o_orderkey, CAST(o_totalprice > 100000 AS BIGINT) AS big_order FROM orders"


def c09_drop_sparse(spark, sf_dir):
    return cl.drop_sparse_columns(part_dirty(spark, sf_dir))


QUERIES["c09_drop_sparse"] = c09_drop_sparse
SQL["c09_drop_sparse"] = with_sql(PART_DIRTY_SQL, body="""
SELECT p_partkey, p_brand, p_type, weight_text, p_retailprice FROM part_dirty""")


def c10_drop_id_like(spark, sf_dir):
    return cl.drop_id_like(t(spark, sf_dir, "customer"))


QUERIES["c10_drop_id_like"] = c10_drop_id_like
SQL["c10_drop_id_like"] = "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def c11_drop_constant(spark, sf_dir):
    return cl.drop_constant(orders_dirty(spark, sf_dir).select("o_orderkey", "constant_col", "empty_col", "o_orderstatus"))


QUERIES["c11_drop_constant"] = c11_drop_constant
SQL["c11_drop_constant"] = with_sql(ORDERS_DIRTY_SQL, body="SELECT o_orderkey, o_orderstatus FROM orders_dirty")


def c12a_text_dates(spark, sf_dir):
    return cl.expand_dates(orders_dirty(spark, sf_dir).select("o_orderkey", "ship_date_text"))


QUERIES["c12a_text_dates"] = c12a_text_dates
SQL["c12a_text_dates"] = with_sql(ORDERS_DIRTY_SQL, body="""
SELECT o_orderkey, year(d) AS ship_date_text_year, month(d) AS ship_date_text_month,
       isodow(d) - 1 AS ship_date_text_dow
FROM (SELECT o_orderkey, try_strptime(ship_date_text, '%Y-%m-%d') AS d FROM orders_dirty)""")


def c12b_timestamp_parts(spark, sf_dir):
    return cl.expand_dates(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))


QUERIES["c12b_timestamp_parts"] = c12b_timestamp_parts
SQL["c12b_timestamp_parts"] = """
SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
       isodow(o_orderdate) - 1 AS o_orderdate_dow FROM orders"""


def c13_default_target(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("revenue"))
    return cl.add_default_target(o, "sales_category")


QUERIES["c13_default_target"] = c13_default_target
SQL["c13_default_target"] = """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.33) AS q33, quantile_cont(o_totalprice, 0.67) AS q67 FROM orders)
SELECT o_orderkey, o_totalprice AS revenue,
       CASE WHEN o_totalprice <= q33 THEN 'low' WHEN o_totalprice <= q67 THEN 'medium' ELSE 'high' END AS sales_category
FROM orders, q"""


def c14_median_fill(spark, sf_dir):
    return cl.fill_numeric_median(lineitem_nulls(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity"))


QUERIES["c14_median_fill"] = c14_median_fill
SQL["c14_median_fill"] = with_sql(LINEITEM_NULLS_SQL, body="""
SELECT l_orderkey, l_linenumber,
       coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_nulls)) AS l_quantity
FROM lineitem_nulls""")


def c15_mode_fill(spark, sf_dir):
    od = cl.normalize_missing(orders_dirty(spark, sf_dir).select("o_orderkey", "o_orderpriority"))
    return cl.fill_text_mode(od)


QUERIES["c15_mode_fill"] = c15_mode_fill
SQL["c15_mode_fill"] = with_sql(ORDERS_DIRTY_SQL, f"""
c AS (SELECT o_orderkey, {_na('o_orderpriority')} AS p FROM orders_dirty)""", body="""
SELECT o_orderkey, coalesce(p, (SELECT p FROM c WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1))
       AS o_orderpriority
FROM c""")


def c16_category_codes(spark, sf_dir):
    return cl.encode_categories(t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"))


QUERIES["c16_category_codes"] = c16_category_codes
SQL["c16_category_codes"] = """
SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type,
       p_size FROM part"""


def c17_clean_pipeline(spark, sf_dir):
    return cl.clean(orders_dirty(spark, sf_dir), target="o_orderstatus")


QUERIES["c17_clean_pipeline"] = c17_clean_pipeline
SQL["c17_clean_pipeline"] = with_sql(ORDERS_DIRTY_SQL, f"""
c AS (SELECT o_orderkey, {_num_text(_na('price_text'))} AS price_text, {_na('o_orderpriority')} AS prio,
             {_na('o_orderstatus')} AS o_orderstatus, o_totalprice,
             try_strptime({_na('ship_date_text')}, '%Y-%m-%d') AS d FROM orders_dirty)""",
                                     """
f AS (SELECT *, coalesce(prio, (SELECT prio FROM c WHERE prio IS NOT NULL GROUP BY prio
                                ORDER BY count(*) DESC, prio LIMIT 1)) AS prio_f FROM c)""", body="""
SELECT o_orderkey, price_text, dense_rank() OVER (ORDER BY prio_f) - 1 AS o_orderpriority, o_orderstatus,
       o_totalprice, year(d) AS ship_date_text_year, month(d) AS ship_date_text_month,
       isodow(d) - 1 AS ship_date_text_dow
FROM f""")


def c19_default_rules(spark, sf_dir):
    return cl.default_rules(part_dirty(spark, sf_dir))


QUERIES["c19_default_rules"] = c19_default_rules
SQL["c19_default_rules"] = with_sql(PART_DIRTY_SQL, """
s AS (
  SELECT 'p_partkey' AS column_name, 0 AS pos, false AS is_text, true AS is_num,
         (count(*) - count(p_partkey)) / count(*) AS miss, count(DISTINCT p_partkey) / count(*) AS uniq,
         count(DISTINCT p_partkey) AS nd FROM part_dirty
  UNION ALL SELECT 'p_brand', 1, true, false, (count(*) - count(p_brand)) / count(*),
         count(DISTINCT p_brand) / count(*), count(DISTINCT p_brand) FROM part_dirty
  UNION ALL SELECT 'p_type', 2, true, false, (count(*) - count(p_type)) / count(*),
         count(DISTINCT p_type) / count(*), count(DISTINCT p_type) FROM part_dirty
  UNION ALL SELECT 'p_size_sparse', 3, false, true, (count(*) - count(p_size_sparse)) / count(*),
         count(DISTINCT p_size_sparse) / count(*), count(DISTINCT p_size_sparse) FROM part_dirty
  UNION ALL SELECT 'weight_text', 4, true, false, (count(*) - count(weight_text)) / count(*),
         count(DISTINCT weight_text) / count(*), count(DISTINCT weight_text) FROM part_dirty
  UNION ALL SELECT 'p_retailprice', 5, false, true, (count(*) - count(p_retailprice)) / count(*),
         count(DISTINCT p_retailprice) / count(*), count(DISTINCT p_retailprice) FROM part_dirty)""",
                                    """
r AS (SELECT column_name, pos, is_text, nd,
        CASE WHEN miss > 0.7 THEN 'drop' WHEN is_text AND uniq > 0.9 THEN 'drop' ELSE 'impute' END AS action,
        CASE WHEN miss > 0.7 THEN 'missing' WHEN is_text AND uniq > 0.9 THEN 'id_like'
             WHEN is_num THEN 'median' ELSE 'mode' END AS arg FROM s)""", body="""
SELECT column_name, action, arg FROM r
UNION ALL
SELECT * FROM (SELECT column_name, 'target' AS action, CAST(NULL AS VARCHAR) AS arg FROM r
               WHERE is_text AND action = 'impute' ORDER BY nd, pos LIMIT 1)""")


def c18_validate_default_rules(spark, sf_dir):
    """Rules derived from the data (C-19), turned into a rule dict and validated (C-18)."""
    rules = cl.rules_to_dict(cl.default_rules(part_dirty(spark, sf_dir)))
    return spark.createDataFrame([(cl.validate_rules(rules), len(rules["drop"]), len(rules["impute"]),
                                   rules["target"])], "valid boolean, n_drop long, n_impute long, target string")


QUERIES["c18_validate_default_rules"] = c18_validate_default_rules
SQL["c18_validate_default_rules"] = SQL["c19_default_rules"].replace(
    "\nSELECT column_name, action, arg FROM r\nUNION ALL", ",\nrules AS (SELECT column_name, action, arg FROM r\nUNION ALL") \
    .rstrip() + """),
final AS (SELECT true AS valid,
                 count(*) FILTER (WHERE action = 'drop') AS n_drop,
                 count(*) FILTER (WHERE action = 'impute') AS n_impute,
                 max(CASE WHEN action = 'target' THEN column_name END) AS target FROM rules)
SELECT * FROM final"""


RULES = {
    "drop": ["Unnamed: 0", "empty_col", "no_such_column"],
    "rename": {"o_orderpriority": "priority"},
    "cast": {"price_text": "float", "o_orderkey": "str"},
    "impute": {"priority": "mode", "o_totalprice": "median", "constant_col": "zero"},
    "target": "o_orderstatus",
}


def c20_apply_drop(spark, sf_dir):
    return cl.apply_drop(orders_dirty(spark, sf_dir), RULES["drop"])


QUERIES["c20_apply_drop"] = c20_apply_drop
SQL["c20_apply_drop"] = with_sql(ORDERS_DIRTY_SQL, body="""
SELECT o_orderkey, price_text, o_orderpriority, o_orderstatus, ship_date_text, constant_col, o_totalprice
FROM orders_dirty""")


def c21_apply_rename(spark, sf_dir):
    od = orders_dirty(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return cl.apply_rename(od, RULES["rename"])


QUERIES["c21_apply_rename"] = c21_apply_rename
SQL["c21_apply_rename"] = with_sql(ORDERS_DIRTY_SQL, body="SELECT o_orderkey, o_orderpriority AS priority FROM orders_dirty")


def c22_apply_cast(spark, sf_dir):
    od = orders_dirty(spark, sf_dir).select("o_orderkey", "price_text", "o_totalprice")
    return cl.apply_cast(od, {**RULES["cast"], "o_totalprice": "int"})


QUERIES["c22_apply_cast"] = c22_apply_cast
SQL["c22_apply_cast"] = with_sql(ORDERS_DIRTY_SQL, body=f"""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, TRY_CAST({_trim('price_text')} AS DOUBLE) AS price_text,
       CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders_dirty""")


def c23_apply_impute(spark, sf_dir):
    li = lineitem_nulls(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", "l_tax")
    return cl.apply_impute(li, {"l_quantity": "median", "l_linestatus": "mode", "l_tax": "zero"})


QUERIES["c23_apply_impute"] = c23_apply_impute
SQL["c23_apply_impute"] = with_sql(LINEITEM_NULLS_SQL, body="""
SELECT l_orderkey, l_linenumber,
       coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_nulls)) AS l_quantity,
       coalesce(l_linestatus, (SELECT l_linestatus FROM lineitem_nulls WHERE l_linestatus IS NOT NULL
                               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_linestatus,
       coalesce(l_tax, 0.0) AS l_tax
FROM lineitem_nulls""")


def c24_apply_rules(spark, sf_dir):
    return cl.apply_rules(orders_dirty(spark, sf_dir), RULES)


QUERIES["c24_apply_rules"] = c24_apply_rules
SQL["c24_apply_rules"] = with_sql(ORDERS_DIRTY_SQL, body=f"""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, TRY_CAST({_trim('price_text')} AS DOUBLE) AS price_text,
       o_orderpriority AS priority, o_orderstatus, ship_date_text, constant_col,
       coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty)) AS o_totalprice
FROM orders_dirty""")


def c25_safe_numeric(spark, sf_dir):
    o = orders_dirty(spark, sf_dir).select(
        "o_orderkey", (F.col("o_totalprice") > 100000).alias("big_order"),
        F.col("o_orderkey").cast("string").alias("key_text"), "price_text")
    return cl.safe_numeric(o, ["o_orderkey", "big_order", "key_text", "price_text"])


QUERIES["c25_safe_numeric"] = c25_safe_numeric
SQL["c25_safe_numeric"] = with_sql(ORDERS_DIRTY_SQL, body="""
SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_totalprice > 100000 AS BIGINT) AS big_order,
       TRY_CAST(CAST(o_orderkey AS VARCHAR) AS DOUBLE) AS key_text, TRY_CAST(price_text AS DOUBLE) AS price_text
FROM orders_dirty""")


def c26_training_guards(spark, sf_dir):
    return cl.training_guards(t(spark, sf_dir, "lineitem"), "l_returnflag")


QUERIES["c26_training_guards"] = c26_training_guards
SQL["c26_training_guards"] = """
SELECT 'non_empty' AS "check", count(*) > 0 AS passed, CAST(count(*) AS VARCHAR) AS actual FROM lineitem
UNION ALL SELECT 'min_columns', true, '11'
UNION ALL SELECT 'min_rows', count(*) >= 10, CAST(count(*) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'target_present', true, 'true'
UNION ALL SELECT 'min_features', true, '10'
UNION ALL SELECT 'min_classes', count(DISTINCT l_returnflag) >= 2, CAST(count(DISTINCT l_returnflag) AS VARCHAR)
FROM lineitem"""


# --- whole-pipeline runs on the largest table (the reference's scalability path) ----------

def c17_clean_lineitem(spark, sf_dir):
    return cl.clean(lineitem_nulls(spark, sf_dir), target="l_returnflag")


QUERIES["c17_clean_lineitem"] = c17_clean_lineitem
SQL["c17_clean_lineitem"] = with_sql(LINEITEM_NULLS_SQL, body="""
SELECT l_orderkey, l_linenumber,
       coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_nulls)) AS l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag,
       dense_rank() OVER (ORDER BY coalesce(l_linestatus, (SELECT l_linestatus FROM lineitem_nulls
                          WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))) - 1
         AS l_linestatus,
       year(l_shipdate) AS l_shipdate_year, month(l_shipdate) AS l_shipdate_month,
       isodow(l_shipdate) - 1 AS l_shipdate_dow
FROM lineitem_nulls""")

LINEITEM_RULES = {"drop": ["l_partkey", "l_suppkey"], "rename": {"l_linestatus": "status"},
                  "cast": {"l_linenumber": "float"},
                  "impute": {"l_quantity": "median", "status": "mode", "l_tax": "zero"}, "target": "l_returnflag"}


def c24_apply_rules_lineitem(spark, sf_dir):
    li = lineitem_nulls(spark, sf_dir)
    return cl.apply_rules(li, LINEITEM_RULES)


QUERIES["c24_apply_rules_lineitem"] = c24_apply_rules_lineitem
SQL["c24_apply_rules_lineitem"] = with_sql(LINEITEM_NULLS_SQL, body="""
SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
       coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_nulls)) AS l_quantity,
       l_extendedprice, l_discount, coalesce(l_tax, 0.0) AS l_tax, l_returnflag,
       coalesce(l_linestatus, (SELECT l_linestatus FROM lineitem_nulls WHERE l_linestatus IS NOT NULL
                               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS status,
       l_shipdate
FROM lineitem_nulls""")
