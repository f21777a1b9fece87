"""Catalog entries for T-01..T-09 (targets, bins), P-01..P-07 (samples) and W-01/W-02."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.topk import top_k_per_group
from tabulon.operators import sample as sp
from tabulon.operators import target as tg
from tabulon.plans.catalog.common import LINEITEM_NULLS_SQL, lineitem_nulls, t, with_sql

QUERIES = {}
SQL = {}


def t01_detect_target(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"), "o_orderpriority")
    return tg.detect_target(o, requested="not_a_column")


QUERIES["t01_detect_target"] = t01_detect_target
SQL["t01_detect_target"] = "SELECT 'total_tier' AS target, 'sales_like_numeric' AS reason"


def t01_detect_known_name(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("Status"))
    return tg.detect_target(o)


QUERIES["t01_detect_known_name"] = t01_detect_known_name
SQL["t01_detect_known_name"] = "SELECT 'Status' AS target, 'known_name' AS reason"


def t01_detect_by_values(spark, sf_dir):
    """Text columns only: no name or type decides, the values have to be counted."""
    return tg.detect_target(t(spark, sf_dir, "documents").select("text", "source", "lang"))


QUERIES["t01_detect_by_values"] = t01_detect_by_values
SQL["t01_detect_by_values"] = """
WITH c AS (SELECT count(DISTINCT text) AS a, count(DISTINCT source) AS b, count(DISTINCT lang) AS c,
                  least(20, greatest(2, count(*) // 3)) AS k FROM documents)
SELECT CASE WHEN a <= k THEN 'text' WHEN b <= k THEN 'source' WHEN c <= k THEN 'lang'
            ELSE 'analyst_cluster' END AS target,
       CASE WHEN least(a, b, c) <= k THEN 'low_cardinality' ELSE 'fallback' END AS reason
FROM c"""


def t01_detect_order_texts(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return tg.detect_target(o.select(F.col("o_orderkey").cast("string").alias("order_no"),
                                     F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("handling"),
                                     F.col("o_orderpriority").alias("priority")))


QUERIES["t01_detect_order_texts"] = t01_detect_order_texts
SQL["t01_detect_order_texts"] = """
WITH c AS (SELECT count(DISTINCT o_orderkey) AS a, count(DISTINCT o_orderpriority || '/' || o_orderstatus) AS b,
                  count(DISTINCT o_orderpriority) AS c, least(20, greatest(2, count(*) // 3)) AS k FROM orders)
SELECT CASE WHEN a <= k THEN 'order_no' WHEN b <= k THEN 'handling' WHEN c <= k THEN 'priority'
            ELSE 'analyst_cluster' END AS target,
       CASE WHEN least(a, b, c) <= k THEN 'low_cardinality' ELSE 'fallback' END AS reason
FROM c"""


def _tier_counts(df, col_name):
    return df.groupBy(col_name).agg(F.count(F.lit(1)).alias("n"))


def t02_tiers(spark, sf_dir):
    return _tier_counts(tg.tier(t(spark, sf_dir, "lineitem"), "l_extendedprice"), "l_extendedprice_tier")


QUERIES["t02_tiers"] = t02_tiers
SQL["t02_tiers"] = """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.33) AS a, quantile_cont(l_extendedprice, 0.67) AS b FROM lineitem)
SELECT CASE WHEN l_extendedprice <= a THEN 'low' WHEN l_extendedprice <= b THEN 'medium' ELSE 'high' END
         AS l_extendedprice_tier, count(*) AS n
FROM lineitem, q GROUP BY 1"""


def t03_binary_fallback(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("open_flag"))
    return _tier_counts(tg.tier(li, "open_flag"), "open_flag_tier")


QUERIES["t03_binary_fallback"] = t03_binary_fallback
SQL["t03_binary_fallback"] = """
WITH x AS (SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS f FROM lineitem),
m AS (SELECT quantile_cont(f, 0.5) AS med FROM x)
SELECT CASE WHEN f >= med THEN 'high' ELSE 'low' END AS open_flag_tier, count(*) AS n FROM x, m GROUP BY 1"""


def t04_median_filled_tiers(spark, sf_dir):
    li = lineitem_nulls(spark, sf_dir).select("l_orderkey", "l_quantity")
    return _tier_counts(tg.ensure_target(li, "l_quantity_tier"), "l_quantity_tier")


QUERIES["t04_median_filled_tiers"] = t04_median_filled_tiers
SQL["t04_median_filled_tiers"] = with_sql(LINEITEM_NULLS_SQL, """
f AS (SELECT coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_nulls)) AS x FROM lineitem_nulls)""",
                                          """
q AS (SELECT quantile_cont(x, 0.33) AS a, quantile_cont(x, 0.67) AS b FROM f)""", body="""
SELECT CASE WHEN x <= a THEN 'low' WHEN x <= b THEN 'medium' ELSE 'high' END AS l_quantity_tier, count(*) AS n
FROM f, q GROUP BY 1""")


def t05_text_signal(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_name", "c_mktsegment")
    out = tg.ensure_target(c, "analyst_cluster")
    return out.groupBy("analyst_cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("text_signal").alias("signal_sum"))


QUERIES["t05_text_signal"] = t05_text_signal
SQL["t05_text_signal"] = """
WITH s AS (SELECT CAST(length(c_name || ' ' || c_mktsegment) AS DOUBLE) AS x FROM customer),
q AS (SELECT quantile_cont(x, 0.33) AS a, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.67) AS b,
             count(DISTINCT x) AS nd FROM s)
SELECT CASE WHEN nd < 3 OR a = b THEN (CASE WHEN x >= m THEN 'high' ELSE 'low' END)
            WHEN x <= a THEN 'low' WHEN x <= b THEN 'medium' ELSE 'high' END AS analyst_cluster,
       count(*) AS n, CAST(sum(x) AS BIGINT) AS signal_sum
FROM s, q GROUP BY 1"""


def t06_target_usable(spark, sf_dir):
    return tg.target_usable(t(spark, sf_dir, "orders"), "o_orderstatus")


QUERIES["t06_target_usable"] = t06_target_usable
SQL["t06_target_usable"] = """
SELECT 'o_orderstatus' AS target, count(DISTINCT o_orderstatus) AS n_distinct,
       count(DISTINCT o_orderstatus) >= 2 AS usable FROM orders"""


def t07_stratify_column(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return tg.guess_stratify_column(o)


QUERIES["t07_stratify_column"] = t07_stratify_column
SQL["t07_stratify_column"] = """
SELECT column_name, 'lowest_cardinality' AS reason, nd AS n_distinct FROM (
  SELECT 'o_orderpriority' AS column_name, count(DISTINCT o_orderpriority) AS nd, 1 AS pos FROM orders
  UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), 2 FROM orders)
WHERE nd BETWEEN 2 AND 20 ORDER BY nd, pos LIMIT 1"""


def t08_equal_width_bins(spark, sf_dir):
    li = tg.equal_width_bins(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], bins=5)
    return li.groupBy("l_quantity_bin", "l_discount_bin").agg(F.count(F.lit(1)).alias("n"))


QUERIES["t08_equal_width_bins"] = t08_equal_width_bins
SQL["t08_equal_width_bins"] = """
WITH s AS (SELECT min(l_quantity) AS qlo, max(l_quantity) AS qhi, min(l_discount) AS dlo, max(l_discount) AS dhi
           FROM lineitem),
b AS (SELECT
  CASE WHEN l_quantity > qlo - (qhi - qlo) * 0.001 THEN
    CASE WHEN l_quantity <= 1 * ((qhi - qlo) / 5) + qlo THEN 0 WHEN l_quantity <= 2 * ((qhi - qlo) / 5) + qlo THEN 1
         WHEN l_quantity <= 3 * ((qhi - qlo) / 5) + qlo THEN 2 WHEN l_quantity <= 4 * ((qhi - qlo) / 5) + qlo THEN 3
         WHEN l_quantity <= qhi THEN 4 END END AS l_quantity_bin,
  CASE WHEN l_discount > dlo - (dhi - dlo) * 0.001 THEN
    CASE WHEN l_discount <= 1 * ((dhi - dlo) / 5) + dlo THEN 0 WHEN l_discount <= 2 * ((dhi - dlo) / 5) + dlo THEN 1
         WHEN l_discount <= 3 * ((dhi - dlo) / 5) + dlo THEN 2 WHEN l_discount <= 4 * ((dhi - dlo) / 5) + dlo THEN 3
         WHEN l_discount <= dhi THEN 4 END END AS l_discount_bin
  FROM lineitem, s)
SELECT l_quantity_bin, l_discount_bin, count(*) AS n FROM b GROUP BY 1, 2"""


def t09_label_encode(spark, sf_dir):
    li = tg.label_encode(t(spark, sf_dir, "lineitem"), "l_returnflag", "label")
    return li.groupBy("l_returnflag", "label").agg(F.count(F.lit(1)).alias("n"))


QUERIES["t09_label_encode"] = t09_label_encode
SQL["t09_label_encode"] = """
SELECT l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS label, n
FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)"""


# --- sampling ------------------------------------------------------------------

MD5 = "md5(CAST(o_orderkey AS VARCHAR))"


def p01_head_and_hash(spark, sf_dir):
    return sp.head_and_hash_sample(t(spark, sf_dir, "orders"), ["o_orderkey"])


QUERIES["p01_head_and_hash"] = p01_head_and_hash
SQL["p01_head_and_hash"] = f"""
SELECT * FROM (SELECT *, 'head' AS sample_part FROM orders ORDER BY o_orderkey LIMIT 50)
UNION ALL
SELECT * FROM (SELECT *, 'random' AS sample_part FROM orders ORDER BY {MD5} LIMIT 150)"""


def p02_per_chunk_sample(spark, sf_dir):
    return sp.per_chunk_sample(t(spark, sf_dir, "orders"), ["o_orderkey"], per_chunk=40, chunk_rows=4000)


QUERIES["p02_per_chunk_sample"] = p02_per_chunk_sample
# the file holds the orders by key
SQL["p02_per_chunk_sample"] = f"""
WITH c AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 4000 AS chunk_id FROM orders)
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY {MD5}) AS r FROM c) WHERE r <= 40"""


def p03_per_class_sample(spark, sf_dir):
    return sp.per_class_sample(t(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"], n=200)


QUERIES["p03_per_class_sample"] = p03_per_class_sample
SQL["p03_per_class_sample"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {MD5}) AS class_rank FROM orders)
WHERE class_rank <= (SELECT greatest(1, 200 // count(DISTINCT o_orderpriority)) FROM orders)"""


def _orders_with_solo(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.withColumn("cls", F.when(F.col("o_orderkey") == 0, F.lit("solo")).otherwise(F.col("o_orderstatus")))


def p04_drop_singletons(spark, sf_dir):
    return sp.drop_singleton_classes(_orders_with_solo(spark, sf_dir), "cls")


QUERIES["p04_drop_singletons"] = p04_drop_singletons
SQL["p04_drop_singletons"] = """
WITH o AS (SELECT *, CASE WHEN o_orderkey = 0 THEN 'solo' ELSE o_orderstatus END AS cls FROM orders)
SELECT * FROM o WHERE cls IN (SELECT cls FROM o GROUP BY cls HAVING count(*) >= 2)"""


def p05_stratified_split(spark, sf_dir):
    return sp.stratified_split(t(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderkey"], 0.2)


QUERIES["p05_stratified_split"] = p05_stratified_split
SQL["p05_stratified_split"] = f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {MD5})
            <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split
FROM orders"""


def p06_capped_sample(spark, sf_dir):
    return sp.capped_sample(t(spark, sf_dir, "orders"), ["o_orderkey"], 300)


QUERIES["p06_capped_sample"] = p06_capped_sample
SQL["p06_capped_sample"] = f"SELECT * FROM orders ORDER BY {MD5} LIMIT 300"


def p07_stratified_folds(spark, sf_dir):
    return sp.stratified_folds(t(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"])


QUERIES["p07_stratified_folds"] = p07_stratified_folds
SQL["p07_stratified_folds"] = f"""
WITH k AS (SELECT greatest(2, least(5, min(n))) AS k FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {MD5}) - 1) % k AS INTEGER) AS fold
FROM orders, k"""


# --- W-01 / W-02 ------------------------------------------------------------------

def w01_top_k(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(8).select("o_orderkey", "o_totalprice")


QUERIES["w01_top_k"] = w01_top_k
SQL["w01_top_k"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8"


def w02_best_per_group(spark, sf_dir):
    """Best order per customer (salted two-phase top-1), then the top 10 customers."""
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = top_k_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 1,
                           salt_on=["o_orderkey"])
    return best.orderBy(F.desc("o_totalprice"), "o_custkey").limit(10)


QUERIES["w02_best_per_group"] = w02_best_per_group
SQL["w02_best_per_group"] = """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
WHERE r = 1 ORDER BY o_totalprice DESC, o_custkey LIMIT 10"""


def w03_two_key_ranking(spark, sf_dir):
    """Stable two-key ranking: per return flag, the 3 lines with the highest
    discount, then tax, then key order (salted two-phase top-k)."""
    li = t(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey",
                                             "l_suppkey", "l_discount", "l_tax")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return top_k_per_group(li, ["l_returnflag"], [F.desc("l_discount"), F.desc("l_tax"), *[F.asc(k) for k in keys]],
                           3, salt_on=keys, rank_col="rank")


QUERIES["w03_two_key_ranking"] = w03_two_key_ranking
SQL["w03_two_key_ranking"] = """
SELECT * FROM (
  SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax,
         row_number() OVER (PARTITION BY l_returnflag
                            ORDER BY l_discount DESC, l_tax DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank
  FROM lineitem) WHERE rank <= 3"""
