"""Shared pieces of the query catalog: table access and the injected-dirt views.

Driver tables hold no nulls, so cleaning and profiling queries run over
"dirty" views derived from them with the same expressions in Spark and in the
DuckDB oracle (FIXTURES.md §3).  Every view is a projection of a whole table,
so each query's work grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


# --- lineitem with nulls -----------------------------------------------------

def lineitem_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        F.when(F.col("l_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        "l_shipdate",
    )


LINEITEM_NULLS_SQL = """
lineitem_nulls AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag,
         CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus,
         l_shipdate
  FROM lineitem)"""


# --- orders with text dirt ---------------------------------------------------

def orders_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.concat(F.lit("$"), F.col("o_totalprice").cast("string")).alias("price_text"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(" N/A ")).otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
        F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" ")).alias("o_orderstatus"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ship_date_text"),
        F.lit("always_same").alias("constant_col"),
        F.lit(None).cast("double").alias("empty_col"),
        F.col("o_custkey").alias("Unnamed: 0"),
        "o_totalprice",
    )


ORDERS_DIRTY_SQL = """
orders_dirty AS (
  SELECT o_orderkey,
         concat('$', CAST(o_totalprice AS VARCHAR)) AS price_text,
         CASE WHEN o_orderkey % 11 = 0 THEN ' N/A ' ELSE o_orderpriority END AS o_orderpriority,
         concat('  ', o_orderstatus, ' ') AS o_orderstatus,
         strftime(o_orderdate, '%Y-%m-%d') AS ship_date_text,
         'always_same' AS constant_col,
         CAST(NULL AS DOUBLE) AS empty_col,
         o_custkey AS "Unnamed: 0",
         o_totalprice
  FROM orders)"""


# --- part with sparse and unit-suffixed columns -----------------------------

def part_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    return p.select(
        "p_partkey", "p_brand", "p_type",
        F.when(F.col("p_partkey") % 5 != 0, F.lit(None)).otherwise(F.col("p_size")).alias("p_size_sparse"),
        F.concat(F.col("p_size").cast("string"), F.lit(" kg")).alias("weight_text"),
        "p_retailprice",
    )


PART_DIRTY_SQL = """
part_dirty AS (
  SELECT p_partkey, p_brand, p_type,
         CASE WHEN p_partkey % 5 <> 0 THEN NULL ELSE p_size END AS p_size_sparse,
         concat(CAST(p_size AS VARCHAR), ' kg') AS weight_text,
         p_retailprice
  FROM part)"""


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
