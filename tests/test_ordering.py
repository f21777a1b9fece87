"""Distributed order statistics agree with the in-memory aggregates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions.ordering import dense_codes, exact_quantiles, long_values, modes, rank_within
from tabulon.functions.topk import top_k_per_group

from conftest import SF_SMALL


def test_quantiles_distributed_equals_percentile(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    long = long_values(li, ["l_quantity", "l_extendedprice"])
    a = {(r[0], r[1]): r[2] for r in exact_quantiles(long, [0.25, 0.5, 0.67], in_memory_limit=0).collect()}
    b = {(r[0], r[1]): r[2] for r in exact_quantiles(long, [0.25, 0.5, 0.67]).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert abs(a[k] - b[k]) < 1e-9


def test_dense_codes_distributed_equals_window(spark):
    p = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    long = long_values(p, ["p_brand", "p_type"], as_type="string")
    a = sorted(tuple(r) for r in dense_codes(long, in_memory_limit=0).collect())
    b = sorted(tuple(r) for r in dense_codes(long).collect())
    assert a == b


def test_rank_within_distributed_equals_window(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    order = F.md5(F.col("o_orderkey").cast("string"))
    a = sorted(tuple(r) for r in rank_within(o, "o_orderstatus", order, window_limit=0)
               .select("o_orderkey", "rank").collect())
    b = sorted(tuple(r) for r in rank_within(o, "o_orderstatus", order).select("o_orderkey", "rank").collect())
    assert a == b


def test_top_k_per_group_equals_window(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    got = top_k_per_group(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3,
                          salt_buckets=7, salt_on=["o_orderkey"])
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey"))
    exp = o.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_modes_smallest_on_ties(spark):
    df = spark.createDataFrame([("c", "x"), ("c", "y"), ("c", "y"), ("c", "x"), ("d", "z")], "column_name string, value string")
    got = {r["column_name"]: r["value"] for r in modes(df).collect()}
    assert got == {"c": "x", "d": "z"}
