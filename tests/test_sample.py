"""Split sizes, fold balance and singleton handling."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import sample as sp

from conftest import SF_SMALL


def test_split_exact_per_class(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    s = sp.stratified_split(o, "o_orderstatus", ["o_orderkey"], 0.2)
    counts = {(r[0], r[1]): r[2] for r in s.groupBy("o_orderstatus", "split").count().collect()}
    totals = {r[0]: r[1] for r in o.groupBy("o_orderstatus").count().collect()}
    for cls, n in totals.items():
        assert counts.get((cls, "test"), 0) == int(n * 0.2 + 0.5)
    assert s.count() == o.count()


def test_folds_balanced(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    f = sp.stratified_folds(o, "o_orderpriority", ["o_orderkey"])
    k = f.agg(F.max("fold")).first()[0] + 1
    assert k == 5
    sizes = [r["count"] for r in f.groupBy("o_orderpriority", "fold").count().collect()]
    per_class = f.groupBy("o_orderpriority", "fold").count().groupBy("o_orderpriority") \
        .agg((F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in per_class) and sum(sizes) == o.count()


def test_drop_singletons_and_error(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c")], "k int, cls string")
    assert sorted(r[0] for r in sp.drop_singleton_classes(df, "cls").collect()) == [1, 2, 4, 5]
    with pytest.raises(ValueError):
        sp.drop_singleton_classes(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, cls string"), "cls")


def test_per_class_sample_cap(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    s = sp.per_class_sample(o, "o_orderpriority", ["o_orderkey"], n=12)
    assert s.count() <= 12
    assert s.select("o_orderpriority").distinct().count() == 5
