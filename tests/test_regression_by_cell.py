"""M-12 over a large table: the trees grow over cells between the candidate cuts, the rows are drawn in one pass."""

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tabulon.functions import columns
from tabulon.operators import model as md


def _rows(spark, n=3000):
    return spark.range(n).select((F.col("id") * 7 % 31).cast("double").alias("a"), (F.col("id") % 5 / 4).alias("b"),
                                 ((F.col("id") * 7 % 31) * 10 + F.col("id") % 13 * (F.col("id") % 5)).alias("y"))


def test_a_large_table_is_not_passed_over_at_every_level(spark, monkeypatch):
    small, ranked = md.regress(_rows(spark), "y", {"a": 10}, n_trees=8, max_depth=6)
    monkeypatch.setattr(columns, "FEW_ROWS", 500)
    monkeypatch.setattr(columns, "ROWS_PER_TASK", 700)
    monkeypatch.setattr(md, "RandomForestRegressor", lambda **k: (_ for _ in ()).throw(AssertionError("rows at every level")))
    large, by_cell = md.regress(_rows(spark), "y", {"a": 10}, n_trees=8, max_depth=6)
    a, b = small.first(), large.first()
    assert large.schema == small.schema and by_cell.schema == ranked.schema and b["n_features"] == 2
    assert abs(a["r2"] - b["r2"]) < 0.01 and abs(a["prediction"] - b["prediction"]) < 10
    imp = [{r["feature"]: r["importance"] for r in x.collect()} for x in (ranked, by_cell)]
    assert abs(imp[0]["a"] - imp[1]["a"]) < 0.02 and math.isclose(sum(imp[1].values()), 1.0)
    # the same draws again
    again = md.regress(_rows(spark), "y", {"a": 10}, n_trees=8, max_depth=6)[0].first()
    assert math.isclose(again["r2"], b["r2"]) and math.isclose(again["prediction"], b["prediction"])


def test_a_tree_over_cells_is_the_tree_over_rows(spark, monkeypatch):
    data = _rows(spark)

    def every_row_once(cells, n_trees, n_cells, seed):
        return cells.groupBy(F.lit(0).alias("tree"), "_cell").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").cast("double").alias("total"))

    monkeypatch.setattr(md, "_bootstrap_sums", every_row_once)
    grid = md._candidate_cuts(data, ["a", "b"], "y")
    fact = spark.createDataFrame([(10.0, None)], "a double, b double")
    pred, r2, imp = md._forest_by_cell(data, "y", ["a", "b"], grid, fact, 1, 6, 42)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="f", handleInvalid="keep").transform(data).cache()
    tree = DecisionTreeRegressor(featuresCol="f", labelCol="y", maxDepth=6, seed=42).fit(rows)
    err, whole = tree.transform(rows).agg(F.sum((F.col("y") - F.col("prediction")) ** 2),
                                          F.var_pop("y") * F.count(F.lit(1))).first()
    assert math.isclose(r2, 1 - err / whole, rel_tol=1e-9)
    assert np.allclose(imp, tree.featureImportances.toArray(), rtol=1e-9)
    wanted = VectorAssembler(inputCols=["a", "b"], outputCol="f", handleInvalid="keep").transform(fact).first()["f"]
    assert math.isclose(pred, tree.predict(wanted), rel_tol=1e-9)


def test_every_tree_draws_the_rows_anew(spark):
    cells = spark.range(20_000).select((F.col("id") % 4).alias("_cell"), F.lit(2.0).alias("_y"))
    got = md._bootstrap_sums(cells, 30, 4, 1).collect()
    assert len(got) == 30 * 4 and all(r["total"] == 2 * r["n"] for r in got)
    n = np.array([r["n"] for r in got])
    # Poisson(5,000) each: mean and variance are equal
    assert len(set(n)) > 20 and abs(n.mean() - 5000) < 40 and 2500 < n.var() < 8500


def test_candidate_cuts(spark):
    odd = _rows(spark).withColumn("c", F.when(F.col("y") > 300, F.lit(float("nan"))).otherwise(F.col("a")))
    assert md._candidate_cuts(odd, ["a", "c"], "y") is None   # Spark ML says what is wrong with them
    assert [len(c) for c in md._candidate_cuts(odd, ["a", "b"], "y")] == [30, 4]
    assert md._spread_cuts([1, 1, 2, 4], 32).tolist() == [1.5, 3.0]
    assert md._spread_cuts([], 32).tolist() == [] and md._spread_cuts([5.0, 5.0], 32).tolist() == []
    cuts = md._spread_cuts(np.arange(1000), 4)
    assert len(cuts) == 3 and np.allclose(cuts, [250, 500, 750], atol=1)
    # one value holds most of the rows: the others keep their cuts
    assert md._spread_cuts([0] * 100 + [1, 2, 3, 4, 5], 4)[0] == 0.5
