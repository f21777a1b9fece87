"""Forests of large tables: grown, scored and explained by cells, with nothing kept per row and tree."""

import numpy as np
from pyspark.sql import functions as F

from tabulon.functions import cells, columns
from tabulon.operators import celltrees
from tabulon.operators import model as md
from tabulon.operators import shap as sh

FEATS = ["a", "b"]


def _rows(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("a"),
                                 (F.col("id") * 7 % 31).cast("double").alias("b"),
                                 F.when(F.col("id") % 97 < 30, "x").when(F.col("id") * 7 % 31 < 9, "y").otherwise("z").alias("y"))


def test_a_large_forest_is_grown_over_cells(spark, monkeypatch):
    df = _rows(spark)
    by_rows = md.train_forest(df, "y", FEATS, n_trees=20, max_depth=6)
    monkeypatch.setattr(columns, "FEW_ROWS", 1000)
    monkeypatch.setattr(md.RandomForestClassifier, "fit", _only_single_leaves(md.RandomForestClassifier.fit))
    model = md.train_forest(df, "y", FEATS, n_trees=20, max_depth=6)
    forest = model.stages[-1]
    assert forest.getNumTrees == 20 and forest.numClasses == 3 and forest.getMaxDepth() == 6
    assert md.class_labels(model) == ["x", "y", "z"] and max(t.depth for t in forest.trees) <= 6
    got, want = (md.accuracy(md.predict(m, df, "y", FEATS)).first()["accuracy"] for m in (model, by_rows))
    assert got > 0.97 and abs(got - want) < 0.03
    assert abs(md.forest_accuracy(model, df, "y", FEATS) - got) < 1e-12
    again = md.train_forest(df.repartition(5), "y", FEATS, n_trees=20, max_depth=6)
    assert sh.forest_nodes(again).exceptAll(sh.forest_nodes(model)).count() == 0


def _only_single_leaves(fit):
    """Rows are never fitted: Spark ML would keep 8 bytes of each for every tree."""
    def checked(self, df, *a):
        assert self.getMaxDepth() == 0
        return fit(self, df, *a)
    return checked


def test_many_cells_are_fitted_a_few_trees_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(columns, "FEW_ROWS", 1000)
    monkeypatch.setattr(md, "MAX_GROWN", 10)
    monkeypatch.setattr(md, "MAX_BAGGED", 3000 * 2)
    fitted, fit = [], md.RandomForestClassifier.fit
    monkeypatch.setattr(md.RandomForestClassifier, "fit", lambda self, df, *a: fitted.append(self.getNumTrees()) or fit(self, df, *a))
    model = md.train_forest(_rows(spark), "y", FEATS, n_trees=5, max_depth=4)
    assert fitted == [2, 2, 1, 5] and model.stages[-1].getNumTrees == 5   # and the single leaves
    assert md.accuracy(md.predict(model, _rows(spark), "y", FEATS)).first()["accuracy"] > 0.9


def test_a_tree_follows_the_drawn_rows():
    rng = np.random.default_rng(0)
    places = np.stack([np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4)])
    label = (places[0] > 1).astype(int) + (places[0] > 1) * (places[1] > 0)
    tree = celltrees.grow(places, label, np.full(12, 5), [4, 3], 3, 4, 2, rng)
    assert tree.stats[0].tolist() == [30, 10, 20] and tree.feature[0] == 0 and tree.cut[0] == 1
    assert (tree.left < 0).sum() == 3 and np.allclose(tree.impurity[tree.left < 0], 0)
    # sibling leaves that predict alike are one
    alike = celltrees.grow(np.array([[0, 0, 1, 1]]), np.array([0, 1, 0, 1]), np.array([9, 1, 5, 4]), [2], 2, 3, 1, rng)
    assert len(alike.left) == 1 and alike.stats.tolist() == [[14, 5]]


def test_cells_by_search_are_those_of_the_expression(spark):
    odd = _rows(spark, 200).withColumn("a", F.when(F.col("k") == 3, F.lit(None)).when(
        F.col("k") == 4, float("nan")).when(F.col("k") == 5, float("inf")).when(F.col("k") == 6, float("-inf")).otherwise(F.col("a")))
    grid = [[10.0, 11.0, 50.5], [], [7.0]]
    names = ["a", "k", "b"]
    want = odd.withColumn("c", cells.cell_of(cells.places(odd, names, grid), [4, 1, 2]))
    got = cells.with_cell(odd, names, grid, "c")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 200


def test_large_permutation_importance_permutes_in_buckets(spark, monkeypatch):
    df = _rows(spark)
    model = md.train_forest(df, "y", FEATS, n_trees=10, max_depth=6)
    want = {r["feature"]: r for r in md.permutation_importance(model, df, "y", FEATS, ["k"], repeats=5).collect()}
    monkeypatch.setattr(columns, "FEW_ROWS", 1000)
    exploded, explode = [], F.explode
    monkeypatch.setattr(md.F, "explode", lambda *a: exploded.append(a) or explode(*a))
    found = md.permutation_importance(model, df, "y", FEATS, ["k"], repeats=5, bucket_rows=700)
    got = {r["feature"]: r for r in found.collect()}
    assert not exploded and found.columns == ["feature", "importance", "importance_std", "position"]   # rows are not copied
    for f in FEATS:
        assert abs(got[f]["importance"] - want[f]["importance"]) < 0.05 and got[f]["importance_std"] < 0.05
    again = md.permutation_importance(model, df.repartition(7), "y", FEATS, ["k"], repeats=5, bucket_rows=700)
    assert sorted(again.collect()) == sorted(found.collect())


def test_large_shap_from_tables_equals_the_trees(spark, monkeypatch):
    df = _rows(spark).withColumn("a", F.when(F.col("k") % 50 == 0, F.lit(None)).otherwise(F.col("a")))
    model = md.train_forest(_rows(spark), "y", FEATS, n_trees=10, max_depth=6)
    want = {r["feature"]: r["shap"] for r in sh.shap_importance(model, df, FEATS).collect()}
    monkeypatch.setattr(columns, "FEW_ROWS", 1000)
    monkeypatch.setattr(sh, "box_shap", None)   # no cell is explained tree by tree
    got = {r["feature"]: r["shap"] for r in sh.shap_importance(model, df, FEATS).collect()}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-12 for f in FEATS)
