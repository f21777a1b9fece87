"""Model invariants: rules cover every row once and agree with the tree."""

from pyspark.sql import functions as F

from tabulon.operators import model as md
from tabulon.operators import rules as rl
from tabulon.operators import target as tg

from conftest import SF_SMALL

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _data(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(*KEYS, *FEATS)
    return tg.tier(li, "l_extendedprice", "tier")


def test_tree_rules_cover_rows_and_match_predictions(spark):
    data = _data(spark)
    tree = md.train_tree(data, "tier", FEATS, max_depth=4, min_leaf=20)
    rules = md.tree_rules(tree, FEATS)
    n_rules = rules.count()
    assert 2 <= n_rules <= 16
    # every row satisfies exactly one rule completely (one leaf per row)
    scored = rl.deduce(data.select(*KEYS, *FEATS), rules, KEYS, top_k=n_rules)
    full = scored.where(F.col("match_score") == 1.0).groupBy(*KEYS).count()
    assert full.where("count != 1").count() == 0 and full.count() == data.count()
    # the fully matched rule predicts what the tree predicts (thresholds shown at 4 dp)
    best = scored.where("rank = 1").select(*KEYS, F.col("prediction").alias("rule_pred"))
    pred = md.predict(tree, data, "tier", FEATS).select(*KEYS, "predicted_class")
    agree = best.join(pred, KEYS).agg(F.avg((F.col("rule_pred") == F.col("predicted_class")).cast("double"))).first()[0]
    assert agree > 0.99


def test_forest_accuracy_and_probabilities(spark):
    data = _data(spark)
    forest = md.train_forest(data, "tier", FEATS, n_trees=10, max_depth=6)
    acc = md.accuracy(md.predict(forest, data, "tier", FEATS)).first()["accuracy"]
    assert acc > 0.9  # the target is binned from a feature
    probs = md.class_probabilities(forest, md.medians_row(data, FEATS), FEATS).collect()
    assert len(probs) == 3 and abs(sum(r["probability"] for r in probs) - 1.0) < 1e-9


def test_permutation_importance_ranks_source_feature(spark):
    data = _data(spark)
    forest = md.train_forest(data, "tier", FEATS, n_trees=10, max_depth=6)
    imp = {r["feature"]: r["importance"] for r in
           md.permutation_importance(forest, data, "tier", FEATS, KEYS, repeats=2, bucket_rows=500).collect()}
    assert set(imp) == set(FEATS)
    assert max(imp, key=imp.get) == "l_extendedprice"


def test_report_sums(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "y string, p string")
    rep = {r["class"]: r for r in md.classification_report(md.confusion(df, "y", "p")).collect()}
    assert rep["a"]["precision"] == 1.0 and rep["a"]["recall"] == 0.5
    assert abs(rep["b"]["precision"] - 2 / 3) < 1e-12 and rep["weighted avg"]["support"] == 4


def test_tree_shap_additivity(spark):
    import numpy as np
    import pandas as pd

    from tabulon.operators import shap as sh

    data = _data(spark).withColumn("rk", F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS]))
    forest = md.train_forest(data, "tier", FEATS, n_trees=3, max_depth=4)
    sample = data.orderBy("rk").limit(25)
    sv = sh.shap_values(forest, sample, FEATS, "rk").toPandas()
    nodes = sh.forest_nodes(forest).toPandas()
    base = np.mean([sh.expected_value(*[a for i, a in enumerate(sh._tree_arrays(g)) if i in (0, 4, 5)])
                    for _, g in nodes.groupby("treeID")], axis=0)
    scored = md.predict(forest, sample, "tier", FEATS).select("rk", "probability").toPandas()
    for _, r in scored.iterrows():
        rows = sv[sv["rk"] == r["rk"]]
        for c in range(3):
            total = rows[rows["class_index"] == c]["shap"].sum() + base[c]
            assert abs(total - r["probability"][c]) < 1e-9


def test_shap_tables_equal_the_walk(spark):
    """Leaf tables against Algorithm 2, with missing and infinite values and unused features."""
    import numpy as np

    from tabulon.operators import shap as sh

    data = _data(spark)
    forest = md.train_forest(data, "tier", FEATS, n_trees=4, max_depth=7)
    nodes = sh.forest_nodes(forest).toPandas()
    x = np.array([[r[f] for f in FEATS] for r in data.limit(300).collect()], dtype=float)
    x[5, 0], x[6, 1], x[7, 1], x[8, 2] = np.nan, np.inf, -np.inf, np.nan
    for _, g in nodes.groupby("treeID"):
        tree = sh._tree_arrays(g)
        walked = sh.tree_shap(x, *tree, n_features=4)
        assert np.allclose(sh.box_shap(x, sh.leaf_boxes(*tree, 4)), walked, atol=1e-12)
        wide = sh.box_shap(np.pad(x, ((0, 0), (0, 2))), sh.leaf_boxes(*tree, 6))
        assert np.allclose(wide[:, :4], walked, atol=1e-12) and not wide[:, 4:].any()


def test_shap_importance_over_all_rows(spark, monkeypatch):
    from tabulon.operators import shap as sh

    data = _data(spark).withColumn("rk", F.monotonically_increasing_id())
    forest = md.train_forest(data, "tier", FEATS, n_trees=3, max_depth=4)
    each = sh.shap_values(forest, data, FEATS, "rk")
    assert each.count() == data.count() * 4 * 3
    want = {r["feature"]: r["m"] for r in each.groupBy("feature").agg(F.avg(F.abs("shap")).alias("m")).collect()}
    got = {r["feature"]: r for r in sh.shap_importance(forest, data, FEATS).collect()}
    assert all(abs(got[f]["shap"] - want[f]) < 1e-9 and got[f]["position"] == i for i, f in enumerate(FEATS))
    assert sh.shap_importance(forest, data.limit(0), FEATS).collect() == []


def test_shap_explains_every_cell_once(spark):
    """Rows between the same cuts are explained together, with nulls and infinities."""
    from tabulon.operators import shap as sh

    data = _data(spark)
    forest = md.train_forest(data, "tier", FEATS, n_trees=3, max_depth=4)
    odd = data.withColumn("l_tax", F.when(F.col("l_linenumber") == 2, F.lit(None)).when(
        F.col("l_linenumber") == 3, F.lit(float("-inf"))).when(F.col("l_linenumber") == 4, F.lit(float("nan")))
        .otherwise(F.col("l_tax"))).withColumn("rk", F.monotonically_increasing_id())
    shared = spark.sparkContext.broadcast(sh._forest(forest, len(FEATS)))
    names = [f"_f{i}" for i in range(len(FEATS))]
    found = sh.cells(odd.select(*[F.col(f).alias(n) for f, n in zip(FEATS, names)]), shared, names)
    counted = found.agg(F.sum("n"), F.count("n")).first()
    assert counted[0] == odd.count() and counted[1] < counted[0] / 5
    want = {r["feature"]: r["m"] for r in sh.shap_values(forest, odd, FEATS, "rk").groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("m")).collect()}
    got = {r["feature"]: r["shap"] for r in sh.shap_importance(forest, odd, FEATS).collect()}
    assert all(abs(got[f] - want[f]) < 1e-9 for f in FEATS)


def test_few_distinct_stops_at_the_limit(spark):
    rows = [(None if i % 9 == 0 else i % 4, f"v{i}", -0.0 if i % 2 else 0.0, None, "a") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, c double, d string, e string").repartition(5)
    assert tg.few_distinct(df, df.columns, 20) == {"a": 4, "b": 21, "c": 1, "d": 0, "e": 1}
    assert tg.detect_target(df.select("b", "e")).first()["target"] == "e"
    assert tg.guess_stratify_column(df.withColumnRenamed("b", "status")).first()[:] == ("status", "known_name", 3000)


def test_train_agent_end_to_end(spark):
    from tabulon.plans.train import train_agent

    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(*KEYS, *FEATS)
    st = train_agent(li, KEYS, target_request="l_extendedprice_tier", n_trees=10, permutation_repeats=2,
                     cv_cap=2000)
    assert st.target == "l_extendedprice_tier" and sorted(st.features) == sorted(FEATS)
    assert st.tree_accuracy > 0.9 and st.forest_accuracy > 0.9
    assert st.rules.count() >= 3
    assert st.importances.count() == len(FEATS)
    cv = st.cv.first()
    assert 2 <= cv["n_folds"] <= 5 and cv["cv_mean"] > 0.8
    splits = {r[0]: r[1] for r in st.data.groupBy("split").count().collect()}
    assert abs(splits["test"] / (splits["test"] + splits["train"]) - 0.2) < 0.01
