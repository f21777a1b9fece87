"""Catalog entries for the model operators M-01..M-13 and artefacts S-07..S-09.

Training runs on the whole lineitem table (target: tiers of
l_extendedprice).  Fitted state is kept per (session, folder) so the model
queries of one run share a single training; model outputs are checked by
invariants (rows-only), evaluation tables over a fixed predictor by SQL.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tabulon.operators import model as md
from tabulon.operators import rules as rl
from tabulon.operators import sample as sp
from tabulon.operators import target as tg
from tabulon.plans.catalog.common import t
from tabulon.plans.train import train_agent
from tabulon.session import checkpoint_dir
from tabulon.sources import artifacts as art

QUERIES = {}
SQL = {}

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_STATE = {}


def _training_table(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select(*KEYS, *FEATURES)


def state(spark, sf_dir, **kw):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STATE:
        _STATE[key] = train_agent(_training_table(spark, sf_dir), KEYS, target_request="l_extendedprice_tier",
                                  with_cv=True, **kw)
    return _STATE[key]


def m01_tree_accuracy(spark, sf_dir):
    s = state(spark, sf_dir)
    return spark.createDataFrame([("decision_tree", float(s.tree_accuracy))], "model string, accuracy double")


QUERIES["m01_tree_accuracy"] = m01_tree_accuracy


def m02_forest_accuracy(spark, sf_dir):
    s = state(spark, sf_dir)
    return spark.createDataFrame([("random_forest", float(s.forest_accuracy))], "model string, accuracy double")


QUERIES["m02_forest_accuracy"] = m02_forest_accuracy


def m03_test_predictions(spark, sf_dir):
    s = state(spark, sf_dir)
    test = s.data.where(F.col("split") == "test")
    return md.predict(s.forest, test, s.target, s.features).select(*KEYS, s.target, "predicted_class")


QUERIES["m03_test_predictions"] = m03_test_predictions


def m04_cross_validation(spark, sf_dir):
    return state(spark, sf_dir).cv


QUERIES["m04_cross_validation"] = m04_cross_validation


def m05_permutation_importance(spark, sf_dir):
    return state(spark, sf_dir).importances


QUERIES["m05_permutation_importance"] = m05_permutation_importance


def m06_shap_importance(spark, sf_dir):
    from tabulon.operators.shap import shap_importance
    s = state(spark, sf_dir)
    train = s.data.where(F.col("split") == "train")
    return shap_importance(s.forest, train, s.features)


QUERIES["m06_shap_importance"] = m06_shap_importance


def m13_drivers_from_model(spark, sf_dir):
    """SHAP when present, else permutation importance (both from the trained forest)."""
    s = state(spark, sf_dir)
    imp = s.importances.join(m06_shap_importance(spark, sf_dir).select("feature", "shap"), "feature", "left")
    return md.driver_ranking(imp, top=8)


QUERIES["m13_drivers_from_model"] = m13_drivers_from_model


def m07_tree_rules(spark, sf_dir):
    return state(spark, sf_dir).rules


QUERIES["m07_tree_rules"] = m07_tree_rules


def m07_rules_deduce(spark, sf_dir):
    """The loop closed: learned rules (M-07) applied to the test rows (R-03)."""
    s = state(spark, sf_dir)
    test = s.data.where(F.col("split") == "test").select(*KEYS, *s.features)
    return rl.deduce(test, s.rules, KEYS, top_k=1)


QUERIES["m07_rules_deduce"] = m07_rules_deduce


def m11_class_probabilities(spark, sf_dir):
    s = state(spark, sf_dir)
    row = md.medians_row(s.data, s.features, {"l_extendedprice": 50000.0})
    return md.class_probabilities(s.tree, row, s.features)


QUERIES["m11_class_probabilities"] = m11_class_probabilities


def _regression(spark, sf_dir):
    """One fitted forest serves both tables of M-12."""
    key = (spark.sparkContext.applicationId, sf_dir, "m12")
    if key not in _STATE:
        li = t(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
        _STATE[key] = md.regress(li, "l_extendedprice", {"l_quantity": 10})
    return _STATE[key]


def m12_regression(spark, sf_dir):
    return _regression(spark, sf_dir)[0]


QUERIES["m12_regression"] = m12_regression


def m12_regression_importances(spark, sf_dir):
    return _regression(spark, sf_dir)[1]


QUERIES["m12_regression_importances"] = m12_regression_importances


def s07_rules_roundtrip(spark, sf_dir):
    path = os.path.join(checkpoint_dir(spark), f"rules-{uuid.uuid4().hex}")
    art.save_rules(state(spark, sf_dir).rules, path)
    return art.load_rules(spark, path)


QUERIES["s07_rules_roundtrip"] = s07_rules_roundtrip


def s08_importances_roundtrip(spark, sf_dir):
    path = os.path.join(checkpoint_dir(spark), f"importances-{uuid.uuid4().hex}")
    art.save_importances(state(spark, sf_dir).importances, path)
    return art.load_importances(spark, path)


QUERIES["s08_importances_roundtrip"] = s08_importances_roundtrip


def s09_model_roundtrip(spark, sf_dir):
    s = state(spark, sf_dir)
    path = os.path.join(checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    art.save_model(s.tree, path)
    loaded = art.load_model(path)
    test = s.data.where(F.col("split") == "test")
    return md.accuracy(md.predict(loaded, test, s.target, s.features))


QUERIES["s09_model_roundtrip"] = s09_model_roundtrip


# --- SQL-checked evaluation over a fixed threshold predictor --------------------

def _fixed_predictions(spark, sf_dir):
    li = tg.tier(t(spark, sf_dir, "lineitem"), "l_extendedprice", "actual_tier")
    pred = F.when(F.col("l_quantity") <= 17, "low").when(F.col("l_quantity") <= 34, "medium").otherwise("high")
    return li.withColumn("predicted_tier", pred)


_FIXED_SQL = """
q AS (SELECT quantile_cont(l_extendedprice, 0.33) AS a, quantile_cont(l_extendedprice, 0.67) AS b FROM lineitem),
s AS (SELECT *, CASE WHEN l_extendedprice <= a THEN 'low' WHEN l_extendedprice <= b THEN 'medium' ELSE 'high' END
                  AS actual_tier,
             CASE WHEN l_quantity <= 17 THEN 'low' WHEN l_quantity <= 34 THEN 'medium' ELSE 'high' END AS predicted_tier
      FROM lineitem, q)"""


def m08_confusion(spark, sf_dir):
    return md.confusion(_fixed_predictions(spark, sf_dir), "actual_tier", "predicted_tier")


QUERIES["m08_confusion"] = m08_confusion
SQL["m08_confusion"] = "WITH " + _FIXED_SQL.strip() + """
SELECT actual_tier AS actual, predicted_tier AS predicted, count(*) AS n FROM s GROUP BY 1, 2"""


def m09_classification_report(spark, sf_dir):
    r = md.classification_report(md.confusion(_fixed_predictions(spark, sf_dir), "actual_tier", "predicted_tier"))
    return r.select("class", "support", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


QUERIES["m09_classification_report"] = m09_classification_report
SQL["m09_classification_report"] = "WITH " + _FIXED_SQL.strip() + """,
c AS (SELECT actual_tier AS actual, predicted_tier AS predicted, count(*) AS n FROM s GROUP BY 1, 2),
per AS (
  SELECT k.cls AS class,
         CAST(coalesce((SELECT sum(n) FROM c WHERE actual = k.cls), 0) AS BIGINT) AS support,
         CAST(coalesce((SELECT sum(n) FROM c WHERE actual = k.cls AND predicted = k.cls), 0) AS BIGINT) AS tp,
         CAST(coalesce((SELECT sum(n) FROM c WHERE predicted = k.cls), 0) AS BIGINT) AS n_pred
  FROM (SELECT actual AS cls FROM c UNION SELECT predicted FROM c) k),
m AS (SELECT class, support,
             CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM m)
SELECT class, support, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM f
UNION ALL SELECT 'macro avg', CAST(sum(support) AS BIGINT), round(avg(precision), 8), round(avg(recall), 8), round(avg(f1), 8) FROM f
UNION ALL SELECT 'weighted avg', CAST(sum(support) AS BIGINT), round(sum(precision * support) / sum(support), 8),
                 round(sum(recall * support) / sum(support), 8), round(sum(f1 * support) / sum(support), 8) FROM f"""


def m10_train_test_gap(spark, sf_dir):
    p = _fixed_predictions(spark, sf_dir)
    p = sp.stratified_split(p, "actual_tier", KEYS, 0.2)
    g = md.train_test_gap(p, "split", "actual_tier", "predicted_tier")
    return g.select(*[F.round(c, 10).alias(c) for c in g.columns])


QUERIES["m10_train_test_gap"] = m10_train_test_gap
SQL["m10_train_test_gap"] = "WITH " + _FIXED_SQL.strip() + """,
h AS (SELECT *, md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                               CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                               CAST(l_shipdate AS VARCHAR))) AS hk FROM s),
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY actual_tier ORDER BY hk)
                           <= floor(count(*) OVER (PARTITION BY actual_tier) * 0.2 + 0.5) THEN 'test' ELSE 'train' END
                   AS split FROM h),
a AS (SELECT avg(CASE WHEN split = 'train' THEN CAST(actual_tier = predicted_tier AS DOUBLE) END) AS tr,
             avg(CASE WHEN split = 'test' THEN CAST(actual_tier = predicted_tier AS DOUBLE) END) AS te FROM sp)
SELECT round(tr, 10) AS train_accuracy, round(te, 10) AS test_accuracy, round(tr - te, 10) AS gap FROM a"""


def m13_driver_ranking(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    feats = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    row = li.agg(*[F.abs(F.corr(f, "l_extendedprice")).alias(f) for f in feats])
    imp = row.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance"), F.lit(None).cast("double").alias("shap"),
                 F.lit(i).alias("position")) for i, f in enumerate(feats)])))
    r = md.driver_ranking(imp, top=8)
    return r.select("rank", "feature", F.round("score", 10).alias("score"))


QUERIES["m13_driver_ranking"] = m13_driver_ranking
SQL["m13_driver_ranking"] = """
SELECT row_number() OVER (ORDER BY score DESC, position) AS rank, feature, round(score, 10) AS score FROM (
  SELECT 'l_quantity' AS feature, abs(corr(l_quantity, l_extendedprice)) AS score, 0 AS position FROM lineitem
  UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)), 1 FROM lineitem
  UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)), 2 FROM lineitem
  UNION ALL SELECT 'l_linenumber', abs(corr(l_linenumber, l_extendedprice)), 3 FROM lineitem)"""
