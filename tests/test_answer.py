"""Prompt -> answer plans on hand-written prompts."""

from pyspark.sql import functions as F

from tabulon.operators import bayes
from tabulon.operators.rules import rules_frame
from tabulon.plans.answer import facts_table, predict_from_prompts, why_from_prompts

RULES = [
    {"conditions": ["a <= 1.0000"], "prediction": "low", "confidence": 0.9, "samples": 5},
    {"conditions": ["a > 1.0000", "b <= 2.0000"], "prediction": "high", "confidence": 0.8, "samples": 4},
    {"conditions": ["a > 1.0000", "b > 2.0000"], "prediction": "mid", "confidence": 0.7, "samples": 3},
]


def test_predict_from_prompts(spark):
    prompts = spark.createDataFrame([(1, "predict if a=0.5"), (2, "predict if a is 3 and b: 1"),
                                     (3, "why is it low?"), (4, "classify when A = 9, B=7")], "id int, text string")
    wide = {r["id"]: (r["a"], r["b"]) for r in facts_table(prompts, ["id"], "text", ["a", "b"]).collect()}
    assert wide == {1: (0.5, None), 2: (3.0, 1.0), 3: (None, None), 4: (9.0, 7.0)}
    out = {r["id"]: r["prediction"] for r in
           predict_from_prompts(prompts, ["id"], "text", rules_frame(spark, RULES), ["a", "b"]).collect()}
    assert out == {1: "low", 2: "high", 4: "mid"}  # prompt 3 is a "why" question


def test_why_from_prompts(spark):
    data = spark.createDataFrame([(float(i), float(i % 3), "low" if i < 5 else "high") for i in range(10)],
                                 "a double, b double, y string")
    imp = spark.createDataFrame([("a", 0.5, 0.0, 0), ("b", 0.1, 0.0, 1)],
                                "feature string, importance double, importance_std double, position int")
    prompts = spark.createDataFrame([(1, "why so HIGH?"), (2, "why?"), (3, "predict if a=1")], "id int, text string")
    out = why_from_prompts(prompts, ["id"], "text", ["high", "low"], rules_frame(spark, RULES), imp,
                           bayes.fit(data, "y", ["a", "b"]), top_k=2, bayes_k=1)
    observed = {r["id"]: r["observed"] for r in out.select("id", "observed").distinct().collect()}
    assert observed == {1: "high", 2: "low"}  # no class named -> the last class
    assert out.where(F.col("source") == "bayes").count() == 2
