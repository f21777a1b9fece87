"""R-03 with a few rules: one projection, the same rows as with the matrix, and no Python workers."""

import math

from pyspark.sql import functions as F

from tabulon.functions.columns import small_table
from tabulon.operators import rules as rl


def _facts(spark):
    odd = [float("nan"), math.inf, -math.inf, -0.0, None]
    rows = [(i, float(i % 7), odd[i % 5] if i % 3 == 0 else i / 9, str(i % 4) if i % 6 else "nan") for i in range(400)]
    return spark.createDataFrame([*rows, *rows[:20]], "k int, a double, b double, c string")


def _rules(spark):
    rows = [(0, ["a <= 3.0000", "b > 2.5000"], "x", 0.9, 10), (1, ["a > 3.0000", "b <= 0.0000", "c > 1.0000"], "y", 0.9, 20),
            (2, [], "none", 1.0, 5), (3, ["missing > 1.0000", "a > 5.0000"], "z", None, 7),
            (4, ["b <= nan"], "n", float("nan"), 1), (5, ["c <= 2.0000", "c > 0.0000", "a > 1.0000"], None, 0.3, 3)]
    return spark.createDataFrame(rows, rl.RULE_SCHEMA)


def test_few_rules_are_a_projection_with_the_same_rows(spark, monkeypatch):
    facts, rules = _facts(spark), _rules(spark)
    for top_k in (1, 3, 9):
        few = rl.deduce(facts, rules, ["k"], top_k=top_k)
        assert "MapInArrow" not in few._jdf.queryExecution().toString()
        monkeypatch.setattr(rl, "FEW_CONDITIONS", 0)
        many = rl.deduce(facts, rules, ["k"], top_k=top_k)
        monkeypatch.undo()
        assert "MapInArrow" in many._jdf.queryExecution().toString()
        assert few.dtypes == many.dtypes
        got, want = (sorted(map(str, x.collect())) for x in (few, many))
        assert got == want and len(got) == 420 * min(top_k, 5)


def test_rules_with_no_known_feature(spark):
    rules = _rules(spark).where(F.col("rule_id") == 3)
    got = rl.deduce(_facts(spark).select("k", "b"), rules, ["k"], top_k=2)
    assert {(r["rank"], r["match_score"], r["known_conditions"]) for r in got.collect()} == {(1, 1.0, 0)}


def test_a_small_table_is_made_without_python_workers(spark):
    rows = [(1, None, ["a"], True), (None, "x", [], None)]
    got = small_table(spark, rows, "i int, s string, a array<string>, b boolean")
    assert got.dtypes == [("i", "int"), ("s", "string"), ("a", "array<string>"), ("b", "boolean")]
    assert [tuple(r) for r in got.collect()] == rows
    assert "LocalTableScan" in got._jdf.queryExecution().executedPlan().toString()
    assert small_table(spark, [], "i int").count() == 0
