"""Rule reasoning and Bayesian abduction on small hand-computed tables."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import bayes, rules as rl
from tabulon.operators.target import equal_width_edges

RULES = [
    {"conditions": ["a <= 1.0000", "b > 2.0000"], "prediction": "high", "confidence": 0.9, "samples": 10},
    {"conditions": ["a > 1.0000"], "prediction": "low", "confidence": 0.8, "samples": 5},
    {"conditions": ["a <= 1.0000", "b <= 2.0000"], "prediction": "low", "confidence": 0.9, "samples": 7},
    {"conditions": [], "prediction": "high", "confidence": 1.0, "samples": 1},
    {"conditions": ["zz > 3.0000"], "prediction": "High", "confidence": 0.5, "samples": 2},
]


def test_deduce_scores_unknown_as_true_and_skips_empty(spark):
    facts = spark.createDataFrame([(1, 0.5, 3.0), (2, 2.0, None)], "id int, a double, b double")
    out = rl.deduce(facts, rl.rules_frame(spark, RULES), ["id"], top_k=5).collect()
    by = {(r["id"], r["rule_id"]): r for r in out}
    assert (1, 3) not in by  # rule without conditions is skipped
    assert by[(1, 0)]["match_score"] == 1.0 and by[(1, 2)]["match_score"] == 0.5
    assert by[(1, 4)]["match_score"] == 1.0 and by[(1, 4)]["known_conditions"] == 0
    first = [r for r in out if r["id"] == 1 and r["rank"] == 1][0]
    assert first["rule_id"] == 0  # score 1.0, confidence 0.9 beats rule 4 (0.5)
    # fact 2: b unknown -> conditions on b count as satisfied
    assert by[(2, 0)]["match_score"] == 0.5 and by[(2, 1)]["match_score"] == 1.0


def test_deduce_tie_keeps_rule_order(spark):
    rules = [{"conditions": ["a <= 5.0000"], "prediction": "x", "confidence": 0.7, "samples": 1},
             {"conditions": ["a <= 6.0000"], "prediction": "y", "confidence": 0.7, "samples": 1}]
    facts = spark.createDataFrame([(1, 1.0)], "id int, a double")
    out = rl.deduce(facts, rl.rules_frame(spark, rules), ["id"], top_k=2).orderBy("rank").collect()
    assert [r["rule_id"] for r in out] == [0, 1]


def test_parse_condition(spark):
    df = spark.createDataFrame([("x_1 <= 10.5000",), ("y > -3.2500",)], "c string")
    got = [tuple(r) for r in df.select(rl.parse_condition(df["c"]).alias("p")).select("p.*").collect()]
    assert got == [("x_1", "<=", 10.5), ("y", ">", -3.25)]


def test_abduce_direction_and_example(spark):
    imp = spark.createDataFrame([("a", 0.3, 0.01, 0), ("b", 0.5, 0.02, 1), ("c", 0.1, 0.0, 2)],
                                "feature string, importance double, importance_std double, position int")
    out = {r["feature"]: r for r in rl.abduce(rl.rules_frame(spark, RULES), imp, "HIGH", top_k=2).collect()}
    assert set(out) == {"a", "b"}
    assert out["b"]["rank"] == 1 and out["b"]["direction"] == "large"  # one '>' condition
    assert out["a"]["direction"] == "small" and out["a"]["example_condition"] == "a <= 1.0000"
    assert out["a"]["n_matching_rules"] == 3  # 'high' twice and 'High' once


def test_equal_width_edges_match_cut_rules():
    e = equal_width_edges(0.0, 10.0, 5)
    assert e[1:] == [2.0, 4.0, 6.0, 8.0, 10.0] and abs(e[0] - (-0.01)) < 1e-12
    c = equal_width_edges(5.0, 5.0, 5)
    assert abs(c[0] - 4.995) < 1e-12 and abs(c[-1] - 5.005) < 1e-12


def test_bayes_fit_smoothing_and_explain(spark):
    rows = [(0.0, "x")] * 3 + [(10.0, "y")] * 2 + [(10.0, "x")]
    df = spark.createDataFrame(rows, "f double, cls string")
    cpt = {(r["bin"], r["class"]): r for r in bayes.fit(df, "cls", ["f"], bins=5).collect()}
    # observed bins 0 and 4; class x: (3+1)/(3+1+1+1) and (1+1)/6
    assert abs(cpt[(0, "x")]["likelihood"] - 4 / 6) < 1e-12
    assert abs(cpt[(4, "y")]["likelihood"] - 3 / 4) < 1e-12
    assert cpt[(0, "x")]["bin_label"] == "0"  # not all bins observed -> bin index label
    ex = bayes.explain(bayes.fit(df, "cls", ["f"], bins=5), "y", top_k=3).collect()
    assert len(ex) == 1 and ex[0]["feature"] == "f"
    with pytest.raises(ValueError):
        bayes.explain(bayes.fit(df, "cls", ["f"]), "nope")


def test_large_rule_base_against_brute_force(spark, monkeypatch):
    """Thousands of rules, several per score and confidence, over missing, odd and tied values."""
    rng = random.Random(8)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 3.0]
    facts = [(i, rng.choice(odd) if rng.random() < 0.3 else rng.randrange(12) / 2,
              rng.choice([None, "4", " 2.5 ", "x", "nan", "7"]), rng.randrange(9)) for i in range(120)]
    base = []
    for _ in range(1500):
        conds = [f"{rng.choice(['a', 'b', 'c', 'absent'])} {rng.choice(['<=', '>'])} {rng.randrange(14) / 2}"
                 for _ in range(rng.choice([0, 1, 2, 3, 7]))]
        base.append({"conditions": conds, "prediction": f"p{rng.randrange(3)}", "confidence": rng.randrange(20) / 20,
                     "samples": rng.randrange(99)})

    def holds(cond, fact):
        name, op, number = cond.split()
        v = {"a": fact[1], "c": fact[3]}.get(name)
        if name == "b" and fact[2] not in (None, "x"):
            v = float(fact[2])
        if name == "absent" or v is None:
            return True, False
        return (v <= float(number) if op == "<=" else v > float(number)), True

    want = []
    for f in facts:
        scored = []
        for k, r in enumerate(base):
            if r["conditions"]:
                got = [holds(c, f) for c in r["conditions"]]
                score = round(sum(g for g, _ in got) / len(got) + 1e-12, 4)
                scored.append((-score, -r["confidence"], k, sum(k for _, k in got)))
        want += [(f[0], n, k, -s, -c, known) for n, (s, c, k, known) in enumerate(sorted(scored)[:5], 1)]
    df = spark.createDataFrame(facts, "id int, a double, b string, c int").withColumn("_best", F.lit("clash"))
    rules = rl.rules_frame(spark, base)

    def run():
        out = rl.deduce(df, rules, ["id"], top_k=5)
        return sorted((r["id"], r["rank"], r["rule_id"], r["match_score"], r["confidence"], r["known_conditions"])
                      for r in out.collect())

    assert run() == sorted(want)
    monkeypatch.setattr(rl, "RULES_PER_PASS", 400)      # several broadcasts
    assert run() == sorted(want)
