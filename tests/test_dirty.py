"""Dirty values: NaN, clashing names, Java number forms, malformed rules, prompts without facts, large paths."""



from pyspark.sql import functions as F

from tabulon.functions import ordering
from tabulon.operators import bayes, clean, rules
from tabulon.plans import answer


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(i, nan if i % 3 == 0 else float(i), nan, "ab"[i % 2]) for i in range(30)],
                               "k long, x double, gone double, t string")
    assert "gone" not in clean.drop_empty_columns(df).columns
    filled = clean.fill_numeric_median(df.drop("gone"))
    assert filled.where(F.isnan("x") | F.col("x").isNull()).count() == 0
    out = clean.clean(df, target="t")
    assert "gone" not in out.columns and out.where(F.isnan("x") | F.col("x").isNull()).count() == 0
    imputed = clean.apply_impute(df, {"x": "median"})
    assert imputed.where(F.isnan("x")).count() == 0


def test_names_stay_unique():
    assert clean.unique_names(["k", "k", "k_1", "Age", "age", "k"]) == ["k", "k_2", "k_1", "Age", "age_1", "k_3"]


def test_java_number_forms_are_text(spark):
    df = spark.createDataFrame([(s,) for s in ("5d", "5F", "0x1p3", " 5 ", "1e3", ".5", "5.", "-2", "")], "t string")
    got = [r[0] for r in clean.safe_numeric(df, ["t"]).collect()]
    assert got == [None, None, None, 5.0, 1000.0, 0.5, 5.0, -2.0, None]
    assert [r[0] for r in clean.apply_cast(df, {"t": "float"}).collect()] == got


def test_malformed_conditions_are_left_out(spark):
    base = spark.createDataFrame([(0, ["x <= 1.5", "nonsense", "x > many"], "a", 0.9, 3)], rules.RULE_SCHEMA)
    assert [r["op"] for r in rules.parse_rules(base).collect()] == ["<="]


def test_nan_fact_satisfies_nothing(spark):
    facts = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, None)], "k long, x double")
    base = spark.createDataFrame([(0, ["x > 1.0"], "a", 0.9, 3)], rules.RULE_SCHEMA)
    got = {r["k"]: r["match_score"] for r in rules.deduce(facts, base, ["k"]).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 1.0}


def test_deduction_in_chunks_equals_one_projection(spark, monkeypatch):
    facts = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 1.7 % 5).alias("x"))
    base = spark.createDataFrame([(i, [f"x > {i % 7}.5", f"x <= {i % 5}.0"], "ab"[i % 2], i / 40, i) for i in range(30)],
                                 rules.RULE_SCHEMA)
    once = sorted(map(tuple, rules.deduce(facts, base, ["k"]).collect()))
    monkeypatch.setattr(rules, "RULES_PER_PASS", 4)
    assert sorted(map(tuple, rules.deduce(facts, base, ["k"]).collect())) == once


def test_prompts_without_facts_get_no_prediction(spark):
    base = spark.createDataFrame([(0, ["price > 1.0"], "a", 0.9, 3)], rules.RULE_SCHEMA)
    prompts = spark.createDataFrame([(1, "predict the class"), (2, "predict with price = 5"), (3, "predict price = 5d")],
                                    "k long, t string")
    got = answer.predict_from_prompts(prompts, ["k"], "t", base, ["price"]).collect()
    assert [r["k"] for r in got] == [2]


def test_categories_in_the_bayes_table(spark):
    df = spark.createDataFrame([("red", 1.0, "y"), ("red", 2.0, "y"), ("blue", 3.0, "n"), (None, 4.0, "n")],
                               "colour string, x double, label string")
    cpt = bayes.fit(df, "label", alpha=1.0).where("feature = 'colour'")
    got = {(r["bin_label"], r["class"]): (r["n"], round(r["likelihood"], 4)) for r in cpt.collect()}
    assert got == {("red", "y"): (2, 0.75), ("blue", "y"): (0, 0.25), ("red", "n"): (0, 0.3333), ("blue", "n"): (1, 0.6667)}


def test_rank_paths_agree_with_null_classes(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") % 3).cast("string"))
                                 .alias("g"))
    small = ordering.rank_within(df, "g", F.xxhash64("id"))
    large = ordering.rank_within(df, "g", F.xxhash64("id"), window_limit=1)
    rows = lambda d: sorted((r["id"], r["rank"]) for r in d.collect())
    assert large.count() == 100 and rows(small) == rows(large)


def test_quantile_and_code_paths_agree(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).cast("double").alias("x"))
    long = ordering.long_values(df, ["x"])
    rows = lambda d: sorted((r["prob"], round(r["quantile"], 9)) for r in d.collect())
    assert rows(ordering.exact_quantiles(long, [0.1, 0.5, 0.9])) == \
        rows(ordering.exact_quantiles(long, [0.1, 0.5, 0.9], in_memory_limit=1))
    code = lambda small: sorted((r["value"], r["code"]) for r in ordering.dense_codes(long, small=small).collect())
    assert code(True) == code(False)

