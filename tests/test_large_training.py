"""Steps of the training plan that large tables take: the same results as on small ones, in fewer passes."""

from pyspark.sql import functions as F

from tabulon.functions import columns, ordering
from tabulon.operators import model as md
from tabulon.operators import sample as sp
from tabulon.plans import train as tr

FEATS = ["a", "b"]


def _rows(spark, n=600):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("a"),
                                 (F.col("id") * 7 % 31).cast("double").alias("b"))


def test_bracketed_quantiles_are_exact(spark, monkeypatch):
    odd = _rows(spark, 3001).withColumn("b", F.when(F.col("k") % 5 == 0, F.lit(None)).when(
        F.col("k") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("b"))).withColumn("c", F.col("k") / 7)
    values = ordering.long_values(odd, ["a", "b", "c"])
    probs = [0.0, 0.33, 0.5, 0.67, 1.0]
    want = sorted(ordering.exact_quantiles(values, probs).collect())
    assert sorted(ordering.bracketed_quantiles(values, probs).collect()) == want
    # a bracket that misses its place is not used
    monkeypatch.setattr(ordering, "BRACKET", 0.0)
    monkeypatch.setattr(ordering, "BRACKET_ACCURACY", 3)
    got = ordering.bracketed_quantiles(values, probs)
    assert got is None or sorted(got.collect()) == want
    assert ordering.bracketed_quantiles(values.limit(0), probs) is None


def test_split_in_place_equals_the_ranks(spark):
    df = _rows(spark).withColumn("y", F.when(F.col("k") % 11 == 0, F.lit(None)).when(
        F.col("k") == 1, F.lit("one")).otherwise((F.col("k") % 3).cast("string")))
    hashed = df.withColumn("_h", sp.hash_order(["k"]))
    got = sp.stratified_split(hashed, "y", ["k"], 0.2, "_h")
    want = sp.stratified_split(df, "y", ["k"], 0.2)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 600
    assert got.rdd.getNumPartitions() == df.rdd.getNumPartitions()   # the rows stay in their tasks
    # repeated and null keys: the classes still get as many test rows
    for key in ("a", "none"):
        tied = df.withColumn("none", F.lit(None).cast("long"))
        got = sp.stratified_split(tied.withColumn("_h", sp.hash_order([key])), "y", [key], 0.2, "_h")
        want = sp.stratified_split(tied, "y", [key], 0.2)
        sizes = [sorted(map(str, x.groupBy("y", "split").count().collect())) for x in (got, want)]
        assert sizes[0] == sizes[1] and got.count() == 600


def test_a_large_table_is_trained_like_a_small_one(spark, monkeypatch):
    small = tr.train_agent(_rows(spark), ["k"], target_request="a_tier")
    monkeypatch.setattr(columns, "FEW_ROWS", 500)
    monkeypatch.setattr(ordering, "MANY_VALUES", 100)
    large = tr.train_agent(_rows(spark), ["k"], target_request="a_tier")
    assert large.data.columns == small.data.columns and large.features == small.features
    assert large.data.exceptAll(small.data).count() == 0 and large.data.count() == 600
    assert large.rules.collect() == small.rules.collect()
    assert large.data.is_cached


def test_tree_rules_take_few_jobs(spark):
    data = _rows(spark).withColumn("y", F.when(F.col("a") > 60, "x").when(F.col("b") > 10, "y").otherwise("z"))
    tree = md.train_tree(data, "y", FEATS, max_depth=4)
    sc = spark.sparkContext
    sc.setJobGroup("rules", "rules")
    try:
        rules = md.tree_rules(tree, FEATS)
        assert len(sc.statusTracker().getJobIdsForGroup("rules")) <= 4   # the model written and its schema read
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    got = [(r["rule_id"], r["conditions"], r["prediction"], r["samples"]) for r in rules.orderBy("rule_id").collect()]
    assert [g[0] for g in got] == list(range(len(got))) and sum(g[3] for g in got) == 600
    assert got[-1][1][0].startswith("a > ") and got[-1][2] == "x"


def test_folds_are_drawn_once(spark):
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = _rows(spark).withColumn("y", F.when(F.col("a") > 60, "x").otherwise("z"))
    folds = sp.stratified_folds(df, "y", ["k"], 3)
    folds = folds.mapInArrow(run, folds.schema)
    row = md.cross_validate(df, "y", FEATS, ["k"], folds, n_trees=2, max_depth=3).first()
    assert row["n_folds"] == 3 and row["cv_mean"] > 0.9 and read.value == 600


def test_permuted_copies_are_scored_by_cell(spark, monkeypatch):
    data = _rows(spark).withColumn("y", F.when(F.col("a") > 60, "x").when(F.col("b") > 10, "y").otherwise("z"))
    forest = md.train_forest(data, "y", FEATS, n_trees=4, max_depth=4)
    odd = data.withColumn("b", F.when(F.col("k") % 5 == 0, F.lit(None)).when(F.col("k") % 7 == 0, F.lit(float("nan")))
                          .when(F.col("k") % 9 == 0, F.lit(float("-inf"))).otherwise(F.col("b")))
    scored = []
    by_cell = md._scored_by_cell
    monkeypatch.setattr(md, "_scored_by_cell", lambda *a: scored.append(1) or by_cell(*a))
    got = sorted(md.permutation_importance(forest, odd, "y", FEATS, ["k"], repeats=3, bucket_rows=250).collect())
    assert scored
    monkeypatch.setattr(md, "MAX_CELLS", 0)
    assert sorted(md.permutation_importance(forest, odd, "y", FEATS, ["k"], repeats=3, bucket_rows=250).collect()) == got
    assert len(scored) == 1
