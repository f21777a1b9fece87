"""A large file is dealt by its rows' places, without a sort of its only split before."""

from pyspark.sql import functions as F

from tabulon.functions import columns
from tabulon.operators import clean as cl
from tabulon.plans import train as tr


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_files_are_dealt_by_place(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    spark.range(5000, numPartitions=1).select("id", (F.col("id") % 2).alias("same")).write.parquet(path)
    monkeypatch.setattr(columns, "FEW_ROWS", 500)
    monkeypatch.setattr(columns, "ROWS_PER_TASK", 1000)
    few = spark.read.parquet(path).select("same")   # equal rows are dealt out as well
    got = columns.dealt_out(few, 5000)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.columns == ["same"] and sum(sizes) == 5000 and len(sizes) == 5 and max(sizes) < 1150
    assert columns.PLACE in got._jdf.queryExecution().logical().toString()
    other = columns.dealt_out(few.groupBy("same").count(), 5000)   # no file: dealt in turn
    assert columns.PLACE not in other._jdf.queryExecution().logical().toString() and other.count() == 2
    got.unpersist()
    other.unpersist()


def test_the_target_is_not_parsed_and_whole_columns_are_not_estimated(spark, monkeypatch):
    df = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 9 > 0, F.col("id") % 5)
                                .cast("double").alias("b"), (F.col("id") % 3).cast("string").alias("y"))
    seen, parsed = [], []
    stats, number = cl.pipeline_stats, cl.numeric_text_expr
    monkeypatch.setattr(cl, "pipeline_stats", lambda *a, **k: seen.append(k["estimate"]) or stats(*a, **k))
    monkeypatch.setattr(cl, "numeric_text_expr", lambda c: parsed.append(c) or number(c))
    out = cl.clean(df, target="y")
    assert seen == [["b"]] and not parsed
    assert out.where(F.col("b").isNull()).count() == 0 and out.columns == ["a", "b", "y"]


def test_the_capped_sample_is_the_first_rows_in_hash_order(spark):
    rows = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("a"),
                                   (F.col("id") * 7 % 31).cast("double").alias("b"))
    drawn = []
    state = tr.train_agent(rows, ["k"], target_request="a_tier", cv_cap=30)
    sample, state_data = tr.sp.capped_sample, state.data
    want = {r["k"] for r in state_data.orderBy(F.md5(F.col("k").cast("string"))).limit(30).collect()}
    try:
        tr.sp.capped_sample = lambda df, keys, cap: drawn.append(df.count()) or sample(df, keys, cap)
        folds, cross = [], tr.md.cross_validate
        tr.md.cross_validate = lambda capped, *a, **k: folds.append({r["k"] for r in capped.collect()}) or capped
        assert state.cv is not None
    finally:
        tr.sp.capped_sample, tr.md.cross_validate = sample, cross
    assert folds == [want] and drawn == [state.test.count()]   # the test rows hold the first of every class
