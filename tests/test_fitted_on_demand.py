"""Models are fitted on demand, over a table dealt out evenly."""

from pyspark.sql import functions as F

from tabulon.functions import columns
from tabulon.operators import model as md
from tabulon.plans import train as tr


def _rows(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("a"),
                                 (F.col("id") * 7 % 31).cast("double").alias("b"))


def test_a_part_is_fitted_only_when_asked_for(spark, monkeypatch):
    monkeypatch.setattr(md, "train_forest", lambda *a, **k: (_ for _ in ()).throw(AssertionError("no forest asked for")))
    state = tr.train_agent(_rows(spark, 600), ["k"], target_request="a_tier", n_trees=2, cv_cap=100)
    assert state.tree_accuracy > 0.9 and state.rules.count() >= 3
    assert state.tree is state.tree


def test_the_training_table_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(columns, "FEW_ROWS", 500)
    monkeypatch.setattr(columns, "ROWS_PER_TASK", 100)
    state = tr.train_agent(_rows(spark, 600), ["k"], target_request="a_tier")
    sizes = [r["count"] for r in state.data.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) <= 110 and sum(sizes) == 600


def _counted_reads(spark, df):
    """The table in one task, and how many of its rows were handed out in all."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.coalesce(1).mapInArrow(run, df.schema), read


def test_a_large_table_is_read_once_and_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(columns, "FEW_ROWS", 500)
    monkeypatch.setattr(columns, "ROWS_PER_TASK", 100)
    df, read = _counted_reads(spark, _rows(spark, 600))
    assert tr.train_agent(df, ["k"], target_request="a_tier").tree_accuracy > 0.9
    assert read.value <= 2 * 600   # its size and its rows
    df, read = _counted_reads(spark, _rows(spark, 600).select("a", "b"))
    assert md.regress(df, "a", n_trees=2, max_depth=3)[0].count() == 1 and read.value <= 2 * 600
