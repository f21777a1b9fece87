"""op5 with a model beyond what a task holds: looked up a piece at a time, without a shuffle of the texts' n-grams."""

import subprocess

from pyspark.sql import functions as F

from tabulon.llm import toxicity
from tabulon.llm.scratch import prepare, written


def _labelled(spark, n=400):
    texts = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda w: F.concat(
        F.lit("w"), F.pmod(F.xxhash64("id", w), F.lit(90)).cast("string"))))
    return spark.range(n).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"), F.when(
        F.col("id") % 5 == 0, F.concat(F.lit("vile words "), texts)).when(F.col("id") % 7 != 0, texts).alias("text"))


def test_a_large_model_is_streamed_through_the_tasks(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(toxicity, "PIECE", 300)
    df = _labelled(spark)
    model = toxicity.fit(df, "y", "text")
    assert model.bits > 1
    want = sorted(toxicity.differences(df, model, ["id"], "text").collect())
    joined = sorted(toxicity.differences(df, model, ["id"], "text", limit=0, streamed=0).collect())
    monkeypatch.setattr(toxicity, "STREAMED_BYTES", 1000)
    monkeypatch.setattr(toxicity, "_joined", None)
    streamed = toxicity.differences(df, model, ["id"], "text", limit=0)
    assert "Exchange" not in streamed._jdf.queryExecution().executedPlan().toString()
    assert sorted(streamed.collect()) == want == joined and len(want) == 400


def test_shuffles_go_when_their_table_is_written(spark):
    prepare(spark)
    # the same table, with and without: the shuffles that are left
    def left(**kw):
        before = _shuffle_files(spark)
        kept.append(written(_labelled(spark, 1000).repartition(3, "y"), **kw))
        return len(_shuffle_files(spark) - before)

    kept = []
    assert left() > 0 and left(drop_shuffles=True) == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    found = subprocess.run(["find", *folders, "-name", "shuffle_*.data"], capture_output=True, text=True)
    return set(found.stdout.split())
