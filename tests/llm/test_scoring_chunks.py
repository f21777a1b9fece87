"""Toxicity scores do not depend on how many words are scored together."""

import numpy as np
from pyspark.sql import functions as F

from tabulon.llm import toxicity
from tabulon.llm.scratch import prepare


def test_scores_do_not_depend_on_the_words_scored_together(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 40, 30)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id long, text string, y int").coalesce(1)
    model = toxicity.fit(rows, "y", "text")
    runs = [len(rows_) for _, rows_, _ in toxicity._chunks([t.encode() for t in texts], 300)]
    assert len(runs) > 1 and sum(runs) == len(texts)
    whole = {r["id"]: r["_x"] for r in toxicity.differences(rows, model, ["id"], "text").collect()}
    for i in (0, 31, 59):
        alone = toxicity.differences(rows.where(F.col("id") == i), model, ["id"], "text").first()["_x"]
        assert alone == whole[i]
