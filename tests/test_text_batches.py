"""Texts reach Python in batches of bounded bytes."""

import pyarrow as pa
import numpy as np
from pyspark.sql import functions as F

from tabulon.operators import text as tx


def test_texts_come_in_batches_of_bounded_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 200, 1, 1).select("id", F.repeat(F.lit("some long words "), 8000).alias("text"))
    words = tx.words_of(docs, "id", "text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    seen = [r["n"] for r in words.coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert len(seen) >= 2 and max(seen) <= 10 << 20
    assert words.count() == 200


def test_words_of_a_batch_are_numbered_in_small_parts(spark, monkeypatch):
    """One long text, many short ones, nulls and empty texts: parts of bounded bytes, same counts and weights."""
    texts = ["alpha beta gamma " * 900, None, "", "  "] + [f"alpha w{i} beta" for i in range(300)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)

    def result():
        postings, vocab = tx.tfidf_index(docs, "id", "text", max_terms=50)
        return sorted(map(tuple, vocab.collect())), sorted(map(tuple, postings.collect()))

    want = result()
    monkeypatch.setattr(tx, "SLICE_BYTES", 1000)
    parts = list(tx.slices(batch))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert len(parts) > 5 and all(p.nbytes <= 1000 or p.num_rows == 1 for p in parts)
    monkeypatch.setattr(tx, "FLUSH_TERMS", 20)
    monkeypatch.setattr(tx, "NAMED_TERMS", 7)
    got = result()
    assert got[0] == want[0] and [r[:3] for r in got[1]] == [r[:3] for r in want[1]]
    assert np.allclose([r[3] for r in got[1]], [r[3] for r in want[1]], atol=1e-12)


def test_counting_a_batch_holds_no_words_of_all_its_texts():
    import tracemalloc

    texts = [" ".join(f"word{(i * j) % 5000}" for j in range(1000)) for i in range(500)]   # 0.5M words
    tracemalloc.start()
    flat, text = tx.Numbers().batch(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(flat) == len(text) == 500_000 and peak < 25e6   # as lists of words: 37 MB
