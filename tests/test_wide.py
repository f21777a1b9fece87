"""Wide tables, chunks of files, encodings without a mark."""

import math
import random

from pyspark.sql import functions as F

from tabulon.operators import profile as pr
from tabulon.operators import sample as sp
from tabulon.sources import files


def _numbers(spark, n_cols, n_rows=400):
    rng = random.Random(n_cols)
    rows = [tuple(None if rng.random() < 0.15 else 1e6 + rng.gauss(0, 1) * (c + 1) + r * (c % 3) for c in range(n_cols - 2))
            + (7.0, None) for r in range(n_rows)]
    return spark.createDataFrame(rows, ", ".join(f"`c.{i}` double" for i in range(n_cols))).repartition(37)


def test_gram_blocks_equal_corr(spark, monkeypatch):
    df = _numbers(spark, 9)
    want = {(r["col_a"], r["col_b"]): r["r"] for r in pr.correlations(df, digits=None).collect()}
    monkeypatch.setattr(pr, "NARROW", 3)
    for block, fan in ((256, 16), (4, 2)):
        monkeypatch.setattr(pr, "GRAM_BLOCK", block)
        monkeypatch.setattr(pr, "GRAM_FAN", fan)
        got = pr.correlations(df, digits=None).collect()
        assert len(got) == 81 and {(r["col_a"], r["col_b"]) for r in got} == set(want)
        for r in got:
            w = want[r["col_a"], r["col_b"]]
            assert (r["r"] is None) == (w is None) and (w is None or math.isclose(r["r"], w, abs_tol=1e-9)), r
            assert df.columns[r["pos_a"]] == r["col_a"]
    assert pr.strongest_pair(df).first()["abs_r"] > 0.5


def test_a_thousand_columns(spark):
    df = spark.range(3000).select(*[((F.col("id") * (i + 1)) % (7 + i % 50)).cast("double").alias(f"x{i}")
                                    for i in range(1000)])
    m = pr.correlations(df, digits=None)
    assert m.count() == 1_000_000
    r = m.where("col_a = 'x3' AND col_b = 'x700'").first()["r"]
    assert math.isclose(r, df.select(F.corr("x3", "x700")).first()[0], abs_tol=1e-9)


def test_chunks_do_not_depend_on_the_splits(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5000).withColumn("k", F.col("id") * 3).coalesce(1).write.parquet(path)
    once = sorted(map(tuple, sp.per_chunk_sample(spark.read.parquet(path), ["id"], 5, 700).collect()))
    assert len(once) == 8 * 5 and {r[2] for r in once} == set(range(8))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert sorted(map(tuple, sp.per_chunk_sample(spark.read.parquet(path), ["id"], 5, 700).collect())) == once
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    made = spark.range(5000).withColumn("k", F.col("id") * 3)     # no file: chunks along the key
    assert sorted(map(tuple, sp.per_chunk_sample(made, ["id"], 5, 700).collect())) == once


def test_utf16_without_a_mark(spark, tmp_path):
    text = "a,b\n\u00e9,2\nxyz,3\n"
    for code in ("utf-16-le", "utf-16-be", "utf-16", "utf-8", "cp1252"):
        path = tmp_path / f"{code}.csv"
        path.write_bytes(text.encode(code))
        df = files.read_csv_robust(spark, str(path))
        assert df.columns == ["a", "b"] and [tuple(r) for r in df.collect()] == [("\u00e9", 2), ("xyz", 3)], code
