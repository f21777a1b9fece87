"""Top-k rows per group without funnelling a hot group through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    salt_buckets: int = 32, salt_on: Sequence[str] | None = None,
                    rank_col: str | None = None) -> DataFrame:
    """Keep the first ``k`` rows of every group under ``order``.

    Two phases: rows are first ranked inside (group, salt) buckets, so a group
    holding a third of the table is split over ``salt_buckets`` tasks; only
    ``k * salt_buckets`` survivors per group reach the final ranking.  The salt
    is a hash of ``salt_on`` (default: every column), so the result is
    deterministic.  ``order`` must be a total order (add a unique tie key).
    """
    salt_cols = [F.col(c) for c in (salt_on or df.columns)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_cols), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    out = stage1.drop("_r1", "_salt").withColumn("_rank", F.row_number().over(w2)).where(F.col("_rank") <= k)
    if rank_col:
        return out.withColumnRenamed("_rank", rank_col)
    return out.drop("_rank")
