"""Deterministic sampling, splits and folds P-01..P-07.

Row order for every draw is ``md5(cast(key as string))``: it is the same in
Spark and DuckDB, stable across runs and independent of partitioning.
Per-class ranks come from ``rank_within``, which avoids one task per class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import ROWS_PER_TASK, col
from tabulon.functions.ordering import first_by_hash, is_small, rank_within
from tabulon.functions.topk import top_k_per_group


def hash_order(keys: Sequence[str], seed: int | None = None) -> Column:
    """md5 of the key(s) as text (seeded variant prefixes the seed)."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    if seed is not None:
        text = F.concat(F.lit(f"{seed}|"), text)
    return F.md5(text)


def head_and_hash_sample(df: DataFrame, keys: Sequence[str], head: int = 50, n_random: int = 150,
                         cap: int = 200) -> DataFrame:
    """P-01: first ``head`` rows by key plus ``n_random`` rows in hash order,
    at most ``cap`` rows (both parts are distributed top-k, not full sorts)."""
    h = df.orderBy(*[col(k) for k in keys]).limit(head).withColumn("sample_part", F.lit("head"))
    r = df.withColumn("_h", hash_order(keys)).orderBy("_h").limit(n_random).drop("_h") \
        .withColumn("sample_part", F.lit("random"))
    both = h.unionByName(r).withColumn("_o", F.when(F.col("sample_part") == "head", 0).otherwise(1))
    return both.orderBy("_o", *[col(k) for k in keys]).limit(cap).drop("_o")


def per_chunk_sample(df: DataFrame, keys: Sequence[str], per_chunk: int = 40, chunk_rows: int = 200_000) -> DataFrame:
    """P-02: up to ``per_chunk`` rows (hash order) of every chunk of ``chunk_rows`` consecutive rows:
    the reservoir of each chunk of a chunked read.

    A Parquet scan's rows know their file and place, so chunks are the same however the scan is
    split; other tables are chunked along their keys.  Adds chunk_id (within the file, from 0).
    """
    try:
        chunked = df.select("*", F.col("_metadata.file_path").alias("_file"),
                            F.expr(f"_metadata.row_index div {chunk_rows}").alias("chunk_id"))
        chunked.schema   # resolves only over files
    except AnalysisException:
        by_key = df.withColumn("_one", F.lit(0)).withColumn("_key", F.struct(*[col(k) for k in keys]))
        chunked = rank_within(by_key, "_one", F.col("_key"), "_place") \
            .withColumn("chunk_id", F.expr(f"(_place - 1) div {chunk_rows}")).withColumn("_file", F.lit("")) \
            .drop("_one", "_key", "_place")
    hashed = chunked.withColumn("_h", hash_order(keys))
    # chunks are bounded; the rank's group limit keeps per_chunk rows of a task before the shuffle
    w = Window.partitionBy("_file", "chunk_id").orderBy("_h", *[col(k) for k in keys])
    return hashed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_chunk).drop("_r", "_h", "_file")


def per_class_sample(df: DataFrame, class_col: str, keys: Sequence[str], n: int = 200) -> DataFrame:
    """P-03: max(1, n // classes) rows of every class in hash order, then at
    most ``n`` rows overall (classes ascending, then rank)."""
    classes = df.where(col(class_col).isNotNull()).select(class_col).distinct().count()
    if classes == 0:
        return df.limit(0)
    k = max(1, n // classes)
    # only the first k rows of a class are wanted: a salted top-k, no rank of the whole table
    hashed = df.where(col(class_col).isNotNull()).withColumn("_h", hash_order(keys))
    picked = top_k_per_group(hashed, [class_col], [F.asc("_h")], k, salt_on=list(keys),
                             rank_col="class_rank").drop("_h")
    if classes * k > n:
        picked = picked.orderBy(col(class_col), "class_rank").limit(n)
    return picked


def class_counts(df: DataFrame, class_col: str) -> DataFrame:
    return df.groupBy(col(class_col).alias("_cls")).agg(F.count(F.lit(1)).alias("_cn"))


def drop_singleton_classes(df: DataFrame, class_col: str) -> DataFrame:
    """P-04: remove rows of classes with a single row; fail when fewer than
    two classes remain.  Class counts are aggregated, checked for size and
    semi-joined back (broadcast only under the bound)."""
    counts = class_counts(df, class_col).where(F.col("_cn") >= 2).checkpoint(eager=True)   # the rows are counted once
    if counts.limit(2).count() < 2:
        raise ValueError("every class in the target column needs at least 2 rows")
    keep = counts.select("_cls")
    if is_small(keep, 1_000_000):
        keep = F.broadcast(keep)
    return df.join(keep, col(class_col) == F.col("_cls"), "left_semi")


def stratified_split(df: DataFrame, class_col: str, keys: Sequence[str], test_fraction: float = 0.2,
                     hashed: str | None = None) -> DataFrame:
    """P-05: exact per-class split; the first round(test_fraction * n_c) rows of
    each class in hash order are ``test``, the rest ``train`` (column ``split``).

    ``hashed``: the column (it is dropped) that holds the keys' hash already; then the rows stay in their
    tasks and are compared with the class's last test row."""
    if hashed:
        return _split_in_place(df, class_col, hashed, test_fraction)
    counts = class_counts(df, class_col)
    if is_small(counts, 1_000_000):
        counts = F.broadcast(counts)
    ranked = rank_within(df, class_col, hash_order(keys), "_rank")
    joined = ranked.join(counts, col(class_col).eqNullSafe(F.col("_cls")))
    n_test = F.floor(F.col("_cn") * F.lit(test_fraction) + F.lit(0.5))
    return joined.withColumn("split", F.when(F.col("_rank") <= n_test, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("_rank", "_cls", "_cn")


def _split_in_place(df: DataFrame, class_col: str, hashed: str, test_fraction: float) -> DataFrame:
    last, tied = first_by_hash(df, class_col, col(hashed), F.floor(F.col("_cn") * F.lit(test_fraction) + F.lit(0.5)))
    if is_small(last, 1_000_000):
        last = F.broadcast(last)
    joined = df.join(last, col(class_col).eqNullSafe(F.col("_cls")), "left")

    def named(test):
        return F.when(test, F.lit("test")).otherwise(F.lit("train"))

    if not tied:
        return joined.withColumn("split", named(col(hashed) <= F.col("_last"))).drop(hashed, "_cls", "_last", "_room")
    # equal hashes: some of them are test rows, whichever
    at_last = F.coalesce(col(hashed) == F.col("_last"), F.lit(False))
    w = Window.partitionBy(col(class_col)).orderBy(col(hashed))
    some = joined.where(at_last).withColumn("_r", F.row_number().over(w)) \
        .withColumn("split", named(F.col("_r") <= F.col("_room"))).drop("_r").repartition(-(-tied // ROWS_PER_TASK))
    clear = joined.where(~at_last).withColumn("split", named(col(hashed) < F.col("_last")))
    return clear.unionByName(some).drop(hashed, "_cls", "_last", "_room")


def fold_count(df: DataFrame, class_col: str, max_folds: int = 5) -> int:
    smallest = class_counts(df, class_col).agg(F.min("_cn")).first()[0] or 0
    return max(2, min(max_folds, smallest))


def stratified_folds(df: DataFrame, class_col: str, keys: Sequence[str], k: int | None = None) -> DataFrame:
    """P-07: fold = (rank in class by hash - 1) mod k, with
    k = max(2, min(5, smallest class)) unless given (column ``fold``)."""
    k = k or fold_count(df, class_col)
    ranked = rank_within(df, class_col, hash_order(keys), "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def capped_sample(df: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """P-06: at most ``cap`` rows, the first in hash order (distributed top-k)."""
    return df.withColumn("_h", hash_order(keys)).orderBy("_h").limit(cap).drop("_h")
