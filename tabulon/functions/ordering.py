"""Order statistics over long-form (column_name, value) data, distributed.

``percentile``/``mode`` aggregates keep a value->count map per group and merge
it in one task, so their memory grows with the number of distinct values.
These helpers first reduce to distinct (column, value, count) with map-side
combining, check that size, and beyond ``in_memory_limit`` switch to a
range-partitioned running total: per-partition sums become a small offset
table (one row per partition and column), so no group is ever funnelled
through a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import col, small_table
from tabulon.functions.topk import top_k_per_group

IN_MEMORY_LIMIT = 2_000_000
OFFSET_ROWS = 1_000_000   # offsets that may be broadcast
MANY_VALUES = 3_000_000   # beyond, quantiles are bracketed first
BRACKET, BRACKET_ACCURACY = 0.0005, 10_000   # to each side of a probability; percentiles are off by 1 in the latter
HASH_DIGITS = 3           # leading hexadecimal digits by which hashes are counted


def long_values(df: DataFrame, columns: Sequence[str], as_type: str = "double") -> DataFrame:
    """Unpivot ``columns`` into (column_name, value) rows, nulls removed."""
    structs = [F.struct(F.lit(c).alias("column_name"), col(c).cast(as_type).alias("value")) for c in columns]
    out = df.select(F.explode_outer(F.array(*structs)).alias("_kv")).select("_kv.column_name", "_kv.value")
    cond = F.col("value").isNotNull()
    if as_type == "double":
        cond = cond & ~F.isnan("value")
    return out.where(cond)


def distinct_per_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_distinct) of the columns' non-null values: one unpivot and one
    (column, value) aggregate with map-side combining, instead of one ``countDistinct``
    per column, which would copy and shuffle every row once for each."""
    pairs = long_values(df, columns, as_type="string").distinct()
    return pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def value_counts_long(long_df: DataFrame) -> DataFrame:
    """(column_name, value, n): distinct values with their counts (partial aggregation)."""
    return long_df.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def running_total(counts: DataFrame, weight: str = "n", partitions: int | None = None) -> DataFrame:
    """Add ``cum_before``/``cum_after`` (running sum of ``weight`` within
    column_name ordered by value) to a (column_name, value, weight) table.

    Range partitioning sorts the table across tasks; the partition layout is
    pinned with a checkpoint, per-(partition, column) sums form the offset
    table, and each row adds its partition offset to a local running sum.
    """
    spark = counts.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (counts.repartitionByRange(n_parts, "column_name", "value")
              .withColumn("_pid", F.spark_partition_id()))
    ranged = ranged.checkpoint(eager=True)  # fixes partition ids across the two uses below
    sums = ranged.groupBy("_pid", "column_name").agg(F.sum(weight).alias("_s"))
    w_off = Window.partitionBy("column_name").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_s").over(w_off), F.lit(0)))
    w_loc = Window.partitionBy("_pid", "column_name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_loc", F.sum(weight).over(w_loc))
    # one offset per partition and column; null-safe, as a null class is a group of its own
    off = offsets.select(F.col("_pid").alias("_opid"), F.col("column_name").alias("_ocol"), "_off").checkpoint(eager=True)
    if is_small(off, OFFSET_ROWS):
        off = F.broadcast(off)
    same = (F.col("_pid") == F.col("_opid")) & F.col("column_name").eqNullSafe(F.col("_ocol"))
    return (local.join(off, same).drop("_opid", "_ocol")
            .withColumn("cum_after", F.col("_off") + F.col("_loc"))
            .withColumn("cum_before", F.col("cum_after") - F.col(weight))
            .drop("_pid", "_off", "_loc"))


def _small(counts: DataFrame, limit: int) -> bool:
    return counts.limit(limit + 1).count() <= limit


def _few_distinct(long_df: DataFrame, limit: int) -> bool:
    """Size check for the in-memory path: an HLL estimate of the distinct
    (column, value) pairs, computed in one map-side-combined pass with no
    shuffle of the values.  Choosing the path never changes the result."""
    est = long_df.agg(F.approx_count_distinct(F.struct("column_name", "value"))).first()[0] or 0
    return est * 1.25 <= limit  # rsd 5 %


def bracketed_quantiles(long_df: DataFrame, probs: Sequence[float]) -> DataFrame | None:
    """``exact_quantiles`` of many values without a map of them all: approximate percentiles a little under and
    over each wanted one bracket it, then one pass counts the values below a bracket and those inside by value.

    None when a wanted place lies outside its bracket (the approximation is not trusted)."""
    probs = [float(p) for p in probs]
    edges = [min(max(p + s * BRACKET, 0.0), 1.0) for p in probs for s in (-1, 1)]
    spark = long_df.sparkSession
    # one task merges the tasks' summaries: no more of them than cores
    near = long_df.coalesce(spark.sparkContext.defaultParallelism).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("value", edges, BRACKET_ACCURACY).alias("e")).collect()
    brackets = [(r["column_name"], p, r["e"][2 * i], r["e"][2 * i + 1], (r["n"] - 1) * p)
                for r in near for i, p in enumerate(probs)]   # one row per column and probability
    if not brackets:
        return None
    at = small_table(spark, brackets, "column_name string, prob double, _lo double, _hi double, _at double")
    inside = long_df.join(F.broadcast(at), "column_name").where(F.col("value") <= F.col("_hi")).groupBy(
        "column_name", "prob", "_at", F.when(F.col("value") >= F.col("_lo"), F.col("value")).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))   # null: all values below the bracket
    w = Window.partitionBy("column_name", "prob").orderBy(F.col("value").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = inside.withColumn("_after", F.sum("n").over(w)).withColumn("_before", F.col("_after") - F.col("n"))

    def found(place):
        return F.max(F.when((place >= F.col("_before")) & (place < F.col("_after")), F.col("value")))

    lower, higher = F.floor("_at"), F.ceil("_at")
    ends = placed.groupBy("column_name", "prob", "_at").agg(found(lower).alias("a"), found(higher).alias("b"))
    got = ends.select("column_name", "prob", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        (higher - F.col("_at")) * F.col("a") + (F.col("_at") - lower) * F.col("b")).alias("quantile")).collect()
    if len(got) < len(brackets) or any(r["quantile"] is None for r in got):
        return None
    return small_table(spark, got, "column_name string, prob double, quantile double")


def exact_quantiles(long_df: DataFrame, probs: Sequence[float],
                    in_memory_limit: int = IN_MEMORY_LIMIT) -> DataFrame:
    """Linear-interpolated quantiles (``quantile_cont``) per column_name.

    Output: column_name, prob, quantile.
    """
    got = bracketed_quantiles(long_df, probs) if long_df.count() > MANY_VALUES else None
    if got is not None:
        return got
    if _few_distinct(long_df, in_memory_limit):
        arr = F.array(*[F.lit(float(p)) for p in probs])
        q = long_df.groupBy("column_name").agg(F.percentile("value", arr).alias("_q"))
        return q.select("column_name", F.posexplode("_q").alias("_i", "quantile")).select(
            "column_name", F.element_at(arr, F.col("_i") + 1).alias("prob"), "quantile")
    counts = value_counts_long(long_df)
    cum = running_total(counts)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("_total"))
    targets = totals.select("column_name", "_total", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    targets = targets.withColumn("_h", F.col("prob") * (F.col("_total") - 1)) \
        .withColumn("_lo", F.floor("_h")).withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_total") - 1))
    pos = targets.select("column_name", "prob", "_h", "_lo", F.explode(F.array("_lo", "_hi")).alias("_k"))
    # each wanted position falls in exactly one (column, value) interval [cum_before, cum_after)
    hit = cum.join(F.broadcast(pos), "column_name").where(
        (F.col("_k") >= F.col("cum_before")) & (F.col("_k") < F.col("cum_after")))
    g = hit.groupBy("column_name", "prob", "_h", "_lo").agg(
        F.min_by("value", "_k").alias("_vlo"), F.max_by("value", "_k").alias("_vhi"))
    return g.select("column_name", "prob",
                    (F.col("_vlo") + (F.col("_h") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo"))).alias("quantile"))


def modes(long_df: DataFrame) -> DataFrame:
    """Most frequent value per column_name, smallest value on ties.

    Output: column_name, value, n.  Counts are combined map-side; the winner
    per column is found with the salted two-phase top-k.
    """
    counts = value_counts_long(long_df)
    return top_k_per_group(counts, ["column_name"], [F.desc("n"), F.asc("value")], 1,
                           salt_on=["value"])


def dense_codes(long_df: DataFrame, in_memory_limit: int = IN_MEMORY_LIMIT, small: bool | None = None) -> DataFrame:
    """0-based code of every distinct value per column_name in sorted order
    (``small``: the caller's size decision, else an HLL check here).

    Output: column_name, value, code.
    """
    distinct = long_df.groupBy("column_name", "value").agg(F.lit(1).alias("n"))
    if small if small is not None else _few_distinct(long_df, in_memory_limit):
        w = Window.partitionBy("column_name").orderBy("value")
        return distinct.select("column_name", "value", (F.row_number().over(w) - 1).alias("code"))
    cum = running_total(distinct)
    return cum.select("column_name", "value", F.col("cum_before").cast("int").alias("code"))


def is_small(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows (reads at most limit+1 rows)."""
    return _small(df, limit)


def rank_within(df: DataFrame, group: str, order: Column, rank_col: str = "rank",
                window_limit: int = IN_MEMORY_LIMIT) -> DataFrame:
    """1-based position (a long) of every row inside its ``group`` under ``order``
    (``order`` must be unique within a group, e.g. a hash of the row key).

    When the largest group is under ``window_limit`` rows a plain window is
    used; otherwise the rank comes from the range-partitioned running total,
    so a group holding a third of the table is still spread over many tasks.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_gn"))
    biggest = sizes.agg(F.max("_gn")).first()[0] or 0
    if biggest <= window_limit:
        w = Window.partitionBy(group).orderBy(order)
        return df.withColumn(rank_col, F.row_number().over(w).cast("long"))
    keyed = df.withColumn("column_name", F.col(group).cast("string")).withColumn("value", order) \
        .withColumn("n", F.lit(1))
    ranked = running_total(keyed)
    return ranked.withColumn(rank_col, F.col("cum_after").cast("long")).drop(
        "column_name", "value", "n", "cum_before", "cum_after")


def first_by_hash(df: DataFrame, group: str, order: Column, wanted) -> tuple[DataFrame, int]:
    """Per group the hash that the last of its first rows in hash order has, without ranking the table.

    ``order`` is a hash as hexadecimal text, ``wanted`` a Column of the group's size ``_cn``: how many rows are
    first.  Rows are counted by the hash's first digits; only those that share the digits of the last one wanted
    are ranked.  -> ((_cls, _last, _room): rows under ``_last`` are first, and ``_room`` of those that have it;
    null: none; and the rows that share it with rows beyond, 0 as a rule)."""
    hashed = df.select(col(group).alias("_cls"), order.alias("_h"))
    digits = F.substring("_h", 1, HASH_DIGITS)
    counted = hashed.groupBy("_cls", digits.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("_cls").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_after", F.sum("_n").over(run)) \
        .withColumn("_cn", F.sum("_n").over(Window.partitionBy("_cls"))).withColumn("_want", wanted.cast("long"))
    edge = placed.where((F.col("_want") > F.col("_after") - F.col("_n")) & (F.col("_want") <= F.col("_after"))).select(
        F.col("_cls").alias("_ecls"), F.col("_d"), (F.col("_want") - F.col("_after") + F.col("_n")).alias("_left")) \
        .checkpoint(eager=True)
    if is_small(edge, OFFSET_ROWS):
        edge = F.broadcast(edge)
    at_edge = hashed.join(edge, F.col("_cls").eqNullSafe(F.col("_ecls")) & (digits == F.col("_d")))
    same = at_edge.groupBy("_cls", "_left", "_h").agg(F.count(F.lit(1)).alias("_n"))
    ranked = same.withColumn("_upto", F.sum("_n").over(
        Window.partitionBy("_cls").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = ranked.where((F.col("_left") > F.col("_upto") - F.col("_n")) & (F.col("_left") <= F.col("_upto"))).select(
        "_cls", F.col("_h").alias("_last"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_room"), "_n")
    last = last.checkpoint(eager=True)
    shared = last.agg(F.sum(F.when(F.col("_room") < F.col("_n"), F.col("_n")))).first()[0]
    return last.drop("_n"), shared or 0
