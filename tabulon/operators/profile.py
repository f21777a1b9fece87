"""Profiling operators A-01..A-20.

Per-column statistics are fused into a single ``agg`` (one scan, partial
aggregation on the map side) and then turned into long form
``(column_name, metric...)`` with ``inline(array(struct(...)))``; nothing is
collected except one-row aggregate results used as literals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import col, dtype_name, is_numeric, numeric_columns
from tabulon.functions.ordering import distinct_per_column, exact_quantiles, long_values
from tabulon.functions.topk import top_k_per_group


NARROW = 24        # columns whose correlations are one aggregate
GRAM_BLOCK = 256   # columns multiplied with as many others
GRAM_FAN = 16      # partial sums added at a time


def per_column(df: DataFrame, columns: Sequence[str], metrics: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One aggregate computing every metric for every column -> long form.

    Output columns: column_name, position, then one column per metric.
    """
    aggs = []
    for i, c in enumerate(columns):
        for m, fn in metrics.items():
            aggs.append(fn(col(c)).alias(f"c{i}__{m}"))
    if not aggs:
        schema = "column_name string, position int, " + ", ".join(f"{m} double" for m in metrics)
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(*aggs)
    structs = [
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                 *[F.col(f"c{i}__{m}").alias(m) for m in metrics])
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*structs)))


def _num(c: Column) -> Column:
    return c.cast("double")


def _categorical(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


# --- A-01 / A-18 -------------------------------------------------------------

def overview(df: DataFrame, target: str | None = None) -> DataFrame:
    """A-01: rows, columns and the numeric / categorical split (one row)."""
    nums = numeric_columns(df)
    cats = _categorical(df)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_cols"),
        F.lit(len(nums)).alias("n_numeric"),
        F.lit(len(cats)).alias("n_categorical"),
        F.lit(",".join(nums)).alias("numeric_columns"),
        F.lit(",".join(cats)).alias("categorical_columns"),
        F.lit(target).cast("string").alias("target"),
    )


# --- A-02 / A-03 / A-17 ------------------------------------------------------

def missing_counts(df: DataFrame) -> DataFrame:
    """A-17: exact null count of every column (also NaN for floating columns)."""
    def nulls(c: Column, dtype: T.DataType) -> Column:
        cond = c.isNull()
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            cond = cond | F.isnan(c)
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")] + [nulls(col(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(fields)]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"),
                        F.col(f"c{i}").alias("n_missing"), F.col("_n").alias("n_rows"))
               for i, f in enumerate(fields)]
    return wide.select(F.inline(F.array(*structs)))


def missing_scaled(df: DataFrame, keys: Sequence[str], sample_rows: int = 200) -> DataFrame:
    """A-17 option: missing counts estimated from a capped hash sample and
    scaled to the table size (round half to even), columns with misses only."""
    from tabulon.operators.sample import capped_sample
    n = df.count()
    sample = capped_sample(df, keys, sample_rows)
    m = missing_counts(sample).where(F.col("n_missing") > 0)
    scale = F.lit(float(n)) / F.greatest(F.col("n_rows"), F.lit(1))
    return m.select("column_name", F.bround(F.col("n_missing") * scale, 0).cast("long").alias("n_missing_estimate"))


def missing(df: DataFrame, top: int | None = 8, with_percent: bool = False) -> DataFrame:
    """A-02 (top 8, counts) / A-03 (top 10 with percent): columns with nulls, most first."""
    m = missing_counts(df).where(F.col("n_missing") > 0)
    cols = ["column_name", "n_missing"]
    if with_percent:
        m = m.withColumn("pct_missing", F.round(F.col("n_missing") / F.col("n_rows") * 100, 2))
        cols.append("pct_missing")
    m = m.orderBy(F.desc("n_missing"), "position")
    if top:
        m = m.limit(top)
    return m.select(*cols)


# --- A-04 / A-05 / A-06 ------------------------------------------------------

def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """A-04: mean, sample std, min, max per numeric column, rounded half-even."""
    cols = list(columns or numeric_columns(df))
    out = per_column(df, cols, {
        "mean": lambda c: F.avg(_num(c)),
        "std": lambda c: F.stddev_samp(_num(c)),
        "min": lambda c: F.min(_num(c)),
        "max": lambda c: F.max(_num(c)),
    })
    return out.select("column_name", *[F.bround(m, digits).alias(m) for m in ("mean", "std", "min", "max")])


def _quantiles(c: Column, probs: Sequence[float], exact: bool, accuracy: int) -> Column:
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if exact:
        return F.percentile(_num(c), arr)
    return F.percentile_approx(_num(c), arr, accuracy)


def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True,
             accuracy: int = 100000) -> DataFrame:
    """A-05: count mean std min 25% 50% 75% max per numeric column.

    ``exact`` quantiles use linear interpolation (pandas/DuckDB ``quantile_cont``)
    and hold a value->count map per column; ``exact=False`` switches to the
    bounded-memory sketch for columns with very many distinct values.
    """
    cols = list(columns or numeric_columns(df))
    metrics = {
        "count": lambda c: F.count(c),
        "mean": lambda c: F.avg(_num(c)),
        "std": lambda c: F.stddev_samp(_num(c)),
        "min": lambda c: F.min(_num(c)),
        "max": lambda c: F.max(_num(c)),
    }
    if not exact:
        metrics["q"] = lambda c: _quantiles(c, (0.25, 0.5, 0.75), False, accuracy)
        out = per_column(df, cols, metrics)
        return out.select("column_name", "count", "mean", "std", "min", F.col("q")[0].alias("p25"),
                          F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")
    out = per_column(df, cols, metrics)
    q = exact_quantiles(long_values(df, cols), [0.25, 0.5, 0.75]).groupBy("column_name").pivot(
        "prob", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
    q = q.toDF("column_name", "p25", "p50", "p75")
    return out.join(q, "column_name", "left").select("column_name", "count", "mean", "std", "min",
                                                     "p25", "p50", "p75", "max")


def column_read(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """A-06: mean, median, min, max of one column (one row)."""
    c = _num(col(column))
    if exact:
        q = exact_quantiles(long_values(df, [column]), [0.5]).first()
        med = F.lit(q["quantile"] if q else None).cast("double")
    else:
        med = F.percentile_approx(c, F.lit(0.5), 100000)
    return df.agg(F.lit(column).alias("column_name"), F.avg(c).alias("mean"), med.alias("median"),
                  F.min(c).alias("min"), F.max(c).alias("max"))


# --- A-07 / A-08 / A-09 ------------------------------------------------------

def value_counts(df: DataFrame, column: str, top: int | None = 5, digits: int = 1,
                 as_string: bool = False) -> DataFrame:
    """A-07: most frequent values with their share of *all* rows (nulls excluded
    from the values, included in the denominator).  Ties: value ascending."""
    v = col(column).cast("string") if as_string else col(column)
    counts = df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("value").isNotNull())
    total = df.count()  # one scalar
    ranked = counts.orderBy(F.desc("n"), F.asc("value"))
    if top:
        ranked = ranked.limit(top)
    return ranked.select("value", "n", F.round(F.col("n") / F.lit(max(total, 1)) * 100, digits).alias("pct"))


def class_balance(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """A-08: count and percent of every class (percent of non-null rows)."""
    base = df.where(col(column).isNotNull())
    total = base.count()  # one scalar
    counts = base.groupBy(col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") / F.lit(max(total, 1)) * 100, digits))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """A-09: distinct values per column, without and with null counted as a value."""
    cols = list(columns or df.columns)
    nulls = {"has_null": lambda c: F.max(F.when(c.isNull(), 1).otherwise(0))}
    if approx:
        out = per_column(df, cols, {"n_distinct": F.approx_count_distinct, **nulls})
    else:
        out = per_column(df, cols, nulls).join(distinct_per_column(df, cols), "column_name", "left") \
            .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    return out.select("column_name", F.col("n_distinct").cast("long").alias("n_distinct"),
                      (F.col("n_distinct") + F.col("has_null")).cast("long").alias("n_distinct_with_null"))


# --- A-10 / A-11 -------------------------------------------------------------

def correlations(df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = 2) -> DataFrame:
    """A-10: Pearson matrix in long form (col_a, col_b, r, pos_a, pos_b), pairwise-complete rows.

    Up to ``NARROW`` columns, all n(n-1)/2 coefficients come from one aggregate; beyond, from
    blocked Gram matrices (see ``_gram_correlations``).  The diagonal is 1; a pair without two
    common rows, or constant on them, has no coefficient.
    """
    cols = list(columns or numeric_columns(df))
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double, pos_a int, pos_b int")
    if len(cols) > NARROW:
        pairs = _gram_correlations(df, cols)
        names = F.array(*[F.lit(c) for c in cols])
        r = F.round("r", digits) if digits is not None else F.col("r")
        return pairs.select(F.element_at(names, F.col("i") + 1).alias("col_a"),
                            F.element_at(names, F.col("j") + 1).alias("col_b"),
                            F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(r).alias("r"),
                            F.col("i").alias("pos_a"), F.col("j").alias("pos_b"))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    # corr() divides by zero on a constant column under ANSI rules; r2 has no coefficient there, or 1 without covariance
    wide = df.agg(*[f(_num(col(cols[i])), _num(col(cols[j]))).alias(f"{name}{i}_{j}") for i, j in pairs
                    for name, f in (("p", F.regr_r2), ("c", F.covar_pop))])
    structs = []
    for i, j in pairs:
        r2, c = F.col(f"p{i}_{j}"), F.col(f"c{i}_{j}")
        r = F.when((c != 0) | (r2 != 1), F.signum(c) * F.sqrt(r2))
        r = F.round(r, digits) if digits is not None else r
        for x, y in ((i, j), (j, i)):
            structs.append(F.struct(F.lit(cols[x]).alias("col_a"), F.lit(cols[y]).alias("col_b"), r.alias("r"),
                                    F.lit(x).alias("pos_a"), F.lit(y).alias("pos_b")))
    for i, c in enumerate(cols):
        structs.append(F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.lit(1.0).alias("r"),
                                F.lit(i).alias("pos_a"), F.lit(i).alias("pos_b")))
    return wide.select(F.inline(F.array(*structs)))


def _gram_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, r) of all ordered pairs of columns, from sums over the rows where both are there.

    A task multiplies its rows block by block: values and presence masks of ``GRAM_BLOCK``
    columns against those of ``GRAM_BLOCK`` others give the six sums of every pair of the two
    blocks.  The tasks' sums are added as a tree of ``GRAM_FAN`` at a time, one group per pair
    of blocks, so what meets in a task is bounded by GRAM_FAN blocks whatever the rows and columns.
    """
    n = len(cols)
    # centred at the means, the sums lose no digits to large values
    centre = df.agg(*[F.avg(F.when(~F.isnan(_num(col(c))), _num(col(c)))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    mean = np.array([0.0 if m is None or not np.isfinite(m) else m for m in centre])
    blocks = [(a, b) for a in range(0, n, GRAM_BLOCK) for b in range(a, n, GRAM_BLOCK)]
    data = df.select(*[_num(col(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    schema = "a int, b int, lane int, sums binary"

    def row(a, b, lane, sums):
        return pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()),
                                           pa.array([lane], pa.int32()), pa.array([sums.tobytes()], pa.binary())],
                                          names=["a", "b", "lane", "sums"])

    def run(batches):
        lane = TaskContext.get().partitionId() // GRAM_FAN
        held = {}
        for batch in batches:
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            x = np.stack([c.fill_null(0).to_numpy() for c in batch.columns], axis=1) - mean
            x = np.where(there, x, 0.0)
            mask, square = there.astype(np.float64), x * x
            for a, b in blocks:
                p, q = slice(a, a + GRAM_BLOCK), slice(b, b + GRAM_BLOCK)
                sums = np.stack([mask[:, p].T @ mask[:, q], x[:, p].T @ mask[:, q], mask[:, p].T @ x[:, q],
                                 square[:, p].T @ mask[:, q], mask[:, p].T @ square[:, q], x[:, p].T @ x[:, q]])
                held[a, b] = held[a, b] + sums if (a, b) in held else sums
        for (a, b), sums in held.items():
            yield row(a, b, lane, sums)

    def add(key, table):
        total = sum(np.frombuffer(v, dtype=np.float64) for v in table.column("sums").to_pylist())
        return pa.Table.from_batches([row(key[0].as_py(), key[1].as_py(), key[2].as_py() // GRAM_FAN, total)])

    def finish(batches):
        for batch in batches:
            for r in batch.to_pylist():
                na, nb = min(GRAM_BLOCK, n - r["a"]), min(GRAM_BLOCK, n - r["b"])
                k, sx, sy, sxx, syy, sxy = np.frombuffer(r["sums"], dtype=np.float64).reshape(6, na, nb)
                safe = np.maximum(k, 1)
                vx, vy = sxx - sx * sx / safe, syy - sy * sy / safe
                usable = (k > 1) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy)
                root = np.sqrt(np.where(usable, vx, 1.0)) * np.sqrt(np.where(usable, vy, 1.0))
                c = np.clip((sxy - sx * sy / safe) / root, -1.0, 1.0)
                i, j = (v.ravel() for v in np.indices((na, nb)))
                i, j = i + r["a"], j + r["b"]
                found = pa.array(c.ravel(), mask=~usable.ravel())
                one = pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), found],
                                                 names=["i", "j", "r"])
                yield one
                if r["a"] != r["b"]:   # the block across the diagonal
                    yield pa.RecordBatch.from_arrays([one.column(1), one.column(0), found], names=["i", "j", "r"])

    lanes = -(-data.rdd.getNumPartitions() // GRAM_FAN)
    parts = data.mapInArrow(run, schema).groupBy("a", "b", "lane").applyInArrow(add, schema)
    while lanes > 1:
        parts = parts.groupBy("a", "b", "lane").applyInArrow(add, schema)
        lanes = -(-lanes // GRAM_FAN)
    return parts.mapInArrow(finish, "i int, j int, r double")


def strongest_pair(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A-11: off-diagonal pair with the largest |r| (first in column order on ties)."""
    m = correlations(df, columns, digits=None).where(F.col("pos_a") < F.col("pos_b"))
    best = m.orderBy(F.desc(F.abs("r")), "pos_a", "pos_b").limit(1)
    return best.select("col_a", "col_b", "r", F.abs("r").alias("abs_r"))


# --- A-12 / A-13 -------------------------------------------------------------

def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """A-12: rows strictly outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] per column.

    Pass 1 aggregates the quartiles of every column (one row, used as
    literals); pass 2 counts outliers of every column in one aggregate.
    """
    cols = list(columns or [c for c in numeric_columns(df)
                            if not isinstance(df.schema[c].dataType, T.BooleanType)])
    if exact:
        rows = exact_quantiles(long_values(df, cols), [0.25, 0.75]).collect()  # 2 rows per column
        qd = {(r["column_name"], r["prob"]): r["quantile"] for r in rows}
        quart = {c: (qd.get((c, 0.25)), qd.get((c, 0.75))) for c in cols}
    else:
        q = df.agg(*[_quantiles(col(c), (0.25, 0.75), False, 100000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
        quart = {c: tuple(q[f"q{i}"]) if q[f"q{i}"] is not None else (None, None) for i, c in enumerate(cols)}
    aggs, structs = [], []
    for i, c in enumerate(cols):
        q1, q3 = quart[c]
        if q1 is None:
            aggs.append(F.lit(0).cast("long").alias(f"n{i}"))
            lo = hi = None
        else:
            iqr = q3 - q1
            lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
            x = _num(col(c))
            aggs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"n{i}"))
        structs.append(F.struct(F.lit(c).alias("column_name"), F.lit(q1).cast("double").alias("q1"),
                                F.lit(q3).cast("double").alias("q3"), F.lit(lo).cast("double").alias("lower"),
                                F.lit(hi).cast("double").alias("upper"), F.col(f"n{i}").alias("n_outliers")))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """A-13: equal-width histogram over [min, max] (last bin closed), empty bins kept.

    Output: bin (0-based), lower, upper, n.
    """
    x = _num(col(column))
    clean = df.select(x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    lo, hi = clean.agg(F.min("_x"), F.max("_x")).first()  # one-row aggregate
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, n long")
    width = (hi - lo) / bins
    idx = (F.lit(0) if hi == lo else
           F.least(F.floor((F.col("_x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))).cast("int")
    counts = clean.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.lit(width) * F.col("bin")).alias("lower"),
                    (F.lit(lo) + F.lit(width) * (F.col("bin") + 1)).alias("upper"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


# --- A-14 / A-15 -------------------------------------------------------------

def crosstab(df: DataFrame, row: str, column: str, normalize: bool = False, digits: int = 2) -> DataFrame:
    """A-15 (counts) / A-14 (share within each row value) in long form.

    Only observed (row, column) pairs are emitted; absent pairs are zero.
    Rows with a null in either key drop out, as in a pandas cross-tab.
    """
    base = df.where(col(row).isNotNull() & col(column).isNotNull())
    counts = base.groupBy(col(row).alias("row_value"), col(column).alias("col_value")).agg(
        F.count(F.lit(1)).alias("n"))
    if not normalize:
        return counts
    w = Window.partitionBy("row_value")
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), digits))


# --- A-16 / A-20 -------------------------------------------------------------

def _first_rows(rows: pa.Table, order_by: Sequence[str], k: int, columns: Sequence[str]) -> list[int]:
    """Indices of the rows that hold the first ``k`` non-null values of any column."""
    keys, order = {}, []
    for j, name in enumerate(order_by):
        key = rows.column(name)
        # null keys come first, as in an ascending sort of Spark
        keys[f"there{j}"] = pc.cast(key.is_valid(), pa.int8())
        keys[f"key{j}"] = pc.cast(key, pa.int8()) if pa.types.is_boolean(key.type) else key
        order += [(f"there{j}", "ascending"), (f"key{j}", "ascending")]
    keyed = pa.table({**keys, "at": pa.array(np.arange(rows.num_rows))})
    found = set()
    for c in columns:
        there = keyed.filter(rows.column(c).is_valid())
        if there.num_rows > k:
            there = there.take(pc.select_k_unstable(there, k, sort_keys=order))
        found.update(there.column("at").to_pylist())
    return sorted(found)


def first_values(df: DataFrame, order_by: Sequence[str], k: int = 3,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """First ``k`` non-null values of each column under ``order_by``, a total order (long form:
    column_name, rank, value as text).

    One pass: a task holds at most ``k`` rows per column and hands on those alone, so
    only they are unpivoted; a salted top-k takes the first of all tasks.
    """
    cols = list(columns or df.columns)
    # plain names: a map over Arrow batches takes no dots in them
    keys, held = [f"o{j}" for j in range(len(order_by))], [f"c{i}" for i in range(len(cols))]
    rows = df.select(*[col(o).alias(a) for o, a in zip(order_by, keys, strict=True)],
                     *[col(c).alias(a) for c, a in zip(cols, held, strict=True)])

    def run(batches):
        kept = None
        for batch in batches:
            seen = pa.Table.from_batches([batch])
            if kept is not None:
                seen = pa.concat_tables([kept, seen])
            kept = seen.take(pa.array(_first_rows(seen, keys, k, held), pa.int64()))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    long = rows.mapInArrow(run, rows.schema).select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(a).cast("string").alias("value"))
        for c, a in zip(cols, held, strict=True)])).alias("_kv")) \
        .select(*keys, "_kv.column_name", "_kv.value").where(F.col("value").isNotNull())
    return top_k_per_group(long, ["column_name"], [F.col(o).asc() for o in keys], k,
                           salt_on=keys, rank_col="rank").drop(*keys)


def column_metadata(df: DataFrame, order_by: Sequence[str], examples: int = 3) -> DataFrame:
    """A-16: dtype, null share (3 dp), distinct non-null count and the first
    ``examples`` non-null values (joined by ' | ') per column, on the full table."""
    cols = df.columns
    stats = per_column(df, cols, {
        "n": lambda c: F.count(F.lit(1)),
        "nulls": lambda c: F.sum(F.when(c.isNull(), 1).otherwise(0)),
    }).join(distinct_per_column(df, cols).withColumnRenamed("n_distinct", "nunique"), "column_name", "left") \
        .withColumn("nunique", F.coalesce("nunique", F.lit(0)))
    ex = first_values(df, order_by, examples, cols).groupBy("column_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]),
                     " | ").alias("examples"))  # at most `examples` items per column
    types = df.sparkSession.createDataFrame(
        [(f.name, dtype_name(f.dataType)) for f in df.schema.fields], "column_name string, dtype string")
    return (stats.join(types, "column_name").join(ex, "column_name", "left")
            .select("column_name", "dtype", F.bround(F.col("nulls") / F.col("n"), 3).alias("nulls_pct"),
                    F.col("nunique").cast("long").alias("nunique"), "examples"))


def column_summary(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """A-20: dtype, distinct count and first value (under ``order_by``) per column."""
    cols = df.columns
    stats = per_column(df, cols, {"n": lambda c: F.count(c)}).join(
        distinct_per_column(df, cols).withColumnRenamed("n_distinct", "nunique"), "column_name", "left") \
        .withColumn("nunique", F.coalesce("nunique", F.lit(0)))
    first = first_values(df, order_by, 1, cols).select("column_name", F.col("value").alias("first_value"))
    types = df.sparkSession.createDataFrame(
        [(f.name, dtype_name(f.dataType)) for f in df.schema.fields], "column_name string, dtype string")
    return (stats.join(types, "column_name").join(first, "column_name", "left")
            .select("column_name", "dtype", F.col("nunique").cast("long").alias("nunique"), "first_value"))


# --- A-18 / A-19 -------------------------------------------------------------

def schema_report(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """A-18: column lists, target, row/column counts, missing counts and the
    rule actions that produced the table, as (item, value) rows."""
    rules = rules or {}
    nums = numeric_columns(df)
    cats = [c for c in df.columns if c not in nums]
    miss = missing_counts(df).where(F.col("n_missing") > 0).select(
        F.concat(F.lit("missing."), "column_name").alias("item"), F.col("n_missing").cast("string").alias("value"))
    head = df.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(
        F.struct(F.lit("n_rows").alias("item"), F.col("n").cast("string").alias("value")),
        F.struct(F.lit("n_cols").alias("item"), F.lit(str(len(df.columns))).alias("value")),
        F.struct(F.lit("columns").alias("item"), F.lit(",".join(df.columns)).alias("value")),
        F.struct(F.lit("numeric").alias("item"), F.lit(",".join(nums)).alias("value")),
        F.struct(F.lit("categorical").alias("item"), F.lit(",".join(cats)).alias("value")),
        F.struct(F.lit("target").alias("item"), F.lit(rules.get("target")).cast("string").alias("value")),
        F.struct(F.lit("flagged.dropped").alias("item"), F.lit(",".join(rules.get("drop", []))).alias("value")),
        F.struct(F.lit("flagged.renamed").alias("item"),
                 F.lit(",".join(f"{k}->{v}" for k, v in rules.get("rename", {}).items())).alias("value")),
        F.struct(F.lit("flagged.cast").alias("item"),
                 F.lit(",".join(f"{k}:{v}" for k, v in rules.get("cast", {}).items())).alias("value")),
        F.struct(F.lit("flagged.imputed").alias("item"),
                 F.lit(",".join(f"{k}:{v}" for k, v in rules.get("impute", {}).items())).alias("value")),
    )))
    return head.unionByName(miss)


def dataset_context(df: DataFrame, order_by: Sequence[str], target: str | None = None,
                    max_cols: int = 25, top_values: int = 5, value_chars: int = 40,
                    cell_chars: int = 30, max_target_classes: int = 10) -> DataFrame:
    """A-19: bounded description of a table as rows (section, column_name, key, value).

    numeric: min/max/avg (2 dp) and distinct count for the first ``max_cols``
    columns; text: top values with count and percent; target: up to 10
    classes; sample: the first clamp(600 / n_cols, 5, 20) rows under
    ``order_by`` with every cell cut to ``cell_chars`` characters.
    """
    cols = df.columns[:max_cols]
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    texts = [c for c in cols if c not in nums]
    parts = []
    if nums:
        st = per_column(df, nums, {
            "min": lambda c: F.min(_num(c)), "max": lambda c: F.max(_num(c)),
            "avg": lambda c: F.avg(_num(c)),
        }).join(distinct_per_column(df, nums).withColumnRenamed("n_distinct", "uniq"), "column_name", "left") \
            .withColumn("uniq", F.coalesce("uniq", F.lit(0)))
        parts.append(st.select(F.lit("numeric").alias("section"), "column_name", F.inline(F.array(
            F.struct(F.lit("min").alias("key"), F.format_number("min", 2).alias("value")),
            F.struct(F.lit("max").alias("key"), F.format_number("max", 2).alias("value")),
            F.struct(F.lit("avg").alias("key"), F.format_number("avg", 2).alias("value")),
            F.struct(F.lit("unique").alias("key"), F.col("uniq").cast("string").alias("value")),
        ))))
    total = max(df.count(), 1)  # one scalar
    # one pass for every text column and the target: unpivot, count, top-k per column
    wanted = [(c, "text", top_values) for c in texts]
    if target and target in df.columns:
        wanted.append((target, "target", max_target_classes))
    if wanted:
        long = df.select(F.explode_outer(F.array(*[
            F.struct(F.lit(f"{sec}|{c}").alias("_key"), col(c).cast("string").alias("v")) for c, sec, _ in wanted
        ])).alias("_kv")).select("_kv._key", "_kv.v").where(F.col("v").isNotNull())
        counts = long.groupBy("_key", "v").agg(F.count(F.lit(1)).alias("n"))
        limits = F.create_map(*[x for c, sec, k in wanted for x in (F.lit(f"{sec}|{c}"), F.lit(k))])
        top = top_k_per_group(counts, ["_key"], [F.desc("n"), F.asc("v")], max(k for _, _, k in wanted),
                              salt_on=["v"], rank_col="_r").where(F.col("_r") <= F.element_at(limits, F.col("_key")))
        v = F.when(F.length("v") > value_chars, F.concat(F.substring("v", 1, value_chars), F.lit("…"))).otherwise(F.col("v"))
        parts.append(top.select(
            F.split_part(F.col("_key"), F.lit("|"), F.lit(1)).alias("section"),
            F.expr("substring(_key, instr(_key, '|') + 1)").alias("column_name"), v.alias("key"),
            F.concat(F.col("n").cast("string"), F.lit(" ("),
                     F.round(F.col("n") / F.lit(total) * 100, 1).cast("string"), F.lit("%)")).alias("value")))
    n_sample = max(5, min(20, 600 // max(len(df.columns), 1)))
    w = Window.orderBy(*order_by)
    sample = df.orderBy(*order_by).limit(n_sample).withColumn("_row", F.row_number().over(w))
    parts.append(sample.select(F.lit("sample").alias("section"), F.explode_outer(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col("_row").cast("string").alias("key"),
                 F.substring(F.coalesce(col(c).cast("string"), F.lit("nan")), 1, cell_chars).alias("value"))
        for c in df.columns])).alias("_s")).select("section", "_s.column_name", "_s.key", "_s.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
