"""Target detection and binning T-01..T-09."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import col, is_numeric, is_string
from tabulon.functions.ordering import dense_codes, exact_quantiles, is_small, long_values
from tabulon.operators.clean import tier_expr

# Target names recognised by detect_target (case-insensitive), in order.
TARGET_NAMES = ["sales_category", "target", "label", "class", "outcome", "status", "category"]
# Numeric columns that give a derived ``<name>_tier`` target, in order.
TIER_BASE_NAMES = ["net_sales", "sales", "revenue", "amount", "profit", "total"]
# Names tried first when guessing a stratification column (T-07).
STRATIFY_NAMES = ["sales_category", "target", "label", "class", "outcome", "status", "category", "churn", "result"]


def few_distinct(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int]:
    """Distinct non-null values per column, exact up to ``limit`` and ``limit + 1`` for more.

    A task keeps at most ``limit + 1`` values of a column and stops looking at it there, so
    neither cells nor values travel: what is shuffled is bounded by tasks x columns x limit."""
    columns = list(columns)
    if not columns:
        return {}

    def text(c):   # one zero, whichever its sign
        kind = df.schema[c].dataType.typeName()
        return (col(c) + F.lit(0.0) if kind in ("double", "float") else col(c)).cast("string")

    def run(batches):
        seen = [set() for _ in columns]
        for batch in batches:
            for values, cells in zip(seen, batch.columns, strict=True):
                if len(values) <= limit:
                    values.update(v for v in pc.unique(cells).to_pylist() if v is not None)
        at = [(i, v) for i, values in enumerate(seen) for v in sorted(values)[:limit + 1]]
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()),
                                              pa.array([v for _, v in at], pa.string())], names=["i", "v"])

    found = df.select(*[text(c).alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(run, "i int, v string") \
        .distinct().groupBy("i").count()
    counts = {r["i"]: r["count"] for r in found.collect()}
    return {c: min(counts.get(i, 0), limit + 1) for i, c in enumerate(columns)}


def detect_target(df: DataFrame, requested: str | None = None) -> DataFrame:
    """T-01: pick the target column -> one row (target, reason).

    requested name -> known target name -> numeric sales-like column (as
    ``<name>_tier``) -> first numeric column (as ``<name>_tier``) -> first
    column with few distinct values -> ``analyst_cluster``.
    """
    spark = df.sparkSession

    def one(name, reason):
        return spark.createDataFrame([(name, reason)], "target string, reason string")

    if requested and requested in df.columns:
        return one(requested, "requested")
    lower = {}
    for c in df.columns:
        lower.setdefault(c.lower(), c)
    for cand in TARGET_NAMES:
        if cand in lower:
            return one(lower[cand], "known_name")
    for cand in TIER_BASE_NAMES:
        if cand in lower and is_numeric(df.schema[lower[cand]].dataType):
            return one(f"{lower[cand]}_tier", "sales_like_numeric")
    nums = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if nums:
        return one(f"{nums[0]}_tier", "first_numeric")
    limit = min(20, max(2, df.count() // 3))
    known = few_distinct(df, df.columns, limit)
    for c in df.columns:
        if known[c] <= limit:
            return one(c, "low_cardinality")
    return one("analyst_cluster", "fallback")


def _median(df: DataFrame, c: Column) -> float | None:
    q = exact_quantiles(long_values(df.select(c.alias("_x")), ["_x"]), [0.5]).first()
    return q["quantile"] if q else None


def ensure_target(df: DataFrame, target: str) -> DataFrame:
    """T-02..T-06: keep a usable target (>= 2 distinct values, T-06); otherwise
    build it from ``target`` minus ``_tier`` (if numeric), else the first
    non-boolean numeric column, else the text length of each row (T-05).
    The base series is median-filled (T-04) and cut at q0.33/q0.67 into
    low/medium/high (T-02), or at the median into low/high when it has fewer
    than three distinct values or the cut points coincide (T-03)."""
    if target in df.columns:
        if df.agg(F.countDistinct(col(target))).first()[0] >= 2:
            return df
    base = target.replace("_tier", "")
    out = df
    if base in df.columns and is_numeric(df.schema[base].dataType):
        x = col(base).cast("double")
    else:
        usable = [f.name for f in df.schema.fields
                  if is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType)]
        anynum = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
        if usable or anynum:
            x = col((usable or anynum)[0]).cast("double")
        else:
            signal = F.length(F.concat_ws(" ", *[F.coalesce(col(c).cast("string"), F.lit("nan"))
                                                for c in df.columns]))
            out = df.withColumn("text_signal", signal)
            x = F.col("text_signal").cast("double")
    probs = [0.33, 0.5, 0.67]
    known = F.nanvl(x, F.lit(None).cast("double"))
    qs = {r["prob"]: r["quantile"] for r in exact_quantiles(long_values(out.select(x.alias("_x")), ["_x"]), probs).collect()}
    med = qs.get(0.5)
    filled = F.coalesce(known, F.lit(med).cast("double"))
    if _fewer_than_three(out, filled):
        label = F.when(filled >= F.lit(med), F.lit("high")).otherwise(F.lit("low"))
    else:
        if out.agg(F.count_if(known.isNull())).first()[0]:   # filling moves the cut points
            q = exact_quantiles(long_values(out.select(filled.alias("_x")), ["_x"]), probs).collect()
            qs = {r["prob"]: r["quantile"] for r in q}
        label = tier_expr(filled, qs.get(0.33), qs.get(0.67), qs.get(0.5))
    return out.withColumn(target, label)


def _fewer_than_three(df: DataFrame, x: Column) -> bool:
    """True when ``x`` has fewer than 3 distinct non-null values, from two
    shuffle-free scans (min/max, then values strictly inside, up to the first of a task)."""
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None or lo == hi:
        return True
    return df.where((x > F.lit(lo)) & (x < F.lit(hi))).select(F.lit(1)).limit(1).count() == 0


def tier(df: DataFrame, column: str, out_col: str | None = None, fill_median: bool = True) -> DataFrame:
    """T-02/T-03 on one numeric column: low/medium/high at q0.33/q0.67, or
    low/high at the median for fewer than three distinct values or equal cut
    points (nulls first filled with the median when ``fill_median``)."""
    raw = F.nanvl(col(column).cast("double"), F.lit(None).cast("double"))
    out_col = out_col or f"{column}_tier"
    x = raw
    if fill_median:
        n, nn = df.agg(F.count(F.lit(1)), F.count(raw)).first()
        if nn < n:
            x = F.coalesce(raw, F.lit(_median(df, raw)).cast("double"))
    q = exact_quantiles(long_values(df.select(x.alias("_x")), ["_x"]), [0.33, 0.5, 0.67]).collect()
    qs = {r["prob"]: r["quantile"] for r in q}
    if _fewer_than_three(df, x):
        return df.withColumn(out_col, F.when(x >= F.lit(qs.get(0.5)), F.lit("high")).otherwise(F.lit("low")))
    return df.withColumn(out_col, tier_expr(x, qs.get(0.33), qs.get(0.67), qs.get(0.5)))


def target_usable(df: DataFrame, target: str) -> DataFrame:
    """T-06: one row (target, n_distinct, usable) where usable means >= 2 distinct values."""
    if target not in df.columns:
        return df.sparkSession.createDataFrame([(target, 0, False)], "target string, n_distinct long, usable boolean")
    return df.agg(F.lit(target).alias("target"), F.countDistinct(col(target)).alias("n_distinct")) \
        .withColumn("usable", F.col("n_distinct") >= 2)


def guess_stratify_column(df: DataFrame) -> DataFrame:
    """T-07: known target name with >= 2 distinct values, else the text column
    with the fewest distinct values among those with 2..20 (first on ties)."""
    asked = [f.name for f in df.schema.fields if f.name in STRATIFY_NAMES or is_string(f.dataType)]
    nd = few_distinct(df, asked, 20)
    pick = next((c for c in STRATIFY_NAMES if c in df.columns and nd[c] >= 2), None)
    reason = "known_name"
    if pick is None:
        cands = [(nd[f.name], i, f.name) for i, f in enumerate(df.schema.fields)
                 if is_string(f.dataType) and 2 <= nd[f.name] <= 20]
        pick = min(cands)[2] if cands else None
        reason = "lowest_cardinality" if pick else "none"
    elif nd[pick] > 20:   # a known name may have any number of values
        nd[pick] = df.agg(F.countDistinct(col(pick))).first()[0]
    return df.sparkSession.createDataFrame([(pick, reason, nd.get(pick) if pick else None)],
                                           "column_name string, reason string, n_distinct long")


def equal_width_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Bin edges of a right-closed equal-width cut: ``bins + 1`` points from
    ``lo`` to ``hi`` with the first edge lowered by 0.1 % of the range; a
    constant column is widened by 0.1 % of its value (0.001 at zero)."""
    if lo == hi:
        d = 0.001 * abs(lo) if lo != 0 else 0.001
        lo, hi = lo - d, hi + d
        step = (hi - lo) / bins
        edges = [i * step + lo for i in range(bins)] + [hi]
        return edges
    step = (hi - lo) / bins
    edges = [i * step + lo for i in range(bins)] + [hi]
    edges[0] -= (hi - lo) * 0.001
    return edges


def bin_index(x: Column, edges: Sequence[Column]) -> Column:
    """Right-closed bin of ``x``: first i with x <= edges[i+1]; null outside."""
    n = len(edges) - 1
    expr = F.lit(None).cast("int")
    for i in reversed(range(n)):
        expr = F.when(x <= edges[i + 1], F.lit(i)).otherwise(expr)
    return F.when(x > edges[0], expr)


def equal_width_bins(df: DataFrame, columns: Sequence[str], bins: int = 5, suffix: str = "_bin") -> DataFrame:
    """T-08: add ``<column>_bin`` (0..bins-1) for each column using one min/max aggregate."""
    row = df.agg(*[F.min(col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(columns)],
                 *[F.max(col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    out = df
    for i, c in enumerate(columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:
            out = out.withColumn(c + suffix, F.lit(None).cast("int"))
            continue
        edges = [F.lit(e) for e in equal_width_edges(lo, hi, bins)]
        out = out.withColumn(c + suffix, bin_index(col(c).cast("double"), edges))
    return out


def label_encode(df: DataFrame, column: str, out_col: str | None = None) -> DataFrame:
    """T-09: classes -> 0-based index in sorted order (classes as text)."""
    out_col = out_col or f"{column}_idx"
    codes = dense_codes(long_values(df, [column], as_type="string"))
    mapping = codes.select(F.col("value").alias("_cls"), F.col("code").alias(out_col))
    if is_small(mapping, 1_000_000):  # classes: broadcast only under a counted bound
        mapping = F.broadcast(mapping)
    return df.join(mapping, col(column).cast("string") == F.col("_cls"), "left").drop("_cls")
