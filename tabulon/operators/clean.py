"""Cleaning operators C-01..C-26.

Each pass is a DataFrame -> DataFrame function.  Passes that depend on data
(which columns to drop, convert, impute) first run one fused aggregate over
all candidate columns, then apply their decision as a single ``select``; the
whole pipeline (``clean``) needs at most four statistic jobs plus the
category-code table, regardless of the number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import (
    WHITESPACE,
    col,
    is_datetime,
    is_numeric,
    is_string,
    nan_to_null,
    parse_number,
    present,
    small_table,
    strip_ws,
)
from tabulon.functions.dates import parse_timestamp
from tabulon.functions.ordering import (
    IN_MEMORY_LIMIT,
    _few_distinct,
    dense_codes,
    distinct_per_column,
    exact_quantiles,
    long_values,
    modes,
)

# Text cells treated as missing after trimming (C-06), as listed
# by the reference (29 entries, 28 distinct once trimmed).
NA_MARKERS = [
    "", " ", "NA", "N/A", "n/a", "na", "null", "NULL", "Null",
    "None", "none", "NONE", "-", "--", "—", "?", "??",
    "#N/A", "#NA", "#DIV/0!", "#VALUE!", "#NAME?", "#REF!", "#NULL!",
    "nan", "NaN", "NAN", ".", "..",
]

# Characters removed before numeric parsing (C-07): currency
# signs, thousands separator and percent, plus all whitespace and every ASCII
# letter (the letters and whitespace are generated below).
UNIT_CHARS = "$£€¥₹,%"
ASCII_LETTERS = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1)) + "".join(
    chr(c) for c in range(ord("a"), ord("z") + 1))
NUMERIC_DROP_CHARS = UNIT_CHARS + WHITESPACE + ASCII_LETTERS

# Default target base columns, in priority order (C-13).
TARGET_BASE_NAMES = ["net_sales", "sales", "revenue", "amount"]

BROADCAST_CODES_LIMIT = 1_000_000


def _strip_ws(c: Column) -> Column:
    return strip_ws(c)


# --- column-name hygiene (metadata only) -------------------------------------

def strip_names(df: DataFrame) -> DataFrame:
    """C-01: strip surrounding whitespace from column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def drop_unnamed(df: DataFrame) -> DataFrame:
    """C-02: drop spreadsheet artefact columns named ``Unnamed: ...``."""
    keep = [c for c in df.columns if not c.startswith("Unnamed:")]
    return df.select(*[col(c) for c in keep]) if len(keep) != len(df.columns) else df


def dedupe_names(df: DataFrame) -> DataFrame:
    """C-03: second ``x`` becomes ``x_1``, third ``x_2`` (positional rename)."""
    names = unique_names(df.columns)
    return df.toDF(*names) if names != df.columns else df


def unique_names(columns: Sequence[str]) -> list[str]:
    """Repeated names get the next free suffix ``_1``, ``_2``, ...; names that differ only
    in case count as repeated, as Spark resolves columns without regard to case."""
    taken = {c.lower() for c in columns}
    used: set[str] = set()
    count: dict[str, int] = {}
    names = []
    for c in columns:
        name = c
        if c.lower() in used:
            k = count.get(c.lower(), 0) + 1
            while f"{c}_{k}".lower() in taken | used:
                k += 1
            count[c.lower()] = k
            name = f"{c}_{k}"
        used.add(name.lower())
        names.append(name)
    return names


# --- row / cell hygiene -------------------------------------------------------

def drop_empty_rows(df: DataFrame) -> DataFrame:
    """C-04: drop rows in which every cell is null."""
    return df.dropna(how="all")


def non_null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    """Non-null count of every column from one aggregate (one small row)."""
    cols = list(columns or df.columns)
    if not cols:
        return {}
    row = df.agg(*[F.count(present(col(c), df.schema[c].dataType)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"c{i}"] for i, c in enumerate(cols)}


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """C-05: drop columns with no non-null value."""
    counts = non_null_counts(df)
    return df.select(*[col(c) for c in df.columns if counts[c] > 0])


def na_marker_expr(c: Column) -> Column:
    trimmed = _strip_ws(c)
    return F.when(trimmed.isin(NA_MARKERS), F.lit(None).cast("string")).otherwise(trimmed)


def normalize_missing(df: DataFrame) -> DataFrame:
    """C-06: trim every string cell; listed missing markers become null."""
    return df.select(*[na_marker_expr(col(f.name)).alias(f.name) if is_string(f.dataType) else col(f.name)
                       for f in df.schema.fields])


def numeric_text_expr(c: Column) -> Column:
    """Text -> number after deleting currency/percent signs, separators,
    whitespace and ASCII letters (one ``translate``, no regular expression)."""
    s = F.translate(c, NUMERIC_DROP_CHARS, "")
    # empty results are the common non-numeric case; skip the cast's slow failure path
    return F.when(F.length(s) > 0, s.try_cast("double"))


def numeric_text_candidates(df: DataFrame, target: str | None = None, min_values: int = 5,
                            min_ratio: float = 0.8) -> list[str]:
    """String columns (not the target) with >= ``min_values`` non-null cells of
    which more than ``min_ratio`` parse as numbers once units are stripped."""
    cands = [f.name for f in df.schema.fields if is_string(f.dataType) and f.name != target]
    if not cands:
        return []
    aggs = []
    for i, c in enumerate(cands):
        aggs += [F.count(col(c)).alias(f"n{i}"), F.count(numeric_text_expr(col(c))).alias(f"p{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cands):
        n, p = row[f"n{i}"], row[f"p{i}"]
        if n >= min_values and p / max(n, 1) > min_ratio:
            out.append(c)
    return out


def coerce_numeric_text(df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """C-07: convert text columns that are mostly numbers ("$1,200.50",
    "25 %", "10 kg") into doubles; cells that do not parse become null."""
    conv = set(columns if columns is not None else numeric_text_candidates(df, target))
    return df.select(*[numeric_text_expr(col(c)).alias(c) if c in conv else col(c) for c in df.columns])


def bool_to_int(df: DataFrame) -> DataFrame:
    """C-08: booleans become 0/1 longs."""
    return df.select(*[col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, T.BooleanType)
                       else col(f.name) for f in df.schema.fields])


def column_stats(df: DataFrame, date_candidates: Sequence[str] = (),
                 distinct: Sequence[str] = ()) -> dict[str, dict[str, int]]:
    """One aggregate: rows and non-null counts of every column, and parsed-date
    counts of ``date_candidates`` (inputs of C-09 and C-12a); exact distinct
    counts only of the ``distinct`` columns, from one unpivoted aggregate."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(df.schema.fields):
        aggs.append(F.count(present(col(f.name), f.dataType)).alias(f"nn{i}"))
    for i, c in enumerate(date_candidates):
        aggs.append(F.count(parse_timestamp(col(c))).alias(f"dp{i}"))
    row = df.agg(*aggs).first()
    n = row["_n"]
    stats = {c: {"n": n, "non_null": row[f"nn{i}"]} for i, c in enumerate(df.columns)}
    if distinct:
        known = {r["column_name"]: r["n_distinct"] for r in distinct_per_column(df, distinct).collect()}
        for c in distinct:
            stats[c]["distinct"] = known.get(c, 0)
    for i, c in enumerate(date_candidates):
        stats[c]["parsed"] = row[f"dp{i}"]
    return stats


def pipeline_stats(df: DataFrame, date_candidates: Sequence[str] = (), ratio: float = 0.9,
                   margin: float = 0.2, estimate: Sequence[str] = ()) -> dict[str, dict[str, int]]:
    """Inputs of C-09..C-12a without an exact distinct count per column.

    Constant columns are found with min/max (no distinct count needed);
    text columns get an HLL distinct estimate, recounted exactly when the
    estimate lies above ``ratio - margin`` (its error is under 5 % rsd, so a
    column estimated lower is below the ratio), so no column is dropped on an
    estimate.
    """
    fields = df.schema.fields
    texts = [f.name for f in fields if is_string(f.dataType)]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        c = col(f.name)
        c = present(c, f.dataType)
        aggs += [F.count(c).alias(f"nn{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    for i, c in enumerate(texts):
        aggs.append(F.approx_count_distinct(col(c)).alias(f"ad{i}"))  # rsd 5 %: margin 0.2 is > 4 sigma
    extra = [c for c in estimate if c not in texts]
    for i, c in enumerate(extra):
        aggs.append(F.approx_count_distinct(col(c)).alias(f"ae{i}"))
    for i, c in enumerate(date_candidates):
        aggs.append(F.count(parse_timestamp(col(c))).alias(f"dp{i}"))
    row = df.agg(*aggs).first()
    n = row["_n"]
    stats = {}
    for i, f in enumerate(fields):
        nn = row[f"nn{i}"]
        same = nn == 0 or row[f"lo{i}"] == row[f"hi{i}"]
        stats[f.name] = {"n": n, "non_null": nn, "distinct": 0 if nn == 0 else (1 if same else 2)}
    for i, c in enumerate(extra):
        stats[c]["approx"] = row[f"ae{i}"]
    near = []
    for i, c in enumerate(texts):
        est = row[f"ad{i}"]
        stats[c]["approx"] = est
        stats[c]["distinct"] = max(stats[c]["distinct"], est) if stats[c]["distinct"] > 1 else stats[c]["distinct"]
        if stats[c]["distinct"] > 1 and est / max(n, 1) >= ratio - margin:
            near.append(c)
    if near:
        for r in distinct_per_column(df, near).collect():
            stats[r["column_name"]]["distinct"] = r["n_distinct"]
    for i, c in enumerate(date_candidates):
        stats[c]["parsed"] = row[f"dp{i}"]
    return stats


def sparse_columns(stats: dict, max_missing: float = 0.6) -> list[str]:
    """C-09 decision: keep a column only with >= int(n - 0.6 n) non-null cells."""
    out = []
    for c, s in stats.items():
        n = s["n"]
        thresh = int(n - max_missing * n) if n else 0
        if s["non_null"] < thresh:
            out.append(c)
    return out


def drop_sparse_columns(df: DataFrame, max_missing: float = 0.6, stats: dict | None = None) -> DataFrame:
    """C-09: drop columns with more than 60 % missing cells."""
    stats = stats or column_stats(df)
    drop = set(sparse_columns(stats, max_missing))
    return df.select(*[col(c) for c in df.columns if c not in drop])


def id_like_columns(df: DataFrame, stats: dict, max_unique_ratio: float = 0.9) -> list[str]:
    """C-10 decision: string columns whose distinct/rows ratio exceeds 0.9
    (the target is *not* exempt)."""
    return [f.name for f in df.schema.fields
            if is_string(f.dataType) and stats[f.name]["distinct"] / max(stats[f.name]["n"], 1) > max_unique_ratio]


def drop_id_like(df: DataFrame, max_unique_ratio: float = 0.9, stats: dict | None = None) -> DataFrame:
    """C-10: drop ID-like text columns."""
    stats = stats or pipeline_stats(df, ratio=max_unique_ratio)
    drop = set(id_like_columns(df, stats, max_unique_ratio))
    return df.select(*[col(c) for c in df.columns if c not in drop])


def constant_columns(stats: dict, target: str | None = None) -> list[str]:
    """C-11 decision: at most one distinct value, null counted as a value."""
    out = []
    for c, s in stats.items():
        with_null = s["distinct"] + (1 if s["non_null"] < s["n"] else 0)
        if c != target and with_null <= 1:
            out.append(c)
    return out


def drop_constant(df: DataFrame, target: str | None = None, stats: dict | None = None) -> DataFrame:
    """C-11: drop constant columns (target exempt)."""
    # minimum and maximum tell a constant: no distinct count is needed
    stats = stats or pipeline_stats(df, ratio=float("inf"))
    drop = set(constant_columns(stats, target))
    return df.select(*[col(c) for c in df.columns if c not in drop])


def date_part_columns(c: Column, name: str) -> list[Column]:
    return [F.year(c).alias(f"{name}_year"), F.month(c).alias(f"{name}_month"),
            F.weekday(c).alias(f"{name}_dow")]


def date_text_candidates(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_string(f.dataType) and ("date" in f.name.lower() or "time" in f.name.lower())]


def expand_dates(df: DataFrame, text_dates: Sequence[str] | None = None, min_ratio: float = 0.5) -> DataFrame:
    """C-12a + C-12b: text columns named *date*/*time* that parse for more than
    half of the rows, and every timestamp column, become ``_year``, ``_month``
    and ``_dow`` (Monday = 0) appended at the end; the source column is dropped."""
    if text_dates is None:
        cands = date_text_candidates(df)
        stats = column_stats(df.select(*[col(c) for c in cands]), cands) if cands else {}
        text_dates = [c for c in cands if stats[c]["parsed"] > stats[c]["n"] * min_ratio]
    text_dates = list(text_dates)
    ts_cols = [f.name for f in df.schema.fields if is_datetime(f.dataType)]
    keep = [col(c) for c in df.columns if c not in text_dates and c not in ts_cols]
    extra = []
    for c in text_dates:
        extra += date_part_columns(parse_timestamp(col(c)), c)
    for c in ts_cols:
        extra += date_part_columns(col(c), c)
    return df.select(*keep, *extra)


def tier_expr(x: Column, q33: float | None, q67: float | None, median: float | None) -> Column:
    """Three tiers cut at q0.33/q0.67 (right-closed); two tiers at the median
    when the cut points coincide.  Null values get the label ``nan`` in the
    three-tier case and ``low`` in the two-tier case, like the reference."""
    if q33 is None:
        return F.lit("nan")
    if q33 == q67:
        return F.when(x >= F.lit(median), F.lit("high")).otherwise(F.lit("low"))
    return (F.when(x.isNull() | F.isnan(x), F.lit("nan"))
            .when(x <= F.lit(q33), F.lit("low")).when(x <= F.lit(q67), F.lit("medium")).otherwise(F.lit("high")))


def add_default_target(df: DataFrame, target: str = "sales_category") -> DataFrame:
    """C-13: when ``target`` is absent, derive it from the first of
    net_sales/sales/revenue/amount (tiers at q0.33/q0.67, nulls not filled)."""
    if target in df.columns:
        return df
    base = next((c for c in TARGET_BASE_NAMES if c in df.columns), None)
    if base is None:
        return df
    x = col(base).cast("double")
    q = {r["prob"]: r["quantile"] for r in
         exact_quantiles(long_values(df.select(x.alias("_x")), ["_x"]), [0.33, 0.5, 0.67]).collect()}
    q33, q67, med = q.get(0.33), q.get(0.67), q.get(0.5)
    return df.withColumn(target, tier_expr(x, q33, q67, med))


def _medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    if not cols:
        return {}
    q = exact_quantiles(long_values(df, cols), [0.5]).collect()  # one row per column
    return {r["column_name"]: r["quantile"] for r in q}


def _modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    if not cols:
        return {}
    m = modes(long_values(df, cols, as_type="string")).collect()  # one row per column
    return {r["column_name"]: r["value"] for r in m}


def fill_numeric_median(df: DataFrame, columns: Sequence[str] | None = None,
                        null_counts: dict[str, int] | None = None) -> DataFrame:
    """C-14: numeric nulls -> column median (columns with nulls become double)."""
    cols = list(columns if columns is not None else [f.name for f in df.schema.fields if is_numeric(f.dataType)])
    if null_counts is None:
        nn = non_null_counts(df, cols)
        n = df.count()
        null_counts = {c: n - nn[c] for c in cols}
    holes = [c for c in cols if null_counts.get(c, 0) > 0]
    med = _medians(df, holes)
    return df.select(*[
        F.coalesce(F.nanvl(col(c).cast("double"), F.lit(None).cast("double")),
                   F.lit(med.get(c)).cast("double")).alias(c) if c in holes else col(c)
        for c in df.columns])


def fill_text_mode(df: DataFrame, columns: Sequence[str] | None = None,
                   null_counts: dict[str, int] | None = None, fallback: str = "Unknown") -> DataFrame:
    """C-15: text nulls -> most frequent value (smallest on ties), ``Unknown``
    when the column has no value at all."""
    cols = list(columns if columns is not None else [f.name for f in df.schema.fields if is_string(f.dataType)])
    if null_counts is None:
        nn = non_null_counts(df, cols)
        n = df.count()
        null_counts = {c: n - nn[c] for c in cols}
    holes = [c for c in cols if null_counts.get(c, 0) > 0]
    mode = _modes(df, holes)
    return df.select(*[F.coalesce(col(c), F.lit(mode.get(c, fallback))).alias(c) if c in holes else col(c)
                       for c in df.columns])


def encode_categories(df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None,
                      broadcast_limit: int = BROADCAST_CODES_LIMIT) -> DataFrame:
    """C-16: text columns (target exempt) -> integer codes in sorted value order.

    The code table is built distributed (``dense_codes``); it is broadcast
    only when its counted size is under ``broadcast_limit``, otherwise each
    column is mapped with a shuffle join (AQE splits skewed values).
    """
    cols = list(columns if columns is not None else
                [f.name for f in df.schema.fields if is_string(f.dataType) and f.name != target])
    if not cols:
        return df
    long = long_values(df, cols, as_type="string")
    small = _few_distinct(long, broadcast_limit)
    codes = dense_codes(long, small=small).checkpoint(eager=True)   # one code table for all columns
    out = df
    for i, c in enumerate(cols):
        m = codes.where(F.col("column_name") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        m = F.broadcast(m) if small else m
        out = out.join(m, col(c) == F.col(f"_v{i}"), "left")
    return out.select(*[F.col(f"_c{cols.index(c)}").alias(c) if c in cols else col(c) for c in df.columns])


# --- C-17: the whole pipeline ---------------------------------------------------

def clean(df: DataFrame, target: str = "sales_category", return_report: bool = False, carried: Sequence[str] = ()):
    """C-17: C-01 .. C-16 in the reference order (``carried``: columns that ride along and are not looked at).

    Statistic jobs: (1) non-null and numeric-parse counts, (2) non-null,
    distinct and date-parse counts, (3) target quantiles when the target is
    derived, (4) medians and modes; then the category-code table.
    """
    report: dict[str, list[str]] = {}
    df = nan_to_null(dedupe_names(drop_unnamed(strip_names(df))))
    df = drop_empty_rows(df)
    # job 1: empty columns and numeric-text candidates, measured on the trimmed cells
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count(col(f.name)).alias(f"raw{i}"))
        if is_string(f.dataType) and f.name != target:
            cleaned = na_marker_expr(col(f.name))
            aggs += [F.count(cleaned).alias(f"nn{i}"), F.count(numeric_text_expr(cleaned)).alias(f"np{i}")]
    row = df.agg(*aggs).first()
    empty = [f.name for i, f in enumerate(fields) if row[f"raw{i}"] == 0]
    numeric_text = [f.name for i, f in enumerate(fields)
                    if is_string(f.dataType) and f.name != target and f.name not in empty
                    and row[f"nn{i}"] >= 5 and row[f"np{i}"] / max(row[f"nn{i}"], 1) > 0.8]
    report["dropped_empty"] = empty
    report["numeric_text"] = numeric_text
    df = df.select(*[col(c) for c in df.columns if c not in empty])
    df = normalize_missing(df)
    df = coerce_numeric_text(df, target, numeric_text)
    df = bool_to_int(df)
    # job 2: sparse / id-like / constant columns, text dates, and HLL size
    # estimates of the numeric columns that have holes
    dates = date_text_candidates(df)
    holes = [f.name for i, f in enumerate(fields) if 0 < row[f"raw{i}"] < row["rows"] and is_numeric(f.dataType)]
    holes += numeric_text
    stats = pipeline_stats(df.drop(*carried), dates, estimate=holes)
    sparse = sparse_columns(stats)
    remaining = df.select(*[col(c) for c in df.columns if c not in sparse])
    idlike = id_like_columns(remaining, stats)
    const = constant_columns({c: s for c, s in stats.items() if c not in sparse and c not in idlike}, target)
    drop = set(sparse) | set(idlike) | set(const)
    report.update(dropped_sparse=sparse, dropped_id_like=idlike, dropped_constant=const)
    df = df.select(*[col(c) for c in df.columns if c not in drop])
    text_dates = [c for c in dates if c not in drop and stats[c]["parsed"] > stats[c]["n"] * 0.5]
    report["expanded_dates"] = text_dates + [f.name for f in df.schema.fields if is_datetime(f.dataType)]
    df = expand_dates(df, text_dates)
    # job 3: derived target
    df = add_default_target(df, target)
    # job 4: medians and modes of the columns that still have holes; null
    # counts come from job 2 (date parts inherit the parse counts)
    n = stats[next(iter(stats))]["n"] if stats else df.count()
    null_counts = dict.fromkeys(carried, 0) | {c: n - s["non_null"] for c, s in stats.items()}
    for c in text_dates:
        for part in ("_year", "_month", "_dow"):
            null_counts[c + part] = n - stats[c]["parsed"]
    for c in report["expanded_dates"][len(text_dates):]:
        for part in ("_year", "_month", "_dow"):
            null_counts[c + part] = n - stats[c]["non_null"]
    missing_counts = [c for c in df.columns if c not in null_counts]
    if missing_counts:  # a derived target
        nn = non_null_counts(df, missing_counts)
        null_counts.update({c: n - nn[c] for c in missing_counts})
    df = _fill_and_encode(df, target, null_counts, stats)
    if return_report:
        return df, report
    return df


CODE_LITERAL_LIMIT = 64   # more values are coded by a join


def _within_limit(sizes: dict, limit: int | None = None) -> set:
    """As many keys as fit ``limit`` together, smallest first (sizes are HLL estimates, taken a quarter larger)."""
    limit, total, chosen = IN_MEMORY_LIMIT if limit is None else limit, 0.0, set()
    for key, n in sorted(sizes.items(), key=lambda kv: kv[1]):
        total += n * 1.25
        if total > limit:
            break
        chosen.add(key)
    return chosen


def _fill_and_encode(df: DataFrame, target: str, null_counts: dict[str, int], stats: dict) -> DataFrame:
    """C-14..C-16 with one statistics job for the columns whose HLL estimates
    are small together: medians (``percentile``), modes (``mode``, smallest on ties) and
    the sorted value sets for codes (``collect_set``) are computed together,
    and codes become a literal-map projection (no join).  Columns estimated
    large go through the distributed quantile / mode / code paths instead."""
    def est(c):
        return stats.get(c, {}).get("approx", 0)  # date parts and derived targets: small by construction

    nums = [f.name for f in df.schema.fields if is_numeric(f.dataType) and null_counts.get(f.name, 0) > 0]
    texts = [f.name for f in df.schema.fields if is_string(f.dataType)]
    text_holes = [c for c in texts if null_counts.get(c, 0) > 0]
    codes = [c for c in texts if c != target]
    # the value maps of all these columns meet in one task: their sizes count together
    together = _within_limit({("num", c): est(c) for c in nums} | {("mode", c): est(c) for c in text_holes})
    big_num = [c for c in nums if ("num", c) not in together]
    big_mode = [c for c in text_holes if ("mode", c) not in together]
    big_code = [c for c in codes if est(c) * 1.25 > CODE_LITERAL_LIMIT]
    aggs = []
    for i, c in enumerate(nums):
        if c not in big_num:
            aggs.append(F.percentile(F.nanvl(col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.5)).alias(f"m{i}"))
    for i, c in enumerate(text_holes):
        if c not in big_mode:
            aggs.append(F.mode(col(c), True).alias(f"o{i}"))
    for i, c in enumerate(codes):
        if c not in big_code:
            aggs.append(F.array_sort(F.collect_set(col(c))).alias(f"s{i}"))
    row = df.agg(*aggs).first() if aggs else None
    med = {c: row[f"m{i}"] for i, c in enumerate(nums) if c not in big_num}
    med.update(_medians(df, big_num))
    mode = {c: row[f"o{i}"] for i, c in enumerate(text_holes) if c not in big_mode}
    mode.update(_modes(df, big_mode))
    exprs = {}
    for c in nums:
        exprs[c] = F.coalesce(F.nanvl(col(c).cast("double"), F.lit(None).cast("double")),
                              F.lit(med.get(c)).cast("double"))
    for c in text_holes:
        exprs[c] = F.coalesce(col(c), F.lit(mode.get(c) if mode.get(c) is not None else "Unknown"))
    for i, c in enumerate(codes):
        if c in big_code:
            continue
        values = list(row[f"s{i}"] or [])
        if null_counts.get(c, 0) > 0:
            fill = mode.get(c) if mode.get(c) is not None else "Unknown"
            values = sorted(set(values) | {fill})
        lookup = F.create_map(*[x for k, v in enumerate(values) for x in (F.lit(v), F.lit(k))]) if values \
            else F.create_map().cast("map<string,int>")
        exprs[c] = F.element_at(lookup, exprs.get(c, col(c)))
    out = df.select(*[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns])
    if big_code:
        out = encode_categories(out, target, big_code)
    return out


# --- C-18 .. C-24: rule sets ------------------------------------------------------

RULE_KEYS = ("drop", "rename", "cast", "impute", "target")


def validate_rules(obj) -> bool:
    """C-18: a rule set is a dict with the five keys, a list ``drop`` and
    dicts ``rename``, ``cast`` and ``impute``."""
    if not isinstance(obj, dict) or not set(RULE_KEYS).issubset(obj.keys()):
        return False
    return (isinstance(obj["drop"], list) and isinstance(obj.get("rename", {}), dict)
            and isinstance(obj.get("cast", {}), dict) and isinstance(obj.get("impute", {}), dict))


# Target names tried by the default rules, in order (C-19).
DEFAULT_RULE_TARGETS = ["sales_category", "target", "label", "class", "outcome", "status", "category"]


def default_rules(df: DataFrame, max_missing: float = 0.7, max_unique_ratio: float = 0.9) -> DataFrame:
    """C-19: data-driven rules from one aggregate over the full table.

    Output rows (column_name, action, arg): ``drop`` for >70 % missing or
    text columns with distinct/rows > 0.9, else ``impute`` median (numeric)
    or mode; plus one ``target`` row (known name, else the text column with
    the fewest distinct values).
    """
    texts = [f.name for f in df.schema.fields if is_string(f.dataType)]
    stats = column_stats(df, distinct=texts)
    rows, dropped, text_uniques = [], set(), []
    for f in df.schema.fields:
        s = stats[f.name]
        n = max(s["n"], 1)
        if (s["n"] - s["non_null"]) / n > max_missing:
            rows.append((f.name, "drop", "missing"))
            dropped.add(f.name)
        elif is_string(f.dataType) and s["distinct"] / n > max_unique_ratio:
            rows.append((f.name, "drop", "id_like"))
            dropped.add(f.name)
        else:
            rows.append((f.name, "impute", "median" if is_numeric(f.dataType) else "mode"))
            if is_string(f.dataType):
                text_uniques.append((s["distinct"], f.name))
    target = next((c for c in DEFAULT_RULE_TARGETS if c in df.columns and c not in dropped), None)
    if target is None and text_uniques:
        best = min(u for u, _ in text_uniques)
        target = next(c for u, c in text_uniques if u == best)
    if target is not None:
        rows.append((target, "target", None))
    return df.sparkSession.createDataFrame(rows, "column_name string, action string, arg string")


def rules_to_dict(rules: DataFrame) -> dict:
    """Rules table (one row per column, bounded by the schema width) -> rule dict."""
    out = {"drop": [], "rename": {}, "cast": {}, "impute": {}, "target": None}
    for r in rules.collect():
        if r["action"] == "drop":
            out["drop"].append(r["column_name"])
        elif r["action"] == "impute":
            out["impute"][r["column_name"]] = r["arg"]
        elif r["action"] == "target":
            out["target"] = r["column_name"]
    return out


def apply_drop(df: DataFrame, drop: Sequence[str]) -> DataFrame:
    """C-20: drop the listed columns; unknown names are ignored."""
    gone = set(drop)
    return df.select(*[col(c) for c in df.columns if c not in gone])


def apply_rename(df: DataFrame, rename: dict[str, str]) -> DataFrame:
    """C-21: rename columns (before cast/impute, so later keys use new names)."""
    return df.select(*[col(c).alias(rename.get(c, c)) for c in df.columns])


def apply_cast(df: DataFrame, cast: dict[str, str]) -> DataFrame:
    """C-22: int/float/num -> number or null (ints are not truncated);
    str/object -> text (null stays null)."""
    exprs = []
    for f in df.schema.fields:
        kind = str(cast.get(f.name, "")).lower()
        c = col(f.name)
        if not kind:
            exprs.append(c)
        elif "int" in kind or "float" in kind or "num" in kind:
            exprs.append((c.cast("double") if is_numeric(f.dataType) else parse_number(c)).alias(f.name))
        elif "str" in kind or "object" in kind:
            exprs.append(c.cast("string").alias(f.name))
        else:
            exprs.append(c)
    return df.select(*exprs)


def apply_impute(df: DataFrame, impute: dict[str, str], stats: dict[str, object] | None = None) -> DataFrame:
    """C-23: median (mode when not numeric), zero, or mode for the listed columns.

    Statistics are global (one table-wide median/mode), not per chunk; a
    stream passes frozen ``stats`` fitted once in batch (ST-01).
    """
    targets = {c: s for c, s in impute.items() if c in df.columns}
    if stats is None:
        stats = fit_impute(df, targets)
    exprs = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name not in targets:
            exprs.append(c)
            continue
        fill = stats.get(f.name)
        if targets[f.name] == "zero":
            fill = 0
        if fill is None:
            exprs.append(c)
        elif is_numeric(f.dataType):
            exprs.append(F.coalesce(present(c, f.dataType).cast("double"), F.lit(float(fill))).alias(f.name))
        else:
            exprs.append(F.coalesce(c, F.lit(str(fill))).alias(f.name))
    return df.select(*exprs)


def fit_impute(df: DataFrame, impute: dict[str, str]) -> dict[str, object]:
    """Fill values for ``impute``: medians of numeric median-columns, modes of
    the rest (``Unknown`` when a column has no value)."""
    med_cols = [c for c, s in impute.items() if s == "median" and c in df.columns and is_numeric(df.schema[c].dataType)]
    mode_cols = [c for c, s in impute.items() if s != "zero" and c in df.columns and c not in med_cols]
    out: dict[str, object] = dict(_medians(df, med_cols))
    m = _modes(df, mode_cols)
    for c in mode_cols:
        out[c] = m.get(c, "Unknown")
    return out


def apply_rules(df: DataFrame, rules: dict, stats: dict | None = None) -> DataFrame:
    """C-24: drop -> rename -> cast -> impute, as one projection plus one
    statistics job (skipped when ``stats`` are given)."""
    if not validate_rules(rules):
        raise ValueError("malformed rule set")
    out = apply_drop(df, rules.get("drop", []))
    out = apply_rename(out, rules.get("rename", {}))
    out = apply_cast(out, rules.get("cast", {}))
    return apply_impute(out, rules.get("impute", {}), stats)


# --- C-25 / C-26 --------------------------------------------------------------------

def safe_numeric_expr(c: Column, dtype: T.DataType) -> Column:
    """C-25: booleans -> 0/1, numbers -> double, text -> parsed double or null."""
    if isinstance(dtype, T.BooleanType):
        return c.cast("long")
    if is_numeric(dtype):
        return c.cast("double")
    return parse_number(c.cast("string"))


def safe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[safe_numeric_expr(col(f.name), f.dataType).alias(f.name) if f.name in columns
                       else col(f.name) for f in df.schema.fields])


def training_guards(df: DataFrame, target: str, min_rows: int = 10) -> DataFrame:
    """C-26: pre-training checks as rows (check, passed, actual) from one aggregate."""
    has_target = target in df.columns
    aggs = [F.count(F.lit(1)).alias("n")]
    if has_target:
        aggs.append(F.countDistinct(col(target)).alias("classes"))
    row = df.agg(*aggs).first()
    n = row["n"]
    classes = row["classes"] if has_target else 0
    n_cols = len(df.columns)
    features = len([c for c in df.columns if c != target])
    checks = [
        ("non_empty", n > 0, str(n)),
        ("min_columns", n_cols >= 2, str(n_cols)),
        ("min_rows", n >= min_rows, str(n)),
        ("target_present", has_target, str(has_target).lower()),
        ("min_features", features >= 1, str(features)),
        ("min_classes", classes >= 2, str(classes)),
    ]
    return small_table(df.sparkSession, checks, "check string, passed boolean, actual string")
