"""Time-series operators F-01..F-06: monthly means and a linear trend forecast.

The whole forecast is one query: a partial-aggregated ``groupBy`` to month
ends (the only pass over the raw rows), then window and regression aggregates
over the month series, whose size is bounded by the number of distinct months
per group rather than by the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import col, datetime_columns, is_numeric, parse_number, string_columns
from tabulon.functions.dates import parse_timestamp

DATE_NAME_HINTS = ("date", "time", "month", "year")


def date_columns(df: DataFrame, min_parse_fraction: float = 0.5) -> DataFrame:
    """F-01: columns usable as dates -> (column_name, kind, parsed_fraction).

    Timestamp/date columns qualify directly.  String columns whose name holds
    date/time/month/year qualify when more than ``min_parse_fraction`` of all
    rows parse; all candidates are measured in one aggregate.
    """
    spark = df.sparkSession
    rows = [(c, "timestamp", 1.0) for c in datetime_columns(df)]
    cands = [c for c in string_columns(df) if any(k in c.lower() for k in DATE_NAME_HINTS)]
    if cands:
        aggs = [F.count(F.lit(1)).alias("_n")] + [
            F.count(parse_timestamp(col(c))).alias(f"_p{i}") for i, c in enumerate(cands)
        ]
        stats = df.agg(*aggs).first()
        n = stats["_n"] or 0
        for i, c in enumerate(cands):
            parsed = stats[f"_p{i}"]
            if n and parsed > n * min_parse_fraction:
                rows.append((c, "parsed_text", round(parsed / n, 4)))
    schema = "column_name string, kind string, parsed_fraction double"
    return spark.createDataFrame(rows, schema)


def _as_timestamp(df: DataFrame, date_col: str):
    dtype = df.schema[date_col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col(date_col)
    return parse_timestamp(col(date_col))


def monthly(df: DataFrame, date_col: str, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """F-02: mean of ``value_col`` per calendar month, keyed by month end.

    Rows with a null date or value drop out first; months without rows do
    not appear (parity: the series is compressed, not zero-filled).
    """
    value = col(value_col).cast("double") if is_numeric(df.schema[value_col].dataType) \
        else parse_number(col(value_col))
    base = df.select(*[col(b) for b in by], _as_timestamp(df, date_col).alias("_ts"), value.alias("_v"))
    base = base.where(F.col("_ts").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    return base.groupBy(*by, F.last_day("_ts").alias("month_end")).agg(
        F.avg("_v").alias("value_mean"), F.count(F.lit(1)).alias("n_rows"))


def forecast_guards(df: DataFrame, date_col: str, value_col: str, by: Sequence[str] = (),
                    min_rows: int = 5, min_months: int = 3) -> DataFrame:
    """F-05: per series, dated rows and non-empty months against the minimums."""
    m = monthly(df, date_col, value_col, by)
    g = m.groupBy(*by).agg(F.sum("n_rows").alias("n_dated_rows"), F.count(F.lit(1)).alias("n_months"))
    return g.withColumn(
        "reason",
        F.when(F.col("n_dated_rows") < min_rows, F.lit("not enough dated rows"))
        .when(F.col("n_months") < min_months, F.lit("not enough months")),
    ).withColumn("ok", F.col("reason").isNull())


def trend(df: DataFrame, date_col: str, value_col: str, periods: int = 6, by: Sequence[str] = (),
          min_rows: int = 5, min_months: int = 3, digits: int = 4) -> DataFrame:
    """F-02..F-05 as one plan: monthly means -> month index (W-04) -> least squares
    line on the index (F-03) -> ``periods`` forecast months, projected change and
    historical average (F-04); series failing F-05 produce no rows.

    Output: by..., step, month_end, forecast, slope, intercept, direction,
    n_months, hist_avg, last_actual, change_pct.
    """
    m = monthly(df, date_col, value_col, by)
    w = Window.partitionBy(*by).orderBy("month_end")
    idx = m.withColumn("month_idx", (F.row_number().over(w) - 1).cast("double"))
    fit = idx.groupBy(*by).agg(
        F.regr_slope("value_mean", "month_idx").alias("slope"),
        F.regr_intercept("value_mean", "month_idx").alias("intercept"),
        F.count(F.lit(1)).alias("n_months"),
        F.sum("n_rows").alias("n_dated_rows"),
        F.avg("value_mean").alias("hist_avg"),
        F.max_by("value_mean", "month_end").alias("last_actual"),
        F.max("month_end").alias("last_month"),
    ).where((F.col("n_dated_rows") >= min_rows) & (F.col("n_months") >= min_months))
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    x = F.col("n_months") - 1 + F.col("step")
    last_x = F.col("n_months") - 1 + F.lit(periods)
    last_forecast = F.col("intercept") + F.col("slope") * last_x
    out = steps.select(
        *by,
        "step",
        F.last_day(F.add_months("last_month", F.col("step"))).alias("month_end"),
        F.round(F.col("intercept") + F.col("slope") * x, digits).alias("forecast"),
        F.round("slope", digits).alias("slope"),
        F.round("intercept", digits).alias("intercept"),
        F.when(F.col("slope") > 0, F.lit("increasing")).otherwise(F.lit("decreasing")).alias("direction"),
        "n_months",
        F.round("hist_avg", digits).alias("hist_avg"),
        F.round("last_actual", digits).alias("last_actual"),
        F.round((last_forecast - F.col("last_actual"))
                / F.greatest(F.abs("last_actual"), F.lit(1.0)) * 100, digits).alias("change_pct"),
    )
    return out


def month_index(df: DataFrame, date_col: str, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """W-04: month series with a 0-based index over non-empty months."""
    m = monthly(df, date_col, value_col, by)
    w = Window.partitionBy(*by).orderBy("month_end")
    return m.withColumn("month_idx", F.row_number().over(w) - 1)


def latest_value(df: DataFrame, date_col: str, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """W-05: value of the last month of each series."""
    m = monthly(df, date_col, value_col, by)
    return m.groupBy(*by).agg(F.max("month_end").alias("month_end"),
                              F.max_by("value_mean", "month_end").alias("latest_value"))


def available_analyses(df: DataFrame, target: str | None, classes: Sequence[str] = (),
                       max_per_kind: int = 3) -> DataFrame:
    """F-06: analyses the table supports -> (rank, kind, value, date_column).

    Forecasts (first three numeric non-target columns) only when a date column
    exists, then classification when a target with classes exists, then
    regressions, then the free-form option.  Reads metadata plus F-01.
    """
    spark = df.sparkSession
    dates = [r["column_name"] for r in date_columns(df).collect()]  # bounded: one row per column
    nums = [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType) and f.name != target]
    opts: list[tuple[str, str | None, str | None]] = []
    if dates:
        opts += [("forecast", c, dates[0]) for c in nums[:max_per_kind]]
    if target and classes:
        opts.append(("classify", target, None))
    opts += [("regress", c, None) for c in nums[:max_per_kind]]
    opts.append(("custom", None, None))
    rows = [(i + 1, k, v, d) for i, (k, v, d) in enumerate(opts)]
    return spark.createDataFrame(rows, "rank int, kind string, value string, date_column string")
