"""Set operations U-01..U-03."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import col


def union_parts(*parts: DataFrame) -> DataFrame:
    """U-01: union-all by column name; columns missing in a part are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dropped_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """U-02: columns of ``before`` that ``after`` no longer has, in original order."""
    spark = before.sparkSession
    b = spark.createDataFrame([(c, i) for i, c in enumerate(before.columns)], "column_name string, position int")
    a = spark.createDataFrame([(c,) for c in after.columns], "column_name string")
    return b.join(a, "column_name", "left_anti")


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """U-03: one row per distinct ``subset`` (all columns by default), keeping
    the first row under ``order_by``.  ``min_by`` aggregates map-side, so a
    value repeated in a third of the table is combined before the shuffle."""
    subset = list(subset or df.columns)
    if not order_by:
        return df.dropDuplicates(subset)
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.dropDuplicates(subset)
    order = F.struct(*[col(o) for o in order_by])
    kept = df.groupBy(*[col(s) for s in subset]).agg(F.min_by(F.struct(*[col(c) for c in rest]), order).alias("_r"))
    return kept.select(*[col(c) if c in subset else F.col(f"_r.{c}").alias(c) for c in df.columns])
