"""Tolerant timestamp parsing shared by cleaning (C-12a) and forecasting (F-01)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text layouts, tried in this order after Spark's
# own ISO-8601 parsing. Month-first wins over day-first for ambiguous dates.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "MM-dd-yyyy",
    "dd.MM.yyyy",
    "yyyyMMdd",
]


def parse_timestamp(c: Column) -> Column:
    """First successful parse of a string column, else NULL (never raises)."""
    s = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_timestamp(s), *[F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS])
