"""Schema helpers: classify columns by Spark type and quote names safely."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType,
)


# Characters Python's str.strip() and the reference's ``\s`` remove: built by rule.
WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


# The same set as a Java regex character class (no Unicode-property lookups).
WS_CLASS = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE) + "]"


def strip_ws(c: Column) -> Column:
    """Python-style strip (all Unicode whitespace) without a regular expression."""
    return F.btrim(c, F.lit(WHITESPACE))


# A number as text: what Python's and pandas' parsers read, without the JVM's suffixes and hexadecimals.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(c: Column) -> Column:
    """Text -> double, null for anything but a plain decimal number."""
    s = strip_ws(c)
    return F.when(F.regexp_like(s, F.lit(NUMBER_PATTERN)), s.try_cast("double"))


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def present(c: Column, dtype: T.DataType) -> Column:
    """The value with NaN as null: both are missing."""
    return F.when(~F.isnan(c), c) if is_floating(dtype) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN becomes null (a projection)."""
    if not any(is_floating(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[present(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def quote(name: str) -> str:
    """Backtick a column name so dots, spaces and colons survive parsing."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def is_numeric(dtype: T.DataType) -> bool:
    """Numeric in the pandas sense: booleans count as numbers."""
    return isinstance(dtype, NUMERIC_TYPES)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType) and f.name not in exclude]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def dtype_name(dtype: T.DataType) -> str:
    """Short type label reported by the profile operators."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if is_datetime(dtype):
        return "datetime64"
    return "object"


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows from the driver as a table; handed over by Arrow, it needs no Python worker in a task."""
    fields = T._parse_datatype_string(schema)
    table = pa.Table.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], schema=to_arrow_schema(fields))
    return spark.createDataFrame(table, fields)


FEW_ROWS = 1_000_000     # up to here a table stays in the tasks it is in
ROWS_PER_TASK = 300_000
PLACE = "_row_place"


def dealt_out(df: DataFrame, rows: int) -> DataFrame:
    """A large table of ``rows`` rows before many passes over it: dealt evenly to tasks, however few splits
    its file has, and kept by columns on the executors (memory, then disk), so that it is read and dealt once.
    It is kept as arrays: as bytes it lies in blocks of 1 MB, which waste half of the heap that they take.

    Rows of files are dealt by their place in the file: without it, Spark sorts a split before it deals it."""
    if rows <= FEW_ROWS:
        return df
    tasks = -(-rows // ROWS_PER_TASK)
    try:
        placed = df.withColumn(PLACE, F.col("_metadata.row_index"))   # resolves only over files
        dealt = placed.repartition(tasks, PLACE).drop(PLACE)
        dealt.schema
    except AnalysisException:
        dealt = df.repartition(tasks)
    return dealt.persist(StorageLevel.MEMORY_AND_DISK_DESER)
