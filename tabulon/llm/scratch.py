"""Written tables in the shared folder, size-checked broadcasts and byte-level words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import bound_batches, checkpoint_dir, ship_package

#: Rows that may be broadcast when a row is a few dozen bytes (about 50 MB).
BROADCAST_ROWS = 1_000_000


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tabulon-llm-{spark.sparkContext.applicationId}"


#: Whether Spark drops a query's shuffles when it ends, instead of when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and a lost
    executor costs a re-read, not a recomputation.

    ``drop_shuffles``: those behind the table go with the end of writing it."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true" if drop_shuffles else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> SparkSession:
    """Make the session ready for operators whose tasks run this package's Python."""
    checkpoint_dir(spark)
    bound_batches(spark)
    ship_package(spark)
    return spark


def broadcast_if(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the counted ``rows`` stay under ``limit``; otherwise the
    frame is returned unhinted and the join shuffles (AQE splits skewed keys)."""
    return F.broadcast(df) if rows <= limit else df


def uniform(*parts: Column) -> Column:
    """Deterministic pseudorandom double in [0, 1) from the hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0 ** -53)


# A word is a maximal run of [0-9a-z] or non-ASCII bytes, A-Z lower-cased first.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
                   else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text (see ``WORD_BYTES``)."""
    # split() without argument also cuts at byte 0x85 and 0xa0 only for str; bytes split at ASCII blanks
    return text.translate(WORD_BYTES).split()


def utf8_values(column) -> list[bytes]:
    """The values of an Arrow string column as bytes (null: empty), without decoding."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]
