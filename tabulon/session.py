"""Spark session and table access.

Every operator in the package takes and returns DataFrames; this module only
builds a session with the settings the operators assume (UTC, AQE, no UI) and
resolves the shared checkpoint folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tabulon") -> SparkSession:
    """Create (or reuse) a session configured for the operators.

    On a cluster the master, memory and checkpoint folder come from the
    submitting environment; locally we fill in defaults only where unset.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # one JVM: its memory is the driver's, and a partition per core is enough
        builder = builder.config("spark.driver.memory", os.environ.get("TABULON_DRIVER_MEMORY", "16g"))
        if not shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS") or "8")
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("FATAL")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application.

    Functions that run in tasks are pickled by reference, so every executor
    must be able to import ``tabulon`` wherever the driver was started.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tabulon_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # the driver's file server hands the archive out, so a folder of its own is enough
    archive = os.path.join(tempfile.mkdtemp(prefix="tabulon-pkg-"), "tabulon_pkg.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith((".py", ".txt")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tabulon", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    sc._tabulon_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder used to cut lineage.

    A cluster names it in ``spark.checkpoint.dir``; only on a local master,
    where driver and executors are one process, do we create a scratch folder
    of our own when it is unset.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tabulon-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


#: Bytes of rows that a task hands to its Python worker at a time, at most (a longer row goes alone).
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too: ten thousand long texts, once split into words, take gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (one parquet file per table)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
