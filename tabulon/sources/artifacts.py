"""Artefact sinks and sources S-07..S-09: rules (JSON), importances (Parquet), models.

Everything is written with Spark writers into a folder the caller names
(normally under the cluster's shared ``spark.checkpoint.dir``), so any
executor can read it back.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tabulon.operators.rules import RULE_SCHEMA


def save_rules(rules: DataFrame, path: str) -> None:
    """S-07 sink: rule table as JSON lines."""
    rules.write.mode("overwrite").json(path)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """S-07 source: rule table back with its declared schema."""
    return spark.read.schema(RULE_SCHEMA).json(path)


def save_importances(importances: DataFrame, path: str) -> None:
    """S-08 sink."""
    importances.write.mode("overwrite").parquet(path)


def load_importances(spark: SparkSession, path: str) -> DataFrame:
    """S-08 source."""
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    """S-09 sink: Spark ML pipeline (label index, assembler, estimator)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """S-09 source."""
    return PipelineModel.load(path)
