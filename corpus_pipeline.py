"""Training-corpus pipeline: each stage filters or arranges what its predecessor kept.

``run(spark, sf_dir)`` applies the stages to the documents table; every
stage's result is written as Parquet in the shared folder and read again, so
a lost executor never reaches further back than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import bagminhash, decontam, langid, mixing, sharding
from tabulon.llm.scratch import prepare, written
from tabulon.session import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents without a recognisable language go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of every near-duplicate class stays."""
    return bagminhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: benchmark spans are cut out; documents that are mostly benchmark go."""
    return decontam.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the words that the mix takes, a row per document and pass."""
    prepare(spark)
    return mixing.mixed_documents(docs, mixing.mix(docs))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every row gets its shard and slot."""
    prepare(spark)
    return sharding.shard_documents(docs, carry=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Signatures, trained classifiers and permutations are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
