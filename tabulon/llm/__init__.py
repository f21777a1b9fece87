"""Training-data operators: mixing, filters, near-duplicates, classifiers, sharding."""

from tabulon.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
