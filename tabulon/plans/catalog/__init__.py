"""Query catalog: name -> (spark, sf_dir) -> DataFrame, plus DuckDB oracle SQL."""

from __future__ import annotations

import functools
import importlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.session import configure

MODULES = ["forecast", "profile", "clean", "target_sample", "reasoning", "text", "model", "misc"]


#: 32-bit columns of the tables, and small positions and numbers that stay 32 bits wide.
NARROW = frozenset("""l_linenumber c_nationkey p_size n_cols n_numeric n_categorical bin fold rule_id
    known_conditions position signal_sum l_quantity_bin l_discount_bin""".split())


def _configured(fn):
    """The query with the session settings it relies on (workers get the package, too)."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        configure(spark)
        df = fn(spark, sf_dir)
        # counts, ranks and codes come out as 64-bit integers
        narrow = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
                  and f.name not in NARROW]
        return df.withColumns({c: F.col(f"`{c}`").cast("long") for c in narrow}) if narrow else df
    return run


def _collect():
    queries, sql = {}, {}
    for name in MODULES:
        mod = importlib.import_module(f"tabulon.plans.catalog.{name}")
        queries.update({k: _configured(f) for k, f in mod.QUERIES.items()})
        sql.update(mod.SQL)
    return queries, sql


def queries():
    return _collect()[0]


def oracle_sql():
    return _collect()[1]
