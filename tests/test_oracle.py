"""Every SQL-checked catalog query against its DuckDB oracle (sf0.001, whole tables)."""

import datetime as dt
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from tabulon.session import TABLES

from conftest import SF_SMALL

SQL = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_SMALL}/{name}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_duckdb(spark, duck, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.execute(SQL[key])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _canon(srows, sdf.columns) == _canon(drows, dcols)


def test_oracle_keys_are_queries():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 6
    assert [r["step"] for r in sorted(rows, key=lambda r: r["step"])] == [1, 2, 3, 4, 5, 6]


def test_catalog_needs_no_spark_jars(tmp_path):
    """Queries and SQL are listed in a process whose pyspark has no jars and whose folder is elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import glob, zipfile, sys; glob.glob = lambda *a, **k: []; zipfile.ZipFile = None; "
            f"sys.path.insert(0, {root!r}); import __spark_entry__ as e; "
            "assert len(e.queries()) >= 110 and len(e.oracle_sql()) >= 100")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
