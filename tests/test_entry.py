"""The driver's contract, and every query against its SQL."""

from __future__ import annotations

import glob
import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_core_does_not_import_llm():
    for path in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "quarry").parts:
            assert not re.search(r"(?m)^\s*(?:from|import)\s+quarry\.llm", path.read_text()), path


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not re.match(r"p(?!4_)\d+_", n)))
def test_against_sql(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(_norm(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
