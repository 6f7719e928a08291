"""The driver's entry points against DuckDB, on the smallest tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from granary.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def said(v):
    return "" if v is None or v != v else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(said(dict(zip(columns, r, strict=True))[c]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(said(r[c]) for c in order) for r in got.collect()) == want


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("leftover", [False, True])
def test_runs_without_llm(tmp_path, leftover):
    """A copy of the repository without the subpackage and the pipeline still has all its other queries."""
    root = Path(__file__).resolve().parent.parent
    for name in ("granary", "__spark_entry__.py", "bench.py"):
        copy = shutil.copytree if (root / name).is_dir() else shutil.copy
        copy(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "granary" / "llm")
    if leftover:
        (tmp_path / "granary" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e, sys; q, s = e.queries(), e.oracle_sql(); print(len(q), any('op1_' in x for x in q), set(s) <= set(q), any(m.startswith('granary.llm.') for m in sys.modules))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert said.split() == [str(len(QUERIES)), "False", "True", "False"]
