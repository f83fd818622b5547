"""The entry module: every query runs, those with SQL give its rows, and all works without the optional folder."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from calipra.plans import catalog, catalog_cases, catalog_files, catalog_lines, catalog_more, catalog_runs  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(rows, names):
    at = [names.index(c) for c in sorted(names)]
    return sorted(repr([x[i] for i in at]) for x in map(tuple, rows))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert _rows(rows, df.columns) == _rows(want.fetchall(), want.columns)
    else:
        assert rows


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


#: In a copy without the optional folder, one query runs from end to end.
_ONE = f"from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert q['decoder_cases'](s, '{SF}').count() > 0"


def test_without_the_optional_folder(tmp_path):
    root = Path(entry.__file__).resolve().parent
    shutil.copytree(root / "calipra", tmp_path / "calipra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); " + _ONE
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
