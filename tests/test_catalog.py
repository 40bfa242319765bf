"""Each query of the catalog against its SQL over the driver's smallest tables, and the driver's entry points."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from loomread import catalog

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows_of(rows):
    value = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(value, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = rows_of(df.select(columns).collect())
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert got == rows_of(want)


def test_each_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry_without_corpus_operators(tmp_path):
    """The driver takes the corpus operators away: the entry still imports and has the other queries."""
    shutil.copytree(ROOT / "loomread", tmp_path / "loomread", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
    assert out.returncode == 0, out.stderr.decode()[-1500:]
    assert int(out.stdout) == len(catalog.QUERIES)


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "loomread").rglob("*.py"):
        if "llm" not in p.parts:
            assert "loomread.llm" not in p.read_text(), p
