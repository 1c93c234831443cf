"""Every query against its SQL on the smallest tables; those without SQL must give rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from cellweave.plans.oracle import ORACLE_SQL
from cellweave.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "embeddings lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: v if v is None or isinstance(v, str | bool) else round(float(v), 9) + 0.0
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    data = [tuple(r) for r in got.collect()]
    assert data
    if name in ORACLE_SQL:
        want = db.execute(ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, data) == rows(columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("n", [3, 5, 8, 41, 42, 43])
def test_spectrum_of_windows_over_the_end(spark, tmp_path, n):
    """Images whose last windows are whole, or reach one to three lines over the end."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM read_parquet('{DATA}/embeddings.parquet') WHERE vec_id < {n}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = con.execute(ORACLE_SQL["fourier_psd"])
    columns = [c[0] for c in want.description]
    got = QUERIES["fourier_psd"](spark, str(tmp_path))
    data = [tuple(r) for r in got.collect()]
    assert bool(data) == (n > 4)
    assert rows(got.columns, data) == rows(columns, want.fetchall())


def test_entry_points_import_without_the_training_data_operators(tmp_path):
    """In a copy without the subpackage and its pipeline the rest still imports and lists its queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/cellweave", tmp_path / "cellweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'window_mean' in q and 'pipeline' not in q and set(o) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
