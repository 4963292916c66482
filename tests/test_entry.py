"""The entry points: names, SQL, and life without the optional parts."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools import compare

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
HERE = sorted(k for k in entry.registry.ORACLES)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.registry.QUERIES) >= 60


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "score", "rank", "source"] and df.count() > 0


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", HERE)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert compare.rows(df.columns, df.collect()) == compare.rows(rel.columns, rel.fetchall())


def test_imports_without_the_optional_parts(tmp_path):
    """A copy without the language-model folders and the pipeline still has its other queries."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_a_missing_library_costs_its_queries_only(tmp_path):
    """Without a library of the optional parts the other queries are there, and standard error says why."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'op2_warc' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and ("zstandard" in done.stderr or "llm" in done.stderr), done.stderr


def test_nothing_else_imports_the_optional_parts():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tessera.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
