"""Every registered query against DuckDB on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from docweave.plans import queries as core
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_matches_duckdb(name, spark, sf_dir, con):
    assert_same(core.QUERIES[name](spark, sf_dir), con, core.ORACLE[name])


def test_all_have_counterparts():
    assert set(core.QUERIES) == set(core.ORACLE)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "file", "anchor", "doc_type", "n_symbols", "symbol_ids"]
    assert df.count() > 0


def test_imports_without_the_removable_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "docweave", tmp_path / "docweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'check_stale' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
