"""Every registered query against its SQL, or at least its shape."""

from __future__ import annotations

import subprocess
import sys

import pytest

from tests.conftest import ROOT
from trailweave.plans import inventory, slate, terminals  # noqa: F401


@pytest.mark.parametrize("name", sorted(slate.SQL))
def test_query_matches_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(slate.QUERIES[name](spark, sf_dir), slate.SQL[name])


@pytest.mark.parametrize("name", sorted(set(slate.QUERIES) - set(slate.SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    made = slate.QUERIES[name](spark, sf_dir)
    assert made.count() > 0
    assert len(set(made.columns)) == len(made.columns)


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["teacher", "n_tasks", "mean_score"]
    assert set(slate.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_optional_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "trailweave", tmp_path / "trailweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_common_support' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); e.oracle_sql()"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr
