"""Every named query runs; those with SQL agree with it."""

import subprocess
import sys
from pathlib import Path

import pytest

from lumenary.plans.queries import ORACLE_SQL, QUERIES

from .compare import DATA, connection, same

REPO = Path(__file__).parent.parent


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert QUERIES.keys() <= e.queries().keys() and e.oracle_sql().keys() <= e.queries().keys()


def test_entry_without_the_removable_parts(tmp_path):
    """The package and the entry still import where the training-data operators and the pipeline are gone."""
    import shutil

    shutil.copytree(REPO / "lumenary", tmp_path / "lumenary", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    for pipeline in (False, True):
        if pipeline and (REPO / "corpus_pipeline.py").exists():
            shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
        code = "import __spark_entry__ as e; assert 'trust_detailed' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr[-500:]


def test_no_python_on_the_scoring_path(spark):
    """Records from documents to trust score stay in the JVM, without a shuffle, and read two columns."""
    plan = QUERIES["trust_score"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
