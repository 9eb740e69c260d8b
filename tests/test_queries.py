"""Every registered query equals its SQL form on the smallest test tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as spark_entry
from checks import registry
from checks.compare import compare, open_database

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return open_database(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, database, name):
    compare(spark, database, SMALL, name)


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(spark_entry.queries())


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_log_queries_do_not_need_the_training_data_part(tmp_path):
    """With an empty subpackage folder the entry still gives every log query."""
    root = os.path.dirname(os.path.abspath(spark_entry.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    (copy / "faultline" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES))], run.stderr
