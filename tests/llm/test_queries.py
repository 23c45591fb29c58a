"""Every query of the subpackage that SQL can express, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from veilframe.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    assert {name.split("_")[0] for name in queries.queries()} == {f"op{n}" for n in range(1, 14)}
    assert {*queries.queries(), "pipeline"} <= set(entry.queries())
    assert set(queries.oracles()) <= set(entry.oracle_sql())
    assert "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_equals_plain_sql(spark, name):
    ours, plain = compare.both(spark, compare.connection(SF), queries.queries()[name], queries.oracles()[name], SF)
    assert ours == plain


def test_nothing_else_needs_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(root, tmp_path / "rest", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and set(q) == set(e.oracle_sql()); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "rest", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert done.stdout.strip() == "fine", done.stderr
