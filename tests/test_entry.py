import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_of_queries_and_statements():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_entry_works_without_the_optional_subpackage(tmp_path):
    """In a copy of the library without it."""
    import shutil

    shutil.copytree(f"{ROOT}/cinderlake", tmp_path / "cinderlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, pipeline = out.stdout.split()
    assert int(n) > 70 and pipeline == "False"
