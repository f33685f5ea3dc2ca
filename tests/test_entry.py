"""The driver contract, also without the operators for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "containment_join" in e.oracle_sql()


def test_imports_without_the_optional_parts(tmp_path):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(x.startswith('op') or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, timeout=120)
