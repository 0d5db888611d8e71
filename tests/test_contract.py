"""The contract without the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as contract
names = set(contract.queries())
assert "time_by_category" in names and "trip_timeline" in names
assert not [n for n in names if n == "pipeline" or n.startswith("op")], names
assert set(contract.oracle_sql()) <= names
"""


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_imports_without_the_corpus_operators(tmp_path, with_pipeline):
    gone = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    # A folder with nothing but caches is what a deleted package leaves behind.
    (tmp_path / "copy" / "datelore" / "llm" / "__pycache__").mkdir(parents=True)
    code = "from pyspark.sql import SparkSession\nSparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n" + SCRIPT
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**__import__("os").environ, "PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
