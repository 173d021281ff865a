"""The driver's contract with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder):
    out = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-800:]
    names, sql = out.stdout.splitlines()[-2:]
    return set(names.split()), set(sql.split())


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_other_queries_stand_without_the_corpus_folders(tmp_path, pipeline_too):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    copy = tmp_path / "copy"
    every, _ = listed(copy)
    shutil.rmtree(copy / "trustfold" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    left, sql = listed(copy)
    assert left and left <= every and sql <= left
    assert not [n for n in left if n.startswith("op") or n == "pipeline"]
