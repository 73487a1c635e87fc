"""The entry module on copies of the repository from which the optional parts are missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("without_pipeline", [False, True])
def test_entry_without_the_optional_subpackage(tmp_path, without_pipeline):
    copy = tmp_path / "copy"
    ignore = shutil.ignore_patterns(".git", "llm", "__pycache__", *(["corpus_pipeline.py"] if without_pipeline else []))
    shutil.copytree(ROOT, copy, ignore=ignore)
    found = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    n, operators, pipeline = found.stdout.split()
    assert int(n) > 60 and operators == pipeline == "False"
