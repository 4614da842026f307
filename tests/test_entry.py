"""The entry points without the corpus operators, in a copy of the repository that lacks them."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_corpus_operators(tmp_path, also):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *also))
    out = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, covered, corpus = out.stdout.split()
    assert int(n) > 40 and covered == "True" and corpus == "False"


def test_other_missing_modules_are_errors(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (copy / "cuelake/llm").mkdir()
    (copy / "cuelake/llm/__init__.py").touch()
    (copy / "cuelake/llm/registry.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120)
    assert "no_such_module" in out.stderr
