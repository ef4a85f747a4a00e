"""The entry point in a copy of the tree without the operators on training text."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_imports_without_the_text_operators(tmp_path, with_pipeline):
    for name in ("foldwise", "tools"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", "corpus_pipeline.py"][: 1 + with_pipeline]:
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    queries, twins = (line.split() for line in run.stdout.splitlines())
    assert len(queries) > 100 and len(twins) > 100
    assert not [name for name in queries if name.startswith("op") or name == "pipeline"]
