"""The entry without the llm folder, and with what deleting it may leave behind."""

import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module

ROOT = pathlib.Path(entry_module.__file__).parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), sorted(q for q in e.queries() if q.startswith('op')))"


@pytest.mark.parametrize("left", ["nothing", "cache", "operators"])
def test_entry_loads(tmp_path, left):
    """``operators``: the folder is there, but corpus_pipeline.py is gone."""
    repo = tmp_path / "repo"
    shutil.copytree(ROOT / "salesmart", repo / "salesmart", ignore=shutil.ignore_patterns("__pycache__", *([] if left == "operators" else ["llm"])))
    shutil.copy(ROOT / "__spark_entry__.py", repo)
    if left == "cache":
        (repo / "salesmart" / "llm" / "__pycache__").mkdir(parents=True)
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=repo, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    count, names = run.stdout.split(" ", 1)
    assert int(count) == len(entry_module.registry.queries()) and names.strip() == "[]"
