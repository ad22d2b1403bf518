"""The entry has to import with and without the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), 'tree_expand' in e.queries())"


def counted(folder: str) -> list[str]:
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_text_folders(tmp_path, pipeline):
    folder = str(tmp_path / "copy")
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, folder, ignore=left_out)
    queries, has_pipeline, has_tree = counted(folder)
    assert int(queries) >= 136 and has_pipeline == "False" and has_tree == "True"
