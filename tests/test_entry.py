"""The entry file with and without the folder of training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.fixture
def copy(tmp_path):
    for name in ("folioscan", "corpus_pipeline.py", "__spark_entry__.py"):
        (shutil.copytree if (HERE / name).is_dir() else shutil.copy)(HERE / name, tmp_path / name) if (HERE / name).exists() else None
    return tmp_path


def listed(folder):
    return subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)


def test_entry_without_the_folder(copy):
    shutil.rmtree(copy / "folioscan/llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    done = listed(copy)
    count, operators, subset = done.stdout.split()
    assert int(count) > 60 and operators == "0" and subset == "True" and not done.stderr


def test_a_broken_library_is_not_hidden(copy):
    (copy / "folioscan/operators/tree.py").unlink()
    done = listed(copy)
    assert done.returncode and "tree" in done.stderr
