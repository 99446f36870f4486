"""The engine stands without its optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _without(tmp_path) -> None:
    shutil.copytree(f"{ROOT}/spindrift", tmp_path / "spindrift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    check = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q.keys() == o.keys() and len(q) > 80 and 'pipeline' not in q"
    said = subprocess.run([sys.executable, "-c", check], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_entry_without_the_optional_subpackage(tmp_path):
    _without(tmp_path)


def test_entry_with_what_a_deletion_may_leave(tmp_path):
    """A cache folder of the subpackage, and the pipeline's script."""
    (tmp_path / "corpus_pipeline.py").write_text("from spindrift.llm.common import staged\n")
    os.makedirs(tmp_path / "spindrift" / "llm" / "__pycache__")
    shutil.copytree(f"{ROOT}/spindrift", tmp_path / "spindrift", ignore=shutil.ignore_patterns("llm", "__pycache__"), dirs_exist_ok=True)
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    check = "import __spark_entry__ as e; assert len(e.queries()) > 80 and 'pipeline' not in e.queries()"
    said = subprocess.run([sys.executable, "-c", check], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(f"{ROOT}/spindrift"):
        if f"{os.sep}llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "spindrift.llm" not in open(os.path.join(folder, n)).read()
